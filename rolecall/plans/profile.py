"""Resume text -> profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import bands, dates, text as t
from ..operators.roles import best_roles
from ..operators.skills import extract_skills, with_default_skills
from ..schema import PROFILE_SCHEMA


def profile(resumes: DataFrame, as_of, skills: DataFrame, role_skills: DataFrame, strict: bool = False) -> DataFrame:
    """One profile per resume with text; ``resumes`` has ``candidate_id, text``.

    Everything is computed inside the row, so resumes never move between tasks
    (dictionaries of bounded size).
    """
    read = resumes.select("candidate_id", t.normalise(F.col("text")).alias("resume_text")).filter("resume_text != ''")
    read = extract_skills(read, skills, "resume_text", "candidate_id")
    read = read.withColumn("skills", with_default_skills(F.col("skills"), dims.DEFAULT_SKILLS))
    read = best_roles(read, role_skills)
    body = F.col("resume_text")
    return (
        read.withColumn("_spans", dates.month_spans(body, as_of, strict))
        .withColumn("_years", dates.total_months(F.col("_spans")) / 12)
        .select(
            "candidate_id",
            F.struct(
                t.person_name(body).alias("name"), t.email(body).alias("email"), t.phone(body).alias("phone")
            ).alias("personal_info"),
            t.role_phrases(body).alias("roles"),
            "skills",
            F.bround("_years", 2).alias("total_experience_years"),
            dates.experience_details(F.col("_spans")).alias("experience_details"),
            t.education(body).alias("education"),
            bands.categorise(F.col("_years")).alias("experience_category"),
            "best_job_roles",
            "resume_text",
        )
        .select(*PROFILE_SCHEMA.names)
    )
