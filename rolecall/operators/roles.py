"""Best roles for a set of skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import dims
from ..functions.text import slug
from .joins import salted_join

# Weights of the role score, roles kept, and when defaults are added.
MATCH_WEIGHT = 0.7
SKILL_POINTS = 10
TOP_ROLES = 3
FEW_ROLES = 2

#: Largest role table (rows) that is evaluated inside the row.
ROW_SKILLS = 5000


def role_score(matched: Column, required: Column) -> Column:
    return matched / required * 100 * MATCH_WEIGHT + matched * SKILL_POINTS


def with_default_roles(roles: Column) -> Column:
    padded = F.slice(F.array_union(roles, F.array(*map(F.lit, dims.DEFAULT_ROLES))), 1, TOP_ROLES)
    return F.when(F.size(roles) < FEW_ROLES, padded).otherwise(roles)


def _bounded_roles(role_skills: DataFrame) -> dict[tuple[int, str], list[str]] | None:
    rows = role_skills.select("role", "role_ord", "skill").limit(ROW_SKILLS + 1).collect()
    if len(rows) > ROW_SKILLS:
        return None
    roles: dict[tuple[int, str], list[str]] = {}
    for row in rows:
        roles.setdefault((row.role_ord, row.role), []).append(row.skill)
    return roles


def best_roles(df: DataFrame, role_skills: DataFrame, key: str = "candidate_id", out: str = "best_job_roles") -> DataFrame:
    """Adds ``out``: up to three role slugs by score, topped up with the defaults.

    ``skills`` is an array of distinct skills. A role table of bounded size is
    compared inside each row, without a shuffle.
    """
    known = _bounded_roles(role_skills)
    if known is None:
        return best_roles_by_join(df, role_skills, key, out)

    def scored(ord_: int, role: str, required: list[str]) -> Column:
        wanted = F.array(*map(F.lit, required))
        matched = F.size(F.array_intersect(F.transform("skills", F.lower), wanted))
        score = role_score(matched, F.lit(len(required)))
        return F.struct((-score).alias("rank"), F.lit(ord_).alias("ord"), F.lit(role).alias("role"))

    scores = [scored(ord_, role, required) for (ord_, role), required in known.items()]
    some = F.filter(F.array(*scores), lambda r: r["rank"] < 0)
    top = F.transform(F.slice(F.array_sort(some), 1, TOP_ROLES), lambda r: slug(r["role"]))
    return df.withColumn("_top", top).withColumn(out, with_default_roles(F.col("_top"))).drop("_top")


def role_scores(df: DataFrame, role_skills: DataFrame, key: str = "candidate_id") -> DataFrame:
    """``key, role, role_ord, matched, score`` for roles with a matching skill.

    A skill counts once however often the role or the candidate lists it; the number
    required counts every listing. Common skills are spread over pieces of their key.
    """
    required = role_skills.groupBy("role", "role_ord").agg(F.count("*").alias("required"))
    wanted = role_skills.select("role", "role_ord", "skill").distinct()
    mine = df.select(key, F.explode(F.array_distinct(F.transform("skills", F.lower))).alias("skill"))
    return (
        salted_join(mine, wanted, ["skill"], F.col(key))
        .groupBy(key, "role", "role_ord")
        .agg(F.count("*").alias("matched"))
        .join(required, ["role", "role_ord"])
        .select(key, "role", "role_ord", "matched", role_score(F.col("matched"), F.col("required")).alias("score"))
    )


def best_roles_by_join(df: DataFrame, role_skills: DataFrame, key: str, out: str) -> DataFrame:
    """``best_roles`` for a role table of any size.

    Works per distinct set of skills, so rows with a NULL or repeated ``key`` get their
    roles like all others.
    """
    held = df.withColumn("_held", F.array_sort(F.array_distinct(F.transform("skills", F.lower))))
    held = held.withColumn("_set", F.sha2(F.to_json(F.coalesce("_held", F.array().cast("array<string>"))), 256))
    sets = held.groupBy("_set").agg(F.first("_held").alias("skills"))
    order = Window.partitionBy("_set").orderBy(F.desc("score"), "role_ord")
    top = (
        role_scores(sets, role_skills, "_set")
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= TOP_ROLES)
        .groupBy("_set")
        .agg(F.array_sort(F.collect_list(F.struct("rn", slug(F.col("role")).alias("role"))))["role"].alias("_top"))
    )
    none = F.array().cast("array<string>")
    return (
        held.join(top, "_set", "left")
        .withColumn(out, with_default_roles(F.coalesce("_top", none)))
        .drop("_top", "_held", "_set")
    )
