"""Row filters and defaults over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.bands import allowed_classes, level_class
from ..functions.text import NOT_AVAILABLE, blank_to, strip

# What a card shows when a field is missing, and the high-match limit.
DISPLAY_DEFAULTS = {
    "job_title": "Untitled Job",
    "company": "Unknown Company",
    "location": "Unknown Location",
    "job_link": "#",
}
HIGH_MATCH = 20


def like_text(pattern: Column) -> Column:
    """``pattern`` for LIKE: ``%`` and ``_`` stay wildcards, a stray backslash is dropped."""
    return F.regexp_replace(F.lower(pattern), r"(\\[%_\\])|\\", "$1")


def contains_like(text: Column, pattern: Column) -> Column:
    """Case-insensitive LIKE '%pattern%'."""
    return F.like(F.lower(text), F.concat(F.lit("%"), like_text(pattern), F.lit("%")))


def location_like(location: Column, preference: Column) -> Column:
    return contains_like(location, preference)


def title_matches_any(title: Column, roles: Column) -> Column:
    """Title LIKE any role slug; an empty role list accepts every title."""
    return (F.coalesce(F.size(roles), F.lit(0)) <= 0) | F.exists(roles, lambda r: contains_like(title, r))


def experience_filter(level: Column, category: Column) -> Column:
    """Fresher: levels starting 0- or 1-; Experienced: the others; else all."""
    return F.array_contains(allowed_classes(category), level_class(level))


def has_location(preference: Column) -> Column:
    return F.coalesce(strip(preference) != "", F.lit(False))


def _missing(col: Column) -> Column:
    return col.isNull() | (col == "") | (F.lower(col) == NOT_AVAILABLE.lower())


def invalid_reason(df: DataFrame) -> Column:
    """Why a posting is dropped by the cleaning job; NULL for a valid one."""
    return (
        F.when(_missing(F.col("skills_required")), "skills_required")
        .when(_missing(F.col("job_type")), "job_type")
        .when(_missing(F.col("job_description")), "job_description")
        .when(F.col("applicants") == 0, "applicants")
    )


def clean_invalid(df: DataFrame) -> DataFrame:
    """Postings with skills, type and description, and not exactly 0 applicants."""
    return df.filter(invalid_reason(df).isNull())


def recent(df: DataFrame, as_of, days: int = 30) -> DataFrame:
    return df.filter(dates.is_recent(F.col("posted_date"), as_of, days))


def by_source(df: DataFrame, source: str) -> DataFrame:
    return df.filter(F.lower("source") == source.lower())


def min_score(df: DataFrame, limit: float = HIGH_MATCH) -> DataFrame:
    return df.filter(F.coalesce("match_score", F.lit(0)) >= limit)


def with_defaults(df: DataFrame) -> DataFrame:
    """Display defaults for missing text, applicants and score."""
    filled = {c: blank_to(F.col(c), d) for c, d in DISPLAY_DEFAULTS.items() if c in df.columns}
    filled |= {c: F.coalesce(F.col(c), F.lit(0)) for c in ("applicants", "match_score") if c in df.columns}
    return df.withColumns(filled)


def with_id(df: DataFrame) -> DataFrame:
    """Ids as text; a row without one gets a random one."""
    return df.withColumn("id", F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("0")), F.uuid()))
