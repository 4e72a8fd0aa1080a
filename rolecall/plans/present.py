"""Views of a recommendation list: filtered, sorted, paged and labelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import dates, text as t
from ..operators.filters import by_source, min_score, with_defaults

# Cards per page, skills shown on a card, age of a card without a date.
PAGE_SIZE = 10
SKILLS_SHOWN = 5
NO_AGE = 999


def _numbered(df: DataFrame, *order) -> DataFrame:
    """Adds ``place`` and ``page`` per candidate; a list holds at most the quota total."""
    place = Window.partitionBy("candidate_id").orderBy(*order)
    numbered = df.withColumn("place", F.row_number().over(place))
    return numbered.withColumn("page", F.ceil(F.col("place") / PAGE_SIZE).cast("int"))


def view_all(results: DataFrame, pages: int = 1) -> DataFrame:
    """The first ``pages`` pages in list order."""
    return _numbered(results, "position").filter(F.col("place") <= PAGE_SIZE * pages)


def view_recent(results: DataFrame) -> DataFrame:
    """Newest first; a card posted today counts 0 days."""
    return _numbered(results, F.coalesce("days_since_posted", F.lit(NO_AGE)), "position")


def view_high(results: DataFrame) -> DataFrame:
    """Matches of at least the high-match limit, best first."""
    return _numbered(min_score(results), F.desc(F.coalesce("match_score", F.lit(0.0))), "position")


def view_source(results: DataFrame, source: str) -> DataFrame:
    """Cards of one source in list order."""
    return _numbered(by_source(results, source), "position")


def labelled(results: DataFrame) -> DataFrame:
    """Display defaults and labels: age, score, skills shown and how many more."""
    skills = F.coalesce("matched_skills", F.array().cast("array<string>"))
    return with_defaults(results).withColumns(
        {
            "age_label": dates.age_label(F.col("days_since_posted")),
            "score_label": t.score_label(F.col("match_score")),
            "skills_count": F.size(skills),
            "skills_shown": F.slice(skills, 1, SKILLS_SHOWN),
            "skills_more": t.overflow_label(skills, SKILLS_SHOWN),
            "source_key": F.lower("source"),
        }
    )


def present(results: DataFrame, view: str = "all", pages: int = 1) -> DataFrame:
    """One view by name: ``all``, ``recent``, ``match-high`` or ``source-<name>``."""
    if view == "all":
        shown = view_all(results, pages)
    elif view == "recent":
        shown = view_recent(results)
    elif view == "match-high":
        shown = view_high(results)
    elif view.startswith("source-"):
        shown = view_source(results, view.removeprefix("source-"))
    else:
        raise ValueError(f"unknown view {view}")
    return labelled(shown)
