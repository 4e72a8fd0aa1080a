"""Run reports and list summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .filters import invalid_reason


def run_report(before: DataFrame, after: DataFrame, seconds: float | None = None) -> DataFrame:
    """Per source and role: rows before and after a run, inserted and deleted.

    Rows are matched by ``id`` being in one table or both, counted per id first; rows
    without an id can't be matched and only their numbers are compared. With the run's ``seconds`` it adds the average per inserted row.
    """
    side = lambda df, b, a: df.select("id", "source", "role", F.lit(b).alias("b"), F.lit(a).alias("a"))
    rows = side(before, 1, 0).unionByName(side(after, 0, 1)).groupBy("id", "source", "role")
    unnamed = F.col("id").isNull()
    matched = lambda c: F.when(unnamed, F.sum(c)).otherwise(F.max(c)).alias(c)
    per_id = rows.agg(matched("b"), matched("a"))
    more = lambda x, y: F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0)))
    report = per_id.groupBy("source", "role").agg(
        F.sum("b").alias("rows_before"),
        F.sum("a").alias("rows_after"),
        more("a", "b").alias("inserted"),
        more("b", "a").alias("deleted"),
    )
    if seconds is None:
        return report
    return report.withColumn(
        "seconds_per_row", F.when(F.col("inserted") > 0, F.round(F.lit(seconds) / F.col("inserted"), 2))
    )


#: Names of the grouping sets, by which of source and role they leave out.
SCOPES = {0: "source and role", 1: "source", 2: "role", 3: "total"}


def _scoped(rows: DataFrame, sums: list[Column], seconds: float | None) -> DataFrame:
    """Sums per source and role, per source, per role and in total, in one pass, with ``scope``."""
    scope = F.grouping_id("source", "role")
    named = F.element_at(F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair]), scope.cast("int"))
    report = rows.cube("source", "role").agg(named.alias("scope"), *sums)
    if seconds is None:
        return report
    average = F.round(F.lit(float(seconds)) / F.col("inserted"), 2)
    return report.withColumn("seconds_per_row", F.when(F.col("inserted") > 0, average))


def change_report(before: DataFrame, after: DataFrame, seconds: float | None = None) -> DataFrame:
    """Rows before and after a run, inserted, deleted and updated, per source and role and in totals.

    Rows are matched by ``id``; one is updated if a fingerprint of the columns that
    both tables have differs. It counts for the source and role it has after the run, a
    deleted one for those it had. Rows without an id can't be matched: only their numbers
    are compared. One shuffle by id of one number per row, whatever the row's width.
    """
    shared = sorted({f.name for f in before.schema} & {f.name for f in after.schema} - {"id"})
    mark = F.xxhash64(*shared)
    side = lambda df, b, a: df.select("id", "source", "role", mark.alias("mark"), F.lit(b).alias("b"), F.lit(a).alias("a"))
    unnamed = F.when(F.col("id").isNull(), F.struct("source", "role"))  # spreads the rows without an id
    rows = side(before, 1, 0).unionByName(side(after, 0, 1)).groupBy("id", unnamed.alias("_own"))
    counted = lambda c: F.when(F.col("id").isNull(), F.sum(c)).otherwise(F.max(c)).alias(c)
    place = F.max_by(F.struct("source", "role"), "a").alias("place")
    marks = [F.max(F.when(F.col(c) == 1, F.col("mark"))).alias(f"mark_{c}") for c in ("b", "a")]
    per_id = rows.agg(counted("b"), counted("a"), place, *marks).withColumns({"source": F.col("place.source"), "role": F.col("place.role")})
    more = lambda x, y, name: F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))).alias(name)
    changed = F.col("id").isNotNull() & (F.col("b") == 1) & (F.col("a") == 1) & (F.col("mark_b") != F.col("mark_a"))
    sums = [
        F.sum("b").alias("rows_before"),
        F.sum("a").alias("rows_after"),
        more("a", "b", "inserted"),
        more("b", "a", "deleted"),
        F.count_if(changed).alias("updated"),
    ]
    return _scoped(per_id, sums, seconds)


def crawl_report(links: DataFrame, inserted: DataFrame, seconds: float | None = None) -> DataFrame:
    """What a crawl did: ``links`` seen and ``taken``, rows ``inserted``, per source and role and in totals.

    ``links`` has ``source, role, taken``, ``inserted`` has ``source, role``.
    """
    seen = links.select("source", "role", F.lit(1).alias("link"), F.col("taken").cast("int").alias("took"), F.lit(0).alias("row"))
    added = inserted.select("source", "role", F.lit(0).alias("link"), F.lit(0).alias("took"), F.lit(1).alias("row"))
    sums = [F.sum("link").alias("links"), F.sum("took").alias("taken"), F.sum("row").alias("inserted")]
    return _scoped(seen.unionByName(added), sums, seconds)


def invalid_reason_counts(postings: DataFrame) -> DataFrame:
    """How many postings the cleaning job drops, by reason."""
    return (
        postings.select(invalid_reason(postings).alias("reason"))
        .filter("reason is not null")
        .groupBy("reason")
        .agg(F.count("*").alias("rows"))
    )


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its row count, filled by the write that follows."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def source_list(results: DataFrame) -> DataFrame:
    """Sources of each candidate's list, in order of first appearance, ignoring case."""
    return results.groupBy("candidate_id", F.lower("source").alias("source_key")).agg(
        F.min_by("source", "position").alias("source"), F.min("position").cast("int").alias("first_position")
    )


def visible_counts(results: DataFrame, shown: DataFrame) -> DataFrame:
    """Per candidate: cards in the list, cards a view shows, and whether none is left."""
    total = results.groupBy("candidate_id").agg(F.count("*").alias("total"))
    visible = shown.groupBy("candidate_id").agg(F.count("*").alias("n"))
    return (
        total.join(visible, "candidate_id", "left")
        .select("candidate_id", "total", F.coalesce("n", F.lit(0)).alias("visible"))
        .withColumn("none_found", F.col("visible") == 0)
    )
