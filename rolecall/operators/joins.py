"""Join shapes that hold up under hot keys and at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_IDS, staged
from .filters import contains_like, like_text

#: Pieces every key is cut into by ``salted_join``.
SALTS = 16
#: Rows of one key that ``spread_join`` leaves in one piece.
HOT_ROWS = 200_000
#: Patterns of wildcards only that are tried on every value in place.
OPEN_PATTERNS = 100
#: Most keys that ``spread_join`` cuts and broadcasts.
HOT_KEYS = 100_000


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join where one key may hold a large share of ``big``.

    Rows of ``big`` go to one of ``SALTS`` pieces of their key by a hash of
    ``spread``; ``small`` (few rows per key) is repeated once per piece.
    """
    cut = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cut.join(copies, [*on, "_salt"], how).drop("_salt")


def _names(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else on


def hot_keys(counts: DataFrame, on: str | list[str], rows: int | None = None) -> DataFrame:
    """Keys of ``counts`` (key columns, ``n``) with more than ``rows`` rows, and their ``_pieces``.

    At most the ``HOT_KEYS`` hottest keys are returned, which bounds the result; a
    hot key beyond them holds less than one row in ``HOT_KEYS`` and stays whole.
    """
    limit = rows or HOT_ROWS
    hot = counts.filter(F.col("n") > limit).orderBy(F.desc("n")).limit(HOT_KEYS)
    return hot.select(*_names(on), F.ceil(F.col("n") / limit).cast("int").alias("_pieces"))


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    counts: DataFrame,
    spread: str,
    how: str = "inner",
    rows: int | None = None,
) -> DataFrame:
    """Join of ``big`` with a wide ``small`` side that has one row per key.

    Only hot keys are cut: their rows in ``big`` go to pieces by a hash of
    ``spread``, and only their row in ``small`` is repeated. ``counts`` holds the
    rows per key of ``big`` as key columns and ``n``.
    """
    keys = _names(on)
    hot = F.broadcast(hot_keys(counts, keys, rows))
    pieces = F.coalesce("_pieces", F.lit(1))
    cut = big.join(hot, keys, "left").withColumn("_piece", F.pmod(F.xxhash64(spread), pieces).cast("int"))
    copies = small.join(hot, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return cut.drop("_pieces").join(copies.drop("_pieces"), [*keys, "_piece"], how).drop("_piece")


def fetch_by_id(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a wide table whose ``id`` is in the distinct ``ids``.

    Up to ``BROADCAST_IDS`` ids the set is broadcast, so the wide table is
    filtered where it is read and never shuffled; above it both sides shuffle.
    The ids are staged first, which makes the count free of recomputation.
    """
    stored = staged(ids.select("id").distinct(), "ids")
    if stored.count() <= BROADCAST_IDS:
        stored = F.broadcast(stored)
    return table.join(stored, "id", "left_semi")


def _grams(text: Column) -> Column:
    """Distinct substrings of 1 to 3 characters."""
    length = F.length(text)
    of = lambda n: F.when(
        length >= n, F.transform(F.sequence(F.lit(1), length - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def like_pairs(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """All ``(value, pattern)`` with value LIKE '%pattern%', as an equi-join.

    Takes distinct lower-cased frames with one column each, ``value`` and
    ``pattern``. A value that matches contains every literal piece of the
    pattern, so it contains the pattern's key: the substring of at most three
    characters of the longest piece that the fewest values hold. Values join on
    those of their substrings that some pattern has, and LIKE confirms. Patterns of
    wildcards only can meet every value: while they are few they are tried on each value
    in place, else they join in pieces.
    """
    pieces = F.split(like_text(F.col("pattern")), r"\\.|[%_]")
    longest = F.element_at(F.array_sort(F.transform(pieces, lambda p: F.struct(F.length(p), p.alias("piece")))), -1)
    piece = F.col("piece")
    cut = patterns.withColumn("piece", longest["piece"])
    options = (
        cut.filter(piece != "").select(
            "pattern",
            F.explode(
                F.when(
                    F.length(piece) > 3,
                    F.transform(
                        F.sequence(F.lit(1), F.length(piece) - 2), lambda i: F.substring(piece, i, F.lit(3))
                    ),
                ).otherwise(F.array(piece))
            ).alias("gram"),
        )
    )
    asked = options.select("gram").distinct()
    grams = values.select("value", F.explode(_grams(F.col("value"))).alias("gram")).join(asked, "gram", "left_semi")
    held = grams.groupBy("gram").agg(F.count("*").alias("held"))
    keys = (
        options.join(held, "gram", "left")
        .groupBy("pattern")
        .agg(F.min(F.struct(F.coalesce("held", F.lit(0)), F.col("gram")))["gram"].alias("gram"))
    )
    matches = contains_like(F.col("value"), F.col("pattern"))
    found = grams.join(keys, "gram").filter(matches).select("value", "pattern")
    open_ones = cut.filter(piece == "").select("pattern")
    few = [r.pattern for r in open_ones.limit(OPEN_PATTERNS + 1).collect()]
    if not few:
        return found
    if len(few) <= OPEN_PATTERNS:
        tried = values.select("value", F.explode(F.array(*map(F.lit, few))).alias("pattern"))
    else:
        tried = salted_join(
            values.withColumn("gram", F.lit("")), open_ones.withColumn("gram", F.lit("")), ["gram"], F.col("value")
        ).select("value", "pattern")
    return found.unionByName(tried.filter(matches))
