"""Benchmark decontamination by size-partitioned MinHash containment search, DataFrame functions only.

A test item is in a document if at least ``threshold`` of its distinct five-word
shingles are among the document's. Items are short and documents long, so their Jaccard
similarity says little and only the items are sketched:

* items are partitioned by their number of shingles into classes [2**j, 2**(j+1));
* an item's sketch is its ``k`` shingles with the smallest hashes (bottom-k MinHash).
  ``k`` belongs to the class: one more than the shingles its largest item may lack,
  doubled. A document that contains an item with ``d`` shingles missing holds at least
  ``k - d`` of its sketch, so no containment is missed whatever the document's length;
* every shingle of every document is looked up among the sketches. The documents'
  shingles aren't stored or shuffled: those whose hash is above all sketches stop at a
  comparison, the rest meet the sketches, broadcast while there are at most
  ``BROADCAST_SKETCHES`` hashes and joined by hash beyond;
* candidates are verified by exact containment: all shingles of the candidate documents
  against all shingles of their items, compared as words and not as hashes.

Words are runs without ASCII white space, A-Z in lower case.

Defined results: null, empty or shorter texts have no shingles, so such an item is in no
document and such a document holds none; null ids and repeated rows of documents are
documents of their own; items without id are skipped, rows of one item id count as one
item; empty tables give no rows; extra columns have no influence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import rows
from rolecall.llm.keep import without
from rolecall.session import staged

SHINGLE = 5
#: Sketch hashes (16 bytes each) that may be broadcast; above it the join shuffles.
BROADCAST_SKETCHES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: F.Column) -> F.Column:
    """Words of a text, runs without ASCII white space, A-Z in lower case (a wordless text gives one empty word)."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), UPPER + "\t\n\x0b\x0c\r", LOWER + " " * 5))
    return F.split(plain, " +")


def shingles(texts: DataFrame, *keep: str) -> DataFrame:
    """One row per shingle: ``keep`` columns, the words ``w`` and the place ``i`` of the first (from 0)."""
    split = texts.select(*keep, words(F.col("text")).alias("w")).filter(F.size("w") >= SHINGLE)
    return split.select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - SHINGLE)).alias("i"))


def shingle_hash() -> F.Column:
    return F.xxhash64(*[F.col("w")[F.col("i") + j] for j in range(SHINGLE)])


def shingle_text() -> F.Column:
    return F.concat_ws(" ", *[F.col("w")[F.col("i") + j] for j in range(SHINGLE)])


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item, size, hash, least): each item's sketch and how many of it a containing document holds at least."""
    sets = items.groupBy("item").agg(F.sort_array(F.collect_set("h")).alias("hs"))  # one short item's shingles
    size = F.size("hs")
    lacking = lambda n: F.floor(F.lit(1.0) * n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)))
    top = F.pow(F.lit(2.0), F.floor(F.log2(size)) + 1) - 1  # the largest size of the item's class
    k = F.least(size, (2 * (lacking(top) + 1)).cast("int"))
    return sets.select(
        "item", size.alias("size"), F.explode(F.slice("hs", 1, k)).alias("h"), (k - lacking(size)).cast("int").alias("least")
    )


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(_key, item, shared, size): the items in each document, with the shingles shared and in all.

    ``docs`` has ``_key`` and ``text``; ``items`` has ``item`` and ``text``.
    """
    known = items.filter(F.col("item").isNotNull())
    parts = staged(shingles(known, "item").select("item", shingle_hash().alias("h"), shingle_text().alias("s")).distinct(), "item-shingles")
    probe = staged(sketches(parts.select("item", "h"), threshold), "item-sketches")
    facts = probe.agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("top")).first()
    table = F.broadcast(probe) if facts.n <= BROADCAST_SKETCHES else probe
    near = shingles(docs, "_key").select("_key", shingle_hash().alias("h")).filter(F.col("h") <= F.lit(facts.top))
    hits = near.join(table, "h").groupBy("_key", "item", "size", "least", "h").agg(F.count(F.lit(1)).alias("n"))
    candidates = staged(hits.groupBy("_key", "item", "size", "least").count().filter("count >= least").select("_key", "item", "size"), "item-candidates")

    # exact containment: only the candidate documents' shingles, and only those of their items
    chosen = candidates.select("_key").distinct()
    held = shingles(docs.join(chosen, "_key", "left_semi"), "_key").select("_key", shingle_text().alias("s")).distinct()
    wanted = candidates.join(parts.select("item", "s"), "item")
    shared = wanted.join(held, ["_key", "s"]).groupBy("_key", "item", "size").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(F.col("shared") >= F.col("size") * F.lit(threshold) - F.lit(1e-9)).select("_key", "item", "shared", "size")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with the item in the document."""
    docs = rows.keyed(rows.table(spark, sf_dir, "documents"), "doc_id", "text")
    items = rows.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    found = contained(docs, items)
    named = docs.select("_key", F.col("_id").alias("doc_id")).join(found, "_key")
    return named.select("doc_id", F.col("item").alias("item_id"), "shared", "size")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; the columns stay as they are."""
    items = rows.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    return without(docs, "doc_id", lambda keyed: contained(keyed, items).select("_key"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)
), n AS (SELECT item_id, count(*) AS size FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(size) AS size
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 10 * count(*) >= 8 * any_value(size)
"""
