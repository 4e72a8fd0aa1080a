"""Near-duplicate detection by BagMinHash signatures of shingle multisets.

A text is the multiset of its five-word shingles. Each unit of a shingle's multiplicity
is a strip of a Poisson process; the strips are grouped in dyadic levels (0, 1], (1, 2],
(2, 4], (4, 8] ..., each level is one process of its width's rate, and a point of a level
belongs to the multiset if the strip it falls on (drawn from the point itself) is below
the multiplicity. Every point goes to a random one of ``m`` registers, which keep their
earliest point. Two registers agree with exactly the weighted Jaccard similarity
(sum of minima over sum of maxima) of the multisets. Points later than all registers
can't matter, so the processes stop early.

Texts with equal words are one class; only one row of each class is compared. Registers
are banded; classes that share a band meet in a bucket. No bucket is left before all its
pairs of different components are compared, and only small ones become rows of pairs:

1. a bucket's pivot is the class that shares most buckets with others, the likely
   original of a family of copies; every class is compared with the best of its pivots;
2. components are formed from the verified links;
3. buckets of at most ``SMALL`` classes that still hold several components are compared by
   all pairs across components;
4. in larger ones that still do, every class outside the largest component meets all
   classes of the bucket, connected or not, blocks by blocks inside a task, which sends one
   link for each two components that it finds connected.

Links are verified by the exact multiset overlap.

Defined results: a text with fewer than five words has no shingles and is near only to
texts with the same words; wordless texts (null, empty) are near to nothing; every row
gets one result, repeated rows and null ids included; an empty table gives no rows;
extra columns have no influence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import ragged, rows
from rolecall.llm.components import components
from rolecall.llm.keep import without
from rolecall.operators.joins import spread_join
from rolecall.session import staged

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Classes of a bucket that are compared by rows of pairs; larger buckets are compared in blocks.
SMALL = 12
#: Rows of one bucket or one end of pairs that a join leaves together.
HOT_PAIRS = 1024
#: Classes and shingles of a block, in expectation.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Keys (8 bytes each) that may be broadcast; above it the texts are joined by key.
FEW_KEYS = 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(data: np.ndarray, offsets: np.ndarray):
    """(words per text, sequence hashes, distinct shingles' hashes, their texts, their multiplicities), by text."""
    n = len(offsets) - 1
    lower = ragged.LOWER[data]
    starts, ends, text = ragged.token_spans(lower, offsets)
    words = ragged.span_hash(ragged.prefix(lower), starts, ends)
    size = np.bincount(text, minlength=n)
    place = (np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
    sequence = []
    for salt in (np.uint64(1), np.uint64(0xD1B54A32D192ED03)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(ragged.mix(words * (salt | np.uint64(1)) + ragged.mix(place + salt)), dtype=np.uint64)])
        ends_at = np.cumsum(size)
        sequence.append((sums[ends_at] - sums[ends_at - size]).view(np.int64))
    hashes, owner = ragged.text_windows(words, text, SHINGLE)
    hashes, owner = _by_text(hashes, owner, n)
    first, end = ragged.runs(ragged.mix(hashes) + owner.astype(np.uint64))
    return size, sequence, hashes[first], owner[first], end - first


def _by_text(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order within their texts; one sort by text and leading bits, put right where those don't tell."""
    bits = np.uint64(max(1, int(texts).bit_length()))
    order = np.argsort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))
    hashes, owner = hashes[order], owner[order]
    if ((hashes[1:] < hashes[:-1]) & (owner[1:] == owner[:-1])).any():
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def signatures(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(texts, m) earliest points; infinite for texts without shingles."""
    out = np.full((texts, m), np.inf)
    # one stream per element and level; level j > 0 covers the strips from 2 ** (j - 1) up to 2 ** j
    levels = 1 + np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64)
    stream = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(stream)) - np.repeat(np.cumsum(levels) - levels, levels)
    start = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(start, 1).astype(float)
    seed = ragged.mix(hashes[stream] + ragged.mix(level.astype(np.uint64) + np.uint64(17)))
    doc, limit = owner[stream], weight[stream] - start
    time = np.zeros(len(stream))
    latest = np.full(texts, np.inf)
    flat = out.reshape(-1)
    while len(stream):
        block = int(np.clip(8192 // len(stream), 1, 64))  # more points at once when few streams are left
        seeds = seed[:, None] + GOLDEN * np.arange(1, block + 1, dtype=np.uint64)
        gap = ragged.mix(seeds)
        uniform = ((gap >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        times = time[:, None] + np.cumsum(-np.log(uniform) / width[:, None], axis=1)
        spot = ragged.mix(seeds ^ np.uint64(0xA0761D6478BD642F))
        register = (spot % np.uint64(m)).astype(np.int64)
        strip = ((spot >> np.uint64(32)).astype(float) * 2.0**-32 * width[:, None]).astype(np.int64)
        hit = (strip < limit[:, None]) & (times <= latest[doc][:, None])
        np.minimum.at(flat, (doc[:, None] * m + register)[hit], times[hit])
        seed, time = seeds[:, -1], times[:, -1]
        touched = np.unique(doc)
        latest[touched] = out[touched].max(axis=1)
        on = time <= latest[doc]
        seed, time, doc, limit, width, stream = seed[on], time[on], doc[on], limit[on], width[on], stream[on]
    return out


def band_values(registers: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes; each also depends on the band's number."""
    raw = registers.view(np.uint64).reshape(len(registers), BANDS, ROWS)
    out = np.broadcast_to(ragged.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)), raw.shape[:2]).copy()
    for k in range(ROWS):
        out = ragged.mix(out * ragged.BASE + raw[:, :, k])
    return out.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """(_key, n_words, d1, d2, bands) of each row of ``docs`` (_key, text); no bands without shingles."""

    def work(batches):
        for batch in batches:
            data, offsets = ragged.texts(batch.column(1))
            for first, end, d, o in ragged.chunks(data, offsets, 4 * ragged.CHUNK):
                size, (d1, d2), hashes, owner, weight = bags(d, o)
                values = band_values(signatures(hashes, owner, weight, end - first))
                some = size >= SHINGLE
                cut = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(size), pa.array(d1), pa.array(d2)]
                    + [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values[some].reshape(-1)))],
                    ["_key", "n_words", "d1", "d2", "bands"],
                )

    return docs.select("_key", "text").mapInArrow(work, "_key bigint, n_words bigint, d1 bigint, d2 bigint, bands array<bigint>")


def bag_rows(docs: DataFrame) -> DataFrame:
    """(_key, bag): the sorted shingle hashes of each row, repeated by multiplicity."""

    def work(batches):
        for batch in batches:
            data, offsets = ragged.texts(batch.column(1))
            for first, end, d, o in ragged.chunks(data, offsets):
                _, _, hashes, owner, weight = bags(d, o)
                cut = np.searchsorted(owner, np.arange(end - first + 1))
                blobs = [np.repeat(hashes[a:b], weight[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(blobs, pa.binary())], ["_key", "bag"])

    return docs.select("_key", "text").mapInArrow(work, "_key bigint, bag binary")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays taken as multisets."""
    both = np.concatenate([a, b])
    values, counts = np.unique(both, return_counts=True)
    left = np.searchsorted(a, values, "right") - np.searchsorted(a, values, "left")
    shared = int(np.minimum(left, counts - left).sum())
    return shared / (len(both) - shared) if len(both) else 0.0


def fetch(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` with the distinct ``keys``; texts move only if there are more than ``FEW_KEYS`` of them."""
    stored = staged(keys, "keys")
    few = stored.count() <= FEW_KEYS
    return docs.join(F.broadcast(stored) if few else stored, "_key", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the ``pairs`` (a, b) that reach ``threshold`` by their exact multisets."""
    wanted = pairs.select(F.col("a").alias("_key")).unionByName(pairs.select(F.col("b").alias("_key"))).distinct()
    held = staged(bag_rows(fetch(docs, wanted)), "bags")
    # each pair meets the bag of its rarer end first; a frequent end's bag comes last and doesn't travel with its pairs
    ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("n")), "ends")
    of = lambda c: ends.select(F.col("end").alias(c), F.col("n").alias(f"n_{c}"))
    more, less = F.col("n_a") >= F.col("n_b"), F.col("n_a") < F.col("n_b")
    turned = pairs.join(of("a"), "a").join(of("b"), "b").select(
        F.when(more, F.col("a")).otherwise(F.col("b")).alias("hot"), F.when(less, F.col("a")).otherwise(F.col("b")).alias("cold")
    )
    one = turned.join(held.select(F.col("_key").alias("cold"), F.col("bag").alias("bag_a")), "cold")
    frequent = held.select(F.col("_key").alias("hot"), F.col("bag").alias("bag_b"))
    both = spread_join(one, frequent, "hot", ends.withColumnRenamed("end", "hot"), "cold", rows=HOT_PAIRS)
    both = both.select(F.least("hot", "cold").alias("a"), F.greatest("hot", "cold").alias("b"), "bag_a", "bag_b")

    def work(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            got = [
                overlap(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64))
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(work, "a bigint, b bigint, similarity double").filter(F.col("similarity") >= threshold)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller key first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _shape(buckets: DataFrame) -> DataFrame:
    """Per bucket its pivot (``top``: weight, negated key, component) and number of classes, if it holds several components."""
    return (
        buckets.groupBy("bucket")
        .agg(
            F.max(F.struct("weight", (-F.col("_key")).alias("low"), "component")).alias("top"),
            F.count(F.lit(1)).alias("n"),
            (F.min("component") != F.max("component")).alias("open"),
        )
        .filter("open")
        .drop("open")
    )


def nearest_pivots(buckets: DataFrame) -> DataFrame:
    """One pair per class: the pivot that shares most buckets with others, of all pivots of the class's buckets."""
    shape = staged(_shape(buckets), "shape")
    told = spread_join(buckets.select("bucket", "_key"), shape.select("bucket", "top"), "bucket", shape.select("bucket", "n"), "_key", rows=HOT_PAIRS)
    told = told.filter(F.col("_key") != -F.col("top.low"))
    best = told.groupBy("_key").agg(F.max(F.struct("top.weight", "top.low")).alias("best"))
    return _ordered(best.select(F.col("_key").alias("a"), (-F.col("best.low")).alias("b")))


def candidates(buckets: DataFrame) -> DataFrame:
    """All pairs across components of the buckets of at most ``SMALL`` classes."""
    shape = staged(_shape(buckets).select("bucket", "n"), "shape")
    few = spread_join(buckets, shape.filter(F.col("n") <= SMALL).select("bucket"), "bucket", shape, "_key", "left_semi", HOT_PAIRS)
    held = few.groupBy("bucket").agg(F.collect_list(F.struct("_key", "component")).alias("held"))  # at most SMALL
    one = held.select(F.explode("held").alias("x"), "held")
    across = one.select("x", F.explode("held").alias("y")).filter("x._key < y._key and x.component <> y.component")
    return _ordered(across.select(F.col("x._key").alias("a"), F.col("y._key").alias("b")))


def blocks(buckets: DataFrame, held: DataFrame) -> DataFrame:
    """(seekers, targets) of the buckets (bucket, _key, component) of more than ``SMALL`` classes in several components.

    Both are lists of (_key, component, bag), the bags from ``held`` (_key, bag, shingles). Every class outside a
    bucket's largest component is among the seekers of rows whose targets are, together, all classes of the bucket.
    """
    told = buckets.join(held.select("_key", "shingles"), "_key")
    sizes = told.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("shingles"))
    total = [F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "component", "shingles")).alias("top")]
    shape = sizes.groupBy("bucket").agg(*total).filter((F.col("n") > F.col("top.n")) & (F.col("n") > SMALL))
    parts = lambda n, shingles: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")
    shape = shape.select(
        "bucket",
        F.col("top.component").alias("main"),
        parts(F.col("n") - F.col("top.n"), F.col("shingles") - F.col("top.shingles")).alias("of_s"),
        parts(F.col("n"), F.col("shingles")).alias("of_t"),
    )
    whole = buckets.select("bucket", "_key", "component").join(shape, "bucket").join(held.select("_key", "bag"), "_key")

    def packed(members, part, of, other, name):
        """The members in ``of`` parts by key, once for each part of the other side."""
        dealt = members.withColumn(part, F.pmod(F.xxhash64("_key"), F.col(of)).cast("int"))
        lists = dealt.groupBy("bucket", part, f"of_{other}").agg(F.collect_list(F.struct("_key", "component", "bag")).alias(name))
        return lists.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"of_{other}") - 1))).drop(f"of_{other}")

    seekers = packed(whole.filter("component <> main"), "s", "of_s", "t", "seekers")
    return seekers.join(packed(whole, "t", "of_t", "s", "targets"), ["bucket", "s", "t"]).select("seekers", "targets")


def occurrences(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One hash per shingle and place among its repeats, so that shared ones are the sum of minima; and the bags' starts."""
    size = np.array([len(b) for b in bags])
    starts = np.cumsum(size) - size
    values, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), size)
    first, end = ragged.runs(ragged.mix(values) + owner.astype(np.uint64))
    place = np.arange(len(values)) - np.repeat(first, end - first)
    return ragged.mix(values + GOLDEN * place.astype(np.uint64)), starts


def forest(keys: np.ndarray, component: np.ndarray, bags: list[np.ndarray], seekers: int, threshold: float) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) of the first ``seekers`` to the others, one for each two components that are thereby connected."""
    hashes, starts = occurrences(bags)
    _, number = np.unique(hashes, return_inverse=True)
    size = np.diff(np.append(starts, len(hashes)))
    cut = starts[seekers]
    targets, begins = number[cut:], starts[seekers:] - cut
    mark = np.zeros(len(hashes), np.int32)
    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for x in range(seekers):
        own = number[starts[x] : starts[x] + size[x]]
        mark[own] = 1
        shared = np.add.reduceat(mark[targets], begins)
        mark[own] = 0
        similar = shared / (size[x] + size[seekers:] - shared)
        near = seekers + np.flatnonzero((similar >= threshold) & (component[seekers:] != component[x]))
        for y in near[np.unique(component[near], return_index=True)[1]].tolist():
            low, high = sorted((find(int(component[x])), find(int(component[y]))))
            if low != high:
                root[high] = low
                out.append((*sorted((int(keys[x]), int(keys[y]))), float(similar[y - seekers])))
    return out


def block_links(buckets: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): links that connect whatever is connected within a large bucket."""
    shape = staged(_shape(buckets).select("bucket", "n"), "shape")
    some = spread_join(buckets, shape.filter(F.col("n") > SMALL).select("bucket"), "bucket", shape, "_key", "left_semi", HOT_PAIRS)
    some = staged(some.select("bucket", "_key", "component"), "open")
    held = staged(bag_rows(fetch(docs, some.select("_key").distinct())).withColumn("shingles", F.length("bag") / 8), "bags")

    def work(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                sides = [batch.column(c).slice(row, 1).flatten().flatten() for c in (0, 1)]
                keys, component = (np.concatenate([side[k].to_numpy() for side in sides]) for k in (0, 1))
                bags = [np.frombuffer(b.as_buffer(), np.uint64) for side in sides for b in side[2]]
                out += forest(keys, component, bags, len(sides[0][0]), threshold)
            columns = list(zip(*out, strict=True)) or [[], [], []]
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "similarity"])

    return blocks(some, held).mapInArrow(work, "a bigint, b bigint, similarity double").dropDuplicates(["a", "b"])


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (node, component) after the links ``found`` between nodes; only components that links touch move."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    links = found.join(end("a"), "a", "left").join(end("b"), "b", "left")
    links = links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b")
    moved = components(links)
    kept = labels.join(moved.withColumnRenamed("component", "to").withColumnRenamed("node", "component"), "component", "left")
    old = kept.select("node", F.coalesce("to", "component").alias("component"))
    fresh = moved.join(labels, "node", "left_anti")
    return staged(old.unionByName(fresh), "labels")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Groups and links of ``docs`` (_key, text).

    Groups: (_key, class_key, group_key), the smallest keys of the row's class and group.
    Links: (a, b, similarity) between classes, enough to connect each group.
    """
    signed = staged(sign(docs), "signatures")
    worded = signed.filter("n_words > 0")
    classes = staged(worded.groupBy("d1", "d2").agg(F.min("_key").alias("class_key"), F.count(F.lit(1)).alias("copies")), "classes")
    first = signed.select("_key", "bands").join(classes.select(F.col("class_key").alias("_key")), "_key", "left_semi")
    spread = first.select("_key", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = staged(spread.join(shared, "bucket"), "buckets")
    weight = met.groupBy("_key").agg(F.sum("n").alias("weight"))
    buckets = staged(met.join(weight, "_key").select("bucket", "_key", "weight", F.col("_key").alias("component")), "buckets")
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a bigint, b bigint, similarity double")
    labels = spark.createDataFrame([], "node bigint, component bigint")
    steps = (
        lambda met: verify(staged(nearest_pivots(met), "pairs"), docs, threshold),
        lambda met: verify(staged(candidates(met), "pairs"), docs, threshold),
        lambda met: block_links(met, docs, threshold),
    )
    for step in steps:
        found = staged(step(buckets), "links")
        if found.limit(1).count():
            links = links.unionByName(found)
            labels = _merged(labels, found)
        if step is steps[-1]:
            break
        known = buckets.drop("component").join(labels, F.col("_key") == F.col("node"), "left").select(
            "bucket", "_key", "weight", F.coalesce("component", "_key").alias("component")
        )
        buckets = staged(known.join(_shape(known).select("bucket"), "bucket", "left_semi"), "buckets")
        if not buckets.limit(1).count():
            break
    grouped = classes.join(labels, F.col("class_key") == F.col("node"), "left").select(
        "d1", "d2", "class_key", F.coalesce("component", "class_key").alias("group_key")
    )
    out = signed.select("_key", "d1", "d2", "n_words").join(grouped, ["d1", "d2"], "left")
    alone = F.col("n_words") == 0
    return (
        out.select("_key", F.when(alone, F.col("_key")).otherwise(F.col("class_key")).alias("class_key"), F.when(alone, F.col("_key")).otherwise(F.col("group_key")).alias("group_key")),
        links,
    )


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and group of every whole document; ``kept`` marks the one document that stands for its group.

    Classes and groups are named by their smallest doc_id (null if none of their rows has one), whatever ids repeat.
    """
    docs = rows.keyed(rows.table(spark, sf_dir, "documents"), "doc_id", "text")
    groups, _ = near_duplicates(docs)
    found = groups.join(docs.select("_key", "_id"), "_key")
    for key, name in (("class_key", "class_id"), ("group_key", "group_id")):
        names = found.groupBy(key).agg(F.min("_id").alias(name))  # one row per class or group, combined before it moves
        found = found.join(names, key)
    return found.select(F.col("_id").alias("doc_id"), "class_id", "group_id", (F.col("_key") == F.col("group_key")).alias("kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id; the columns stay as they are."""
    return without(docs, "doc_id", lambda keyed: near_duplicates(keyed)[0].filter("_key <> group_key").select("_key"))
