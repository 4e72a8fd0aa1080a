"""Embedding near duplicates by spherical-cap filters with structured random product codes.

A filter is a direction; a vector belongs to every filter whose direction it meets with at
least a threshold. Directions are product codes: in each of several random rotations the
coordinates are cut into blocks, each block has a list of random codewords, and every
combination of codewords is a direction. *List decoding* walks the blocks with bounds on what the
remaining ones can still add, so a vector finds all its filters without looking at the
others.

The threshold follows from the number of vectors: a cap holds about ``BUCKET`` of them if
they are spread evenly. The number of filters follows from the chance that two vectors at
the wanted cosine fall into one cap: such a pair shares ``SHARED`` filters on average, and
closer ones more. Both chances are those of caps on the sphere.

Equal vectors are one class before anything is searched. Classes join on filters; inside a
filter all cosines are computed in double precision. A linked pair counts only in the first
filter that its two classes share (each class brings its list of filters), so nothing but sums and one
label per class leaves a filter. A filter with more than ``SPLIT`` classes is cut into blocks, and
each pair of blocks is a task's group of its own.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing; vectors of different lengths don't link. Repeated ids count
as vectors of their own; a component is named by the smallest id in it, null if no member
has an id. An empty table gives no rows; other columns have no influence.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import rows
from rolecall.llm.components import components
from rolecall.session import staged

#: Classes a filter is planned for, and above which it is cut into blocks.
BUCKET, SPLIT = 64, 1024
#: Filters that two vectors at the wanted cosine share on average.
SHARED = 20
ROTATIONS = 32
#: Codewords of a block; more combinations need more blocks.
CODEWORDS = 256
#: Shorter vectors are filled with zeros, which leaves cosines as they are.
LEAST_SIZE = 8
SEED = 20011


def _density(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in (-1, 1) and the share of a sphere's points with such a coordinate."""
    x = (np.arange(20_000) + 0.5) / 10_000 - 1
    y = np.exp((size - 3) / 2 * np.log1p(-x * x))
    return x, y / y.sum()


def cap(size: int, share: float) -> float:
    """Threshold of a cap that holds ``share`` of a sphere in ``size`` dimensions."""
    x, y = _density(size)
    above = np.cumsum(y[::-1])[::-1]
    return float(np.interp(-math.log(share), -np.log(np.maximum(above, 1e-300)), x))


def both_in(size: int, cosine: float, least: float) -> float:
    """Chance that two points at ``cosine`` lie in one random cap of threshold ``least``."""
    x, y = _density(size)
    z, w = _density(size - 1)
    tail = np.cumsum(w[::-1])[::-1]
    on = x >= least
    need = (least - cosine * x[on]) / np.sqrt((1 - cosine**2) * (1 - x[on] ** 2))
    return float((y[on] * np.interp(need, z, tail, left=1.0, right=0.0)).sum())


def plan(count: int, size: int, cosine: float) -> tuple[float, int, int, int]:
    """(threshold, rotations, blocks, codewords) for ``count`` vectors of ``size`` components."""
    size = max(size, LEAST_SIZE)
    least = cap(size, min(0.5, BUCKET / max(1, count)))
    filters = SHARED / both_in(size, cosine, least)
    blocks = 2
    while filters / ROTATIONS > CODEWORDS**blocks and blocks < size:
        blocks += 1
    words = max(2, math.ceil((filters / ROTATIONS) ** (1 / blocks)))
    return least, math.ceil(filters / words**blocks), blocks, words


@lru_cache(maxsize=4)
def _codes(size: int, rotations: int, blocks: int, words: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Rotation and codewords by block; each block's codewords have the length that its share of the coordinates asks for."""
    out = []
    for i in range(rotations):
        draw = np.random.default_rng([SEED, size, i])
        turn, _ = np.linalg.qr(draw.standard_normal((size, size)))
        code = []
        for part in np.array_split(np.arange(size), blocks):
            c = draw.standard_normal((words, len(part)))
            code.append(c * (math.sqrt(len(part) / size) / np.linalg.norm(c, axis=1, keepdims=True)))
        out.append((turn, code))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, filled up to ``LEAST_SIZE``; no row is zero. Scaled first, so that squares stay finite."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, max(0, LEAST_SIZE - x.shape[1]))))


def decode(x: np.ndarray, least: float, rotations: int, blocks: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that the unit vectors ``x`` belong to."""
    found = []
    n = np.arange(len(x))
    for number, (turn, code) in enumerate(_codes(x.shape[1], rotations, blocks, words)):
        y = x @ turn
        edge = np.cumsum([0] + [c.shape[1] for c in code])
        products = [y[:, a:b] @ c.T for a, b, c in zip(edge[:-1], edge[1:], code, strict=True)]
        still = np.zeros((blocks + 1, len(x)))  # most that the blocks from here on can add
        for j in reversed(range(blocks)):
            still[j] = still[j + 1] + products[j].max(axis=1)
        row, total, name = n, np.zeros(len(x)), np.full(len(x), number, np.int64)
        for j, p in enumerate(products):
            order = np.argsort(-p, axis=1)
            flat = (8.0 * n[:, None] - np.take_along_axis(p, order, axis=1)).reshape(-1)  # ascending; rows are 8 apart
            need = np.clip(least - total - still[j + 1][row], -3, 3)
            count = np.searchsorted(flat, 8.0 * row - need, "right") - row * words
            again = np.repeat(np.arange(len(row)), count)
            word = order[row[again], np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)]
            row, total, name = row[again], total[again] + p[row[again], word], name[again] * words + word
        found.append((row, name))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: str) -> F.Column:
    """True for vectors that can link: finite, and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _members(classes: DataFrame, cosine: float) -> DataFrame:
    """``classes`` (class, copies, vector) with ``filters``, the ordered filters of each among those of its length."""
    counts = classes.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    plans = {r["size"]: plan(r.n, r["size"], cosine) for r in counts.collect()}  # one row per length of a vector

    def work(batches):
        for batch in batches:
            vectors = batch.column(2)
            x = unit(_matrix(vectors))
            size = len(vectors[0])
            row, name = decode(x, *plans[size])
            order = np.lexsort((name, row))
            edges = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
            filters = pa.ListArray.from_arrays(pa.array(edges), pa.array(name[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns, filters], ["class", "copies", "vector", "filters"])

    def same_length(batches):
        for batch in batches:
            length = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(length):
                if size in plans:
                    own = batch.filter(pa.array(length == size))
                    for at in range(0, own.num_rows, 1024):
                        yield from work([own.slice(at, 1024)])

    kind = dict(classes.dtypes)["vector"]
    return classes.select("class", "copies", "vector").mapInArrow(
        same_length, f"class bigint, copies bigint, vector {kind}, filters array<bigint>"
    )


def _met_before(lists: list[np.ndarray], here: int) -> np.ndarray:
    """Which of the lists of filters share one before ``here``."""
    early = [x[: np.searchsorted(x, here)] for x in lists]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in early])
    met = np.zeros((len(lists), len(lists)), bool)
    names, column, held = np.unique(np.concatenate(early) if early else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    several = np.flatnonzero(held > 1)
    for at in range(0, len(several), 1024):
        own = several[at : at + 1024]
        place = np.full(len(names), -1)
        place[own] = np.arange(len(own))
        some = place[column] >= 0
        holds = np.zeros((len(lists), len(own)), np.float32)
        holds[row[some], place[column][some]] = 1
        met |= holds @ holds.T > 0
    return met


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row connected with each row of a symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root, len(root)).min(axis=1, initial=len(root)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _count(table: pa.Table, cosine: float) -> pa.Table:
    """(class, links, root) of the classes that link inside one filter, or one pair of its blocks."""
    here, i, j = (table[c][0].as_py() for c in ("filter", "i", "j"))
    number, copies = table["class"].to_numpy(), table["copies"].to_numpy()
    x = unit(_matrix(table["vector"]))
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if i != j:
        block = table["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    linked = linked[np.ix_(some, some)]
    filters = table["filters"].combine_chunks()
    new = linked & ~_met_before([filters[int(k)].values.to_numpy() for k in some], here)
    order = np.argsort(number[some], kind="stable")  # the root is the smallest class
    root = np.empty(len(some), np.int64)
    root[order] = number[some][order][_roots(linked[np.ix_(order, order)])]
    return pa.table([pa.array(number[some]), pa.array(new @ copies[some]), pa.array(root)], names=["class", "links", "root"])


def linked_classes(classes: DataFrame, cosine: float) -> DataFrame:
    """(class, links, component) of the classes (class, copies, vector) that link with another one."""
    members = staged(_members(classes, cosine), "filters")
    size = F.size("vector").alias("size")
    each = members.select("class", "copies", "vector", "filters", size, F.explode("filters").alias("filter"))
    sizes = each.select("size", "filter").groupBy("size", "filter").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.filter("n > 1").select("size", "filter", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts"))
    placed = each.join(staged(parts, "filter-sizes"), ["size", "filter"]).withColumn("block", F.pmod("class", "parts").cast("int"))
    # a class of a cut filter goes to every pair of blocks that holds its own
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "size", "filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "copies", "vector", "filters"
    )
    found = staged(
        dealt.groupBy("size", "filter", "i", "j").applyInArrow(lambda table: _count(table, cosine), "class bigint, links bigint, root bigint"),
        "links",
    )
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.filter("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")).distinct()
    return links.join(components(edges), F.col("node") == F.col("class")).select("class", "links", "component")


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors`` (id, vector); links are cosines of at least ``cosine``."""
    good = vectors.filter(usable("vector"))
    alone = vectors.filter(~usable("vector"))
    classes = good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    linked = staged(linked_classes(classes, cosine), "linked-classes")
    named = classes.select("class", "low").join(linked, "class").groupBy("component").agg(F.min("low").alias("name"))
    told = classes.join(linked.join(named, "component"), "class", "left").select(
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("name")).alias("component_id"),
    )
    joined = good.join(told, "vector").select("id", "n_links", "component_id")
    rest = alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op12_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept rows of all embeddings at a cosine of 0.9, whatever their labels."""
    vectors = rows.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return near_vectors(vectors, 0.9).withColumnRenamed("id", "vec_id")


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       vec_id <= coalesce(low.b, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
