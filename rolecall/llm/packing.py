"""Conflict-constrained best-fit packing of texts into sequences of fixed length.

A bin holds no two pieces of one source and no two pieces of one duplicate cluster; clusters
are operator 9's near-duplicate groups, and equal texts where a text has no group. A
text longer than a bin is cut into pieces of full length and one remainder, which go to
bins of their own choice like every other piece.

The pieces are dealt by a hash into shards of about ``shard_rows`` pieces; each shard is
packed on its own, longest pieces first. Open bins are ordered by the room they have
left and carry bitmaps of their sources and clusters; the successor search starts at the
tightest bin that is large enough and goes on until it meets a compatible one, and a new
bin is opened only if there is none.

Defined results: texts without a word (null, empty) take no room and are not packed; a
null source conflicts with nothing; repeated rows are of one cluster and so go to
different bins; null ids are packed like others; an empty table gives no rows; extra
columns have no influence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import ragged, rows
from rolecall.llm.bagminhash import near_duplicates


class Bins:
    """Open bins of one shard by room left; each class of equal room and sources is a list."""

    def __init__(self, capacity: int, sources: int):
        self.classes: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        # per source and room: bins with that room and without that source; the last row is for pieces of no source
        self.free = np.zeros((sources + 1, capacity + 1), np.int32)
        self.without = np.ones(sources + 1, np.int32)
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _count(self, bin_no: int, change: int) -> None:
        held, column = self.sources[bin_no], self.free[:, self.room[bin_no]]
        column += change
        while held:
            low = held & -held
            column[low.bit_length() - 1] -= change
            held ^= low

    def _drop(self, bin_no: int) -> None:
        group = self.classes[self.room[bin_no]]
        listed = group[self.sources[bin_no]]
        listed.remove(bin_no)
        if not listed:
            del group[self.sources[bin_no]]
        self._count(bin_no, -1)

    def _add(self, bin_no: int) -> None:
        if self.room[bin_no]:
            self.classes[self.room[bin_no]].setdefault(self.sources[bin_no], []).append(bin_no)
            self._count(bin_no, 1)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; ``source`` -1: none, ``cluster``: bit of its cluster, 0 if it is alone."""
        bit = 1 << source if source >= 0 else 0
        for room in size + np.flatnonzero(self.free[source, size:]):
            for held, listed in self.classes[room].items():
                if held & bit:
                    continue
                chosen = next((b for b in reversed(listed) if not self.clusters[b] & cluster), None)
                if chosen is not None:
                    self._drop(chosen)
                    return self._put(chosen, size, bit, cluster)
        self.room.append(self.free.shape[1] - 1)
        self.sources.append(0)
        self.clusters.append(0)
        return self._put(len(self.room) - 1, size, bit, cluster)

    def _put(self, chosen: int, size: int, bit: int, cluster: int) -> tuple[int, int]:
        offset = self.free.shape[1] - 1 - self.room[chosen]
        self.room[chosen] -= size
        self.sources[chosen] |= bit
        self.clusters[chosen] |= cluster
        self._add(chosen)
        return chosen, offset


def pack_shard(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bin number and offset of each piece of one shard."""
    pieces = pieces.sort_values(["size", "_key", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    codes, names = pd.factorize(pieces["source"])  # null: -1
    # clusters of one piece can't conflict; the others get a bit each
    groups, _ = pd.factorize(pieces["cluster"])
    repeated = np.bincount(groups, minlength=1) > 1
    bit_of = np.cumsum(repeated) - 1
    bins = Bins(capacity, len(names))
    placed = [
        bins.place(size, code, 1 << int(bit_of[g]) if repeated[g] else 0)
        for size, code, g in zip(pieces["size"].tolist(), codes.tolist(), groups.tolist(), strict=True)
    ]
    pieces["bin"], pieces["offset"] = [p[0] for p in placed], [p[1] for p in placed]
    return pieces


def pieces(source: DataFrame, capacity: int, groups: DataFrame | None = None) -> DataFrame:
    """(_key, _id, source, cluster, piece, size) of every text with words of ``source`` (_key, _id, source, text).

    The cluster is the text's group in ``groups`` (_key, group_key), else a hash of its words.
    """

    def measure(batches):
        for batch in batches:
            data, offsets = ragged.texts(batch.column(3))
            for first, end, d, o in ragged.chunks(data, offsets):
                lower = ragged.LOWER[d]
                starts, ends, text = ragged.token_spans(lower, o)
                n = np.bincount(text, minlength=end - first)
                words = ragged.span_hash(ragged.prefix(lower), starts, ends)
                cut = np.searchsorted(text, np.arange(end - first + 1))
                place = (np.arange(len(words)) - cut[text]).astype(np.uint64)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(ragged.mix(words + ragged.mix(place)), dtype=np.uint64)])
                cluster = (sums[cut[1:]] - sums[cut[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(first, end - first) for c in batch.columns[:3]] + [pa.array(cluster), pa.array(n)],
                    ["_key", "_id", "source", "cluster", "n"],
                )

    kinds = dict(source.dtypes)
    found = source.select("_key", "_id", "source", "text").mapInArrow(
        measure, f"_key bigint, _id {kinds['_id']}, source {kinds['source']}, cluster bigint, n bigint"
    )
    if groups is not None:
        cluster = F.coalesce(F.xxhash64("group_key"), "cluster")
        found = found.join(groups.select("_key", "group_key"), "_key", "left").withColumn("cluster", cluster).drop("group_key")
    last = F.floor((F.col("n") - 1) / capacity)
    cut = F.sequence(F.lit(0).cast("long"), last.cast("long"))
    return (
        found.filter("n > 0")
        .select("_key", "_id", "source", "cluster", "n", F.explode(cut).alias("piece"))
        .withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity))
        .drop("n")
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    capacity: int = 2048,
    shard_rows: int = 8000,
    source_col: str = "source",
    near: bool = True,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``size`` in words, ``shard``, ``bin`` of the shard and ``offset`` in the bin.

    Clusters are the near-duplicate groups of operator 9, or with ``near=False`` equal texts.
    """
    source = rows.keyed(docs.select(F.col(id_col).alias("_row"), "text", F.col(source_col).alias("source")), "_row", "source", "text")
    found = pieces(source, capacity, near_duplicates(source.select("_key", "text"))[0] if near else None)
    # as many shards as the input as read needs, whatever the sizes of the pieces
    n = docs.count()
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("_key", "piece"), F.lit(rows.shards(n, shard_rows))))
    kind = dict(found.dtypes)["_id"]

    def pack_one(part: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(part, capacity)[["_id", "piece", "size", "shard", "bin", "offset"]]

    return (
        dealt.groupBy("shard")
        .applyInPandas(pack_one, f"_id {kind}, piece bigint, size bigint, shard bigint, bin bigint, offset bigint")
        .withColumnRenamed("_id", id_col)
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 words."""
    return pack(rows.table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of the documents left by the earlier stages, one of each near-duplicate group."""
    return pack(docs, near=False)
