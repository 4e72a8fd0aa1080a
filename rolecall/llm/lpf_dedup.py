"""Repeated passages by longest-previous-factor arrays over suffixes that may repeat.

A passage repeats if a string of ``least`` bytes starts at two places. Suffixes that can
repeat are found first, and only they are sorted:

1. every ``least``-byte string chooses its anchor, the ``GRAM``-byte gram in it with the
   smallest hash (the leftmost of equals). Neighbouring strings mostly choose the same
   anchor; such a run is a *piece*. Equal strings have equal anchors at equal distance,
   so all copies of a string lie in pieces of one anchor hash;
2. pieces with equal bytes are one class, found by hash (anchor and piece, 128 bits);
   in a class of several pieces every string repeats and no bytes need to be read;
3. anchors with several classes send one piece per class to one place. There the
   suffixes are sorted by rank doubling, and the previous and next smaller positions in
   suffix order give each suffix's longest match with an earlier position, its previous
   factor. Where it reaches ``least`` bytes the string is a later copy, and its match is
   a first copy;
4. an anchor with more than ``HOT`` classes is split: its classes are dealt by a hash,
   sorted in parts, and only the strings that are first in their part meet again, by the
   hash of the string. No place ever holds more than ``HOT`` classes of an anchor or one
   string from each part.

Positions are ordered by key, then by place in the text. ``keep="first"`` removes every
byte covered by a later copy and keeps the first; ``keep="none"`` removes first copies as
well. Matches never cross texts. Strings are judged on the input.

Defined results: a null text is empty (its ``kept_text`` stays null); shorter texts keep all bytes; repeated rows are
texts of their own, as are rows with null ids; an empty table gives no rows; extra
columns have no influence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import ragged, rows
from rolecall.llm.keep import numbered
from rolecall.session import staged

GRAM = 64
HOT = 2048
#: Bytes of one segment; longer texts are read in overlapping segments.
SEGMENT = 1 << 20
POSITION_BITS = 22
#: Bytes of pieces sorted at once, beyond which the next anchor starts a new block.
BLOCK = 1 << 19


def segments(data: np.ndarray, offsets: np.ndarray, least: int):
    """(text, place of the segment in it, bytes, offsets) with texts cut so that every string is in one segment."""
    size = np.diff(offsets)
    for first, end, d, o in ragged.chunks(data, offsets, SEGMENT):
        if end - first == 1 and size[first] > SEGMENT:
            for at in range(0, max(1, len(d) - least + 1), SEGMENT):
                part = d[at : at + SEGMENT + least - 1]
                yield np.array([first]), np.array([at]), part, np.array([0, len(part)])
        else:
            yield np.arange(first, end), np.zeros(end - first, np.int64), d, o


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of ``width`` values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    table = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(table, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, offsets: np.ndarray, least: int):
    """(text, start, strings, anchor hash, piece hash) of the pieces of a batch of texts; starts are in the batch."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, none, none
    sums = ragged.prefix(data)
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        value = sums[GRAM:] - sums[:n]
        value *= ragged.powers(ragged.INVERSE, n)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    best = sliding_min((value & ~mask) | np.arange(n, dtype=np.uint64), least - GRAM + 1)
    size = np.maximum(np.diff(offsets) - least + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + offsets[text]
    anchor = (best[at] & mask).astype(np.int64)
    starts, ends = ragged.runs(anchor)
    first, count = at[starts], ends - starts
    whole = ragged.span_hash(sums, first, first + count + least - 1)
    return text[starts], first, count, ragged.mix(value[anchor[starts]]).view(np.int64), whole.view(np.int64)


def fold(text: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, whole: np.ndarray):
    """The same with ``times``: equal pieces in a row, as a repeated character or line gives, are one entry."""
    new = np.ones(len(text), bool)
    for x in (text, n, anchor, whole):
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~(new[1:] & (start[1:] == start[:-1] + n[:-1]))
    first = np.flatnonzero(new)
    return *(x[first] for x in (text, start, n, anchor, whole)), np.diff(np.append(first, len(text)))


def piece_rows(docs: DataFrame, least: int) -> DataFrame:
    """(anchor, piece, _key, start, n, times) of every piece of ``docs`` (_key, text); ``times`` equal ones follow each other."""

    def work(batches):
        for batch in batches:
            data, offsets = ragged.texts(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for own, base, d, o in segments(data, offsets, least):
                text, start, count, anchor, whole, times = fold(*pieces(d, o, least))
                yield pa.RecordBatch.from_arrays(
                    [
                        *map(pa.array, (anchor, whole, keys[own[text]], start - o[text] + base[text])),
                        pa.array(count.astype(np.int32)),
                        pa.array(times.astype(np.int32)),
                    ],
                    ["anchor", "piece", "_key", "start", "n", "times"],
                )

    return docs.select("_key", "text").mapInArrow(work, "anchor bigint, piece bigint, _key bigint, start bigint, n int, times int")


def ranks(data: np.ndarray, least: int) -> np.ndarray:
    """Rank of the ``least`` bytes from each place, in byte order; the places need that many bytes ahead of them.

    Ranks of 8 bytes are tripled (three ranks of up to 21 bits fit one key) until they
    cover ``least``; the last step overlaps.
    """
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    covered = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])).astype(np.uint64)
        if covered >= least:
            return rank.astype(np.int64)
        bits = np.uint64(int(n).bit_length())
        far = [min(covered, least - covered), min(2 * covered, least - covered)]
        key = rank
        for shift in far if int(bits) <= 21 else far[:1]:
            key = (key << bits) | np.concatenate([rank[shift:], np.zeros(min(shift, n), np.uint64)])[:n]
        covered = min(least, covered * (3 if int(bits) <= 21 else 2))


def smaller(position: np.ndarray) -> np.ndarray:
    """For each entry the nearest earlier entry with a smaller value, -1 if there is none."""
    out = np.arange(len(position)) - 1
    on = np.arange(len(position))
    while len(on := on[(out[on] >= 0) & (position[out[on]] > position[on])]):
        out[on] = out[out[on]]
    return out


def previous_factors(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, first): suffixes with an earlier copy, and suffixes that only have later ones.

    ``rank`` orders the suffixes by their first bytes, equal ranks being copies;
    ``position`` is their place in the corpus. An earlier copy, if there is one, is the
    previous or the next smaller position in suffix order.
    """
    order = np.argsort(rank, kind="stable")
    r, p = rank[order], position[order]
    before = smaller(p)
    after = len(p) - 1 - smaller(p[::-1])[::-1]
    later, first = np.zeros(len(p), bool), np.zeros(len(p), bool)
    for near in (before, after):
        at = np.flatnonzero((near >= 0) & (near < len(p)))
        at = at[r[near[at]] == r[at]]
        later[at] = True
        first[near[at]] = True
    out_later, out_first = np.zeros(len(p), bool), np.zeros(len(p), bool)
    out_later[order], out_first[order] = later, first & ~later
    return out_later, out_first


def sort_block(block: list[tuple], least: int):
    """Runs of repeating strings of the pieces of whole anchors.

    ``block``: (anchor, part, parts, key, start, strings, bytes). Gives rows (key, start,
    strings, kind) with kind 2 for later and 1 for first copies, and for parted anchors,
    whose firsts are not settled, rows (anchor, parts, string hash, key, start, kind) with
    kind 0 for strings without a copy in their part.
    """
    raw = np.frombuffer(b"".join(x[6] for x in block), np.uint8)
    length = np.array([len(x[6]) for x in block])
    count = np.array([x[5] for x in block])
    base = np.cumsum(length) - length
    piece = np.repeat(np.arange(len(block)), count)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    at = base[piece] + inner
    key, start = np.array([x[3] for x in block]), np.array([x[4] for x in block])
    place = start[piece] + inner
    position = np.empty(len(piece), np.int64)
    position[np.lexsort((place, key[piece]))] = np.arange(len(piece))
    later, first = previous_factors(ranks(raw, least)[at], position)
    parted = np.array([x[1] >= 0 for x in block])[piece]
    kind = np.where(later, 2, np.where(first, 1, 0))
    settled = np.where(parted & (kind < 2), 0, kind)
    edge = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (settled[1:] != settled[:-1])]))
    end = np.append(edge[1:], len(piece))
    some = settled[edge] > 0
    edge, end = edge[some], end[some]
    runs = (key[piece[edge]], place[edge], end - edge, settled[edge])
    again = np.flatnonzero(parted & (kind < 2))
    sums = ragged.prefix(raw)
    strings = ragged.span_hash(sums, at[again], at[again] + least).view(np.int64)
    anchor, parts = np.array([x[0] for x in block], np.int64), np.array([x[2] for x in block])
    return runs, (anchor[piece[again]], parts[piece[again]], strings, key[piece[again]], place[again], kind[again])


def copies(docs: DataFrame, least: int) -> DataFrame:
    """(_key, start, n, kind): runs of strings that repeat in ``docs`` (_key, text); kind 2: later, 1: first copies."""
    all_pieces = staged(piece_rows(docs, least), "pieces")
    met = all_pieces.groupBy("anchor").agg(F.sum("times").alias("k")).filter("k > 1").select("anchor")
    shared = staged(all_pieces.join(met, "anchor", "left_semi"), "shared-pieces")
    classes = staged(
        shared.groupBy("anchor", "piece").agg(F.sum("times").alias("copies"), F.min(F.struct("_key", "start")).alias("at"), F.max("n").alias("n")),
        "piece-classes",
    )
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    # members of a class of several pieces: all strings repeat, and all but the first piece's are later copies
    many = classes.filter("copies > 1").select("anchor", "piece", "at")
    told = shared.join(many, ["anchor", "piece"])
    is_first = (F.col("_key") == F.col("at._key")) & (F.col("start") == F.col("at.start"))
    covered = (F.col("n") * F.col("times")).alias("n")
    first = told.filter(is_first).select("_key", "start", "n", F.lit(1).alias("kind"))
    after = told.filter(is_first & (F.col("times") > 1)).select(
        "_key", (F.col("start") + F.col("n")).alias("start"), (F.col("n") * (F.col("times") - 1)).alias("n"), F.lit(2).alias("kind")
    )
    members = told.filter(~is_first).select("_key", "start", covered, F.lit(2).alias("kind")).unionByName(first).unionByName(after)

    parts = F.ceil(F.col("k") / HOT).cast("int")
    part = F.when(parts > 1, F.pmod("piece", parts)).otherwise(F.lit(-1)).cast("int").alias("part")
    asked = classes.join(several, "anchor").select("anchor", part, parts.alias("parts"), F.col("at._key").alias("_key"), F.col("at.start").alias("start"), "n")
    by_text = asked.groupBy("_key").agg(F.collect_list(F.struct("anchor", "part", "parts", "start", "n")).alias("wanted"))  # at most one text's pieces

    def cut(batches):
        for batch in batches:
            for key, text, wanted in zip(*batch.columns, strict=True):
                raw = text.as_py().encode()
                own = [(w["anchor"], w["part"], w["parts"], key.as_py(), w["start"], w["n"], raw[w["start"] : w["start"] + w["n"] + least - 1]) for w in wanted.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*own, strict=True)], ["anchor", "part", "parts", "_key", "start", "n", "bytes"])

    sent = docs.select("_key", "text").join(by_text, "_key").mapInArrow(cut, "anchor bigint, part bigint, parts bigint, _key bigint, start bigint, n bigint, bytes binary")

    def sort(batches):
        block, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > BLOCK and row[:2] != last:
                    yield from found(block)
                    block, size = [], 0
                block.append(row)
                size, last = size + len(row[6]), row[:2]
        if block:
            yield from found(block)

    def found(block):
        (key, start, n, kind), again = sort_block(block, least)
        none = [None] * len(key)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(start), pa.array(n), pa.array(kind.astype(np.int32)), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary())],
            names,
        )
        # strings that are first in their part go to the bucket of their hash, packed: an anchor has as many buckets as parts
        anchor, parts, string = again[:3]
        bucket = (string.view(np.uint64) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
        order = np.lexsort((bucket, anchor))
        edges = np.flatnonzero((np.diff(anchor[order]) != 0) | (np.diff(bucket[order]) != 0)) + 1
        for at in np.split(order, edges) if len(order) else []:
            packed = np.stack([x[at].astype(np.int64) for x in again[2:]]).tobytes()
            yield pa.RecordBatch.from_pylist([{"anchor": int(anchor[at[0]]), "bucket": int(bucket[at[0]]), "packed": packed}], schema=arrow)

    def settle(table: pa.Table) -> pa.Table:
        """Runs of the strings of one bucket of a parted anchor: at most one row per string and part comes in."""
        string, key, start, kind = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for x in table["packed"]], axis=1)
        order = np.lexsort((start, key, string))
        string, key, start, kind = (x[order] for x in (string, key, start, kind))
        a, b = ragged.runs(string)
        kind = np.where(np.repeat(b - a, b - a) > 1, 2, kind)
        kind[a] = np.where(b - a > 1, 1, kind[a])
        some = np.flatnonzero(kind > 0)
        some = some[np.lexsort((start[some], key[some], kind[some]))]
        key, start, kind = key[some], start[some], kind[some]
        new = np.ones(len(some), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(kind) != 0) | (np.diff(start) != 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(some)))
        return pa.table([pa.array(key[first]), pa.array(start[first]), pa.array(n), pa.array(kind[first].astype(np.int32))], names=names[:4])

    names = ["_key", "start", "n", "kind", "anchor", "bucket", "packed"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    arrow = pa.schema(list(zip(names, types, strict=True)))
    run = "_key bigint, start bigint, n bigint, kind int"
    dealt = sent.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    sorted_runs = staged(dealt.mapInArrow(sort, f"{run}, anchor bigint, bucket bigint, packed binary"), "runs")
    settled = sorted_runs.filter("packed is null").select("_key", "start", "n", "kind")
    merged = sorted_runs.filter("packed is not null").select("anchor", "bucket", "packed").groupBy("anchor", "bucket").applyInArrow(settle, run)
    return settled.unionByName(members).unionByName(merged)


def remove(docs: DataFrame, least: int = 400, keep: str = "first", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs`` (_key, text) with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept_text``.

    ``spans`` lists the removed byte ranges; ``carry`` names further columns of ``docs`` to
    return. In ``kept_text`` characters that lost some of their bytes are gone as a whole.
    """
    if keep not in ("first", "none"):
        raise ValueError(keep)
    # a string's first copy may be listed both by its class and by the sort: any later mark counts, as it covers the same bytes
    runs = copies(docs, least).filter(F.col("kind") >= (2 if keep == "first" else 1)).select("_key", "start", "n")
    by_text = runs.groupBy("_key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # at most one text's runs
    joined = docs.select("_key", "text", *carry).join(by_text, "_key", "left").select("text", "runs", "_key", *carry)

    def cut(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                spans: list[list[int]] = []
                for s, n in sorted((w["start"], w["n"]) for w in wanted.as_py() or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s + n - 1 + least)
                    else:
                        spans.append([s, s + n - 1 + least])
                left, at = [], 0
                for a, b in spans:
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                rest = b"".join(left)
                kept = b"".join(x.decode("utf-8", "ignore").encode() for x in left).decode()
                out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), kept if text.is_valid else None, spans))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                batch.columns[2:] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["_key", *carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"],
            )

    kinds = dict(docs.dtypes)
    schema = "_key bigint, " + "".join(f"`{c}` {kinds[c]}, " for c in carry)
    return joined.mapInArrow(cut, schema + "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string, spans array<array<bigint>>")


def op4_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without the bytes covered by repeating 400-byte strings, first copies included.

    ``kept_text`` is what is left of the text.
    """
    docs = rows.keyed(rows.table(spark, sf_dir, "documents"), "doc_id", "text")
    found = remove(docs, 400, "none", ("_id",))
    return found.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: int = 256) -> DataFrame:
    """All documents, their texts without later copies of passages of ``least`` bytes; ``n_chars`` follows the text."""
    named, name = numbered(docs, "doc_id")
    renamed = {c: f"_{i}" for i, c in enumerate(named.columns) if c != "text"}
    flat = named.select(F.col(name).cast("long").alias("_key"), "text", *[F.col(c).alias(n) for c, n in renamed.items()])
    found = remove(flat, least, "first", tuple(renamed.values()))
    out = {c: F.col(n) for c, n in renamed.items()} | {"text": F.col("kept_text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(out["n_chars"])
    return found.select(*[out[c].alias(c) for c in docs.columns])
