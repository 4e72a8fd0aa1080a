"""Trie of conversations that continue the first turns of another one, by composable fingerprints.

A rebuilt conversation is the head of its base (some first turns) followed by its own turns
after as many. Rebuilt texts are never made: fingerprints are combined instead.

* Every turn has a *reference*: the first stored turn with the same role and text. Turns
  that share a digest are compared by their whole role and text, so references are exact.
* A reference stands for a matrix of determinant one over the integers modulo 2**64, made of 128
  hashed bits. Products of these matrices form a group: the fingerprint of a sequence is
  the product of its turns, ``head * inverse(own head) * own prefix`` is that of a
  rebuilt prefix, and prefixes of a long conversation are combined from those of its parts.
* Prefixes of equal depth and fingerprint are one node if all of them end with the same
  reference and continue the same parent; by induction over the depth they are equal turn by turn. Should a
  node fail that check, the matrices are drawn anew.

Scale: turns are dealt by range of (conversation, order), so a conversation with a third of
all turns lies in many tasks; products of its parts are combined from one row per part. Sums over
subtrees come from the conversations that pass a node: each one has the depth from which it is
the smallest member, and gives that node's bytes and leaf to its own prefixes. Nothing runs level by
level. The ids that end at a node are joined to texts in ranges before one task
hashes them in order, holding one piece at a time.

Defined results: null turns come first; turns with equal numbers are ordered by role, then
by text; null roles and texts are empty; rows without a conversation belong to none;
repeated rows are turns of their own; an empty table has no nodes, not even a root; other
columns have no influence.
"""

from __future__ import annotations

import hashlib
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import ragged, rows
from rolecall.session import staged

#: Bytes of joined ids in one row on their way to the hash.
PIECE = 1 << 16
_KEY = ["depth", "f1", "f2"]
_ONE = "array(1L, 0L, 0L, 1L)"


def elements(reference: np.ndarray, seed: int) -> np.ndarray:
    """Matrices (rows of four numbers) of turn references."""
    r = reference.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        a = ragged.mix(r * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1))
        b = ragged.mix(a ^ ragged.mix(r + np.uint64(0xD1B54A32D192ED03 * (2 * seed + 1) & (1 << 64) - 1)))
        one = np.ones(len(r), np.uint64)
        return np.stack([one + a * b, a, b, one], axis=1)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.stack(
            [
                x[:, 0] * y[:, 0] + x[:, 1] * y[:, 2],
                x[:, 0] * y[:, 1] + x[:, 1] * y[:, 3],
                x[:, 2] * y[:, 0] + x[:, 3] * y[:, 2],
                x[:, 2] * y[:, 1] + x[:, 3] * y[:, 3],
            ],
            axis=1,
        )


def inverse(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.stack([x[:, 3], np.uint64(0) - x[:, 1], np.uint64(0) - x[:, 2], x[:, 0]], axis=1)


def fingerprint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a product."""
    with np.errstate(over="ignore"):
        first = ragged.mix(x[:, 0] + ragged.mix(x[:, 1]))
        second = ragged.mix(x[:, 2] + ragged.mix(x[:, 3] + np.uint64(1)))
        return first.view(np.int64), (second ^ ragged.mix(x[:, 1] + np.uint64(2))).view(np.int64)


def _matrices(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 4)


def _arrow(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).view(np.int64).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(x) + 1, 4, dtype=np.int32)), flat)


def stored_turns(conversations: DataFrame) -> DataFrame:
    """(id, conv, turn, role, text, digest): turns in order, numbered by part and place in it."""
    named = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).filter("conv is not null")
    ordered = named.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    return staged(ordered.withColumns({"id": F.monotonically_increasing_id(), "digest": digest}), "turns")


def _referenced(turns: DataFrame) -> DataFrame:
    """(id, conv, bytes, ref): ``ref`` is the id of the first turn with the same role and text."""
    often = turns.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    again = turns.join(often, "digest", "left_semi").select("id", "digest", "role", "text")
    first = again.groupBy("digest", "role", "text").agg(F.min("id").alias("ref"))
    known = again.join(first, ["digest", "role", "text"]).select("id", "ref")
    plain = turns.select("id", "conv", F.octet_length("text").cast("long").alias("bytes"))
    return staged(plain.join(known, "id", "left").select("id", "conv", "bytes", F.coalesce("ref", "id").alias("ref")), "turn-refs")


def _scan(referenced: DataFrame, seed: int) -> DataFrame:
    """(conv, part, at, ref, bytes, size, product): running place, bytes and product of each conversation inside a part."""

    def work(batches):
        last = None  # (part, conv, at, size, product) of the row before the batch
        for batch in batches:
            if not batch.num_rows:
                continue
            part, _, conv, ref, size = (c.to_numpy() for c in batch.columns)
            n = len(conv)
            new = np.ones(n, bool)
            new[1:] = (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            place = np.arange(n) - first[np.cumsum(new) - 1]
            total = np.cumsum(size)
            total -= (total - size)[first][np.cumsum(new) - 1]
            m, step, far = elements(ref, seed), 1, int(place.max(initial=0))
            while step <= far:  # after each step a row covers twice as many turns
                on = np.flatnonzero(place >= step)
                m[on] = product(m[on - step], m[on])
                step *= 2
            at = place + 1
            if last and last[:2] == (part[0], conv[0]):
                own = np.arange(first[1] if len(first) > 1 else n)
                m[own] = product(np.repeat(last[4][None], len(own), 0), m[own])
                at[own] += last[2]
                total[own] += last[3]
            last = (part[-1], conv[-1], at[-1], total[-1], m[-1])
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (conv, part, at, ref, size, total)), _arrow(m)], ["conv", "part", "at", "ref", "bytes", "size", "product"]
            )

    dealt = referenced.select(F.shiftright("id", 33).alias("part"), "id", "conv", "ref", "bytes").repartition("part").sortWithinPartitions("part", "id")
    return staged(
        dealt.mapInArrow(work, "conv bigint, part bigint, at bigint, ref bigint, bytes bigint, size bigint, product array<bigint>"), "turn-products"
    )


def _whole(scanned: DataFrame) -> DataFrame:
    """``scanned`` with places, bytes and products of whole conversations, also of those that lie in several parts."""
    split = scanned.groupBy("conv").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("conv")
    ends = scanned.join(split, "conv", "left_semi").groupBy("conv", "part").agg(F.max(F.struct("at", "size", "product")).alias("end"))
    ends = ends.select("conv", "part", "end.at", "end.size", "end.product")

    def before(table: pa.Table) -> pa.Table:  # one row per part of one conversation
        table = table.sort_by("part").combine_chunks()
        m = _matrices(table["product"].chunk(0))
        running, out = np.array([[1, 0, 0, 1]], np.uint64), []
        for i in range(len(m)):
            out.append(running[0])
            running = product(running, m[i : i + 1])
        at, size = table["at"].to_numpy(), table["size"].to_numpy()
        return pa.table(
            [table["conv"], table["part"], pa.array(np.cumsum(at) - at), pa.array(np.cumsum(size) - size), _arrow(np.array(out))],
            names=["conv", "part", "at0", "size0", "before"],
        )

    offsets = ends.groupBy("conv").applyInArrow(before, "conv bigint, part bigint, at0 bigint, size0 bigint, before array<bigint>")

    def shift(batches):
        for batch in batches:
            conv, at, ref, size, total, m, head = batch.columns
            yield pa.RecordBatch.from_arrays(
                [conv, at, ref, size, total, _arrow(product(_matrices(head), _matrices(m)))], ["conv", "at", "ref", "bytes", "size", "product"]
            )

    # a part begins or ends few conversations that lie in others as well: at most two rows a part
    joined = scanned.join(F.broadcast(offsets), ["conv", "part"], "left").select(
        "conv",
        (F.col("at") + F.coalesce("at0", F.lit(0))).alias("at"),
        "ref",
        "bytes",
        (F.col("size") + F.coalesce("size0", F.lit(0))).alias("size"),
        "product",
        F.coalesce("before", F.expr(_ONE)).alias("before"),
    )
    return staged(joined.mapInArrow(shift, "conv bigint, at bigint, ref bigint, bytes bigint, size bigint, product array<bigint>"), "turn-prefixes")


def _members(turns: DataFrame, plan: DataFrame, longest: int, seed: int) -> DataFrame:
    """One row per rebuilt conversation and depth, with the fingerprints of its prefix (f1, f2) and of the one before (p1, p2).

    ``pre`` are the prefix's bytes, ``bytes`` those of its last turn, ``last`` tells the whole conversation.
    """
    top = F.struct("at", "ref", "bytes", "size", "product")
    heads = turns.groupBy("conv").agg(
        F.max("at").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("at") <= longest, top))).alias("head"),  # at most ``longest`` turns
    )
    base = heads.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    full = plan.join(heads, "conv").join(base, "base", "left")
    taken = F.least(F.col("h"), F.coalesce(F.size("base_head"), F.lit(0))).cast("int")
    full = full.withColumns({"taken": F.greatest(taken, F.lit(0)), "gone": F.least("h", F.col("n")).cast("int")})
    at = lambda head, k, field, none: f"IF({k} = 0, {none}, element_at({head}, IF({k} = 0, 1, {k})).{field})"
    full = full.select(
        "conv",
        "n",
        "h",
        "taken",
        "base_head",
        (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("whole"),
        F.expr(at("base_head", "taken", "product", _ONE)).alias("x"),
        F.expr(at("base_head", "taken", "size", "0L")).alias("x_size"),
        F.expr(at("head", "gone", "product", _ONE)).alias("y"),
        F.expr(at("head", "gone", "size", "0L")).alias("y_size"),
    )
    convs = staged(full, "rebuilt")
    one = F.expr(_ONE)
    none = [F.lit(None).cast("long").alias("ref"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("pre")]
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), *none, (F.col("whole") == 0).alias("last"), one.alias("x"), one.alias("y"), one.alias("m"))
    lent = convs.filter("taken > 0").select("conv", "whole", F.explode(F.slice("base_head", 1, F.col("taken"))).alias("t"))
    lent = lent.select(
        "conv", F.col("t.at").alias("depth"), "t.ref", "t.bytes", F.col("t.size").alias("pre"), (F.col("t.at") == F.col("whole")).alias("last"),
        one.alias("x"), one.alias("y"), F.col("t.product").alias("m"),
    )
    own = turns.join(convs.filter("n > h").select("conv", "h", "taken", "whole", "x", "x_size", "y", "y_size"), "conv").filter("at > h")
    depth = F.col("taken") + F.col("at") - F.col("h")
    own = own.select(
        "conv", depth.alias("depth"), "ref", "bytes", (F.col("x_size") + F.col("size") - F.col("y_size")).alias("pre"),
        (depth == F.col("whole")).alias("last"), "x", "y", F.col("product").alias("m"),
    )

    def combine(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, m = (_matrices(c) for c in batch.columns[6:])
            ref = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            m = product(product(x, inverse(y)), m)
            f1, f2 = fingerprint(m)
            p1, p2 = fingerprint(product(m, inverse(elements(ref, seed))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *map(pa.array, (f1, f2, p1, p2, ref)), *batch.columns[3:6]],
                ["conv", "depth", "f1", "f2", "p1", "p2", "ref", "bytes", "pre", "last"],
            )

    schema = "conv bigint, depth bigint, f1 bigint, f2 bigint, p1 bigint, p2 bigint, ref bigint, bytes bigint, pre bigint, last boolean"
    return staged(roots.unionByName(lent).unionByName(own).mapInArrow(combine, schema), "members")


def _ends(members: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of the nodes that conversations end at."""

    def pieces(batches):
        for batch in batches:
            depth, f1, f2, conv = (c.to_numpy() for c in batch.columns)
            new = np.ones(len(conv), bool)
            new[1:] = (depth[1:] != depth[:-1]) | (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
            new[:: PIECE // 20] = True  # an id takes up to 20 bytes
            first = np.flatnonzero(new)
            ids = conv.astype(str)
            text = [",".join(ids[a:b]) for a, b in zip(first, np.append(first[1:], len(conv)), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (depth[first], f1[first], f2[first], conv[first])), pa.array(text, pa.string())], names)

    def digest(batches):
        here, state = None, None
        for batch in batches:
            out = []
            for *key, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key == here:
                    state.update(b",")
                else:
                    if here:
                        out.append((*here, state.hexdigest()))
                    here, state = key, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*_KEY, "ends_sha256"])
        if here:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*here, state.hexdigest())], [*_KEY, "ends_sha256"])

    names = [*_KEY, "conv", "ids"]
    ended = members.filter("last").select(*_KEY, "conv").repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    joined = ended.mapInArrow(pieces, "depth bigint, f1 bigint, f2 bigint, conv bigint, ids string")
    dealt = joined.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv")
    return dealt.mapInArrow(digest, "depth bigint, f1 bigint, f2 bigint, ends_sha256 string")


def prefix_tree(turns: DataFrame, plan: DataFrame, longest: int) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.

    ``turns`` come from ``stored_turns``; ``plan`` (conv, base, h) names each conversation's
    base and how many of its first turns take the place of its own, at most ``longest``. A node
    has its smallest member ``conv``, ``depth``, the stored turn ``ref`` that it ends with (-1: root), its
    parent's ``conv`` and the counts of the query below.
    """
    referenced = _referenced(turns)
    for seed in numbers():
        members = _members(_whole(_scan(referenced, seed)), plan, longest, seed)
        bounds = [f(c).alias(f"{c}_{f.__name__}") for c in ("ref", "p1", "p2") for f in (F.min, F.max)]
        nodes = staged(
            members.groupBy(*_KEY).agg(
                F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("pre").alias("pre"), F.max("bytes").alias("bytes"), *bounds
            ),
            "nodes",
        )
        mixed = F.lit(False)
        for c in ("ref", "p1", "p2"):
            mixed = mixed | (F.col(f"{c}_min") != F.col(f"{c}_max"))
        if not nodes.filter(mixed & (F.col("depth") > 0)).limit(1).count():
            break
    nodes = nodes.select(*_KEY, "conv", "n_convs", "pre", "bytes", *[F.col(f"{c}_min").alias(c) for c in ("ref", "p1", "p2")])
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv").alias("parent"))
    below = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    below = below.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_children"))
    tree = staged(nodes.join(above, ["depth", "p1", "p2"], "left").join(below, _KEY, "left").fillna(0, ["n_children"]), "tree")
    # from depth ``since`` on a conversation is the smallest member, i.e. its turns stand for the nodes
    since = tree.groupBy(F.col("conv")).agg(
        F.min("depth").alias("since"), F.min_by(F.col("pre") - F.col("bytes"), "depth").alias("own_from"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf")
    )
    whole = members.filter("last").select("conv", F.col("depth").alias("end"), F.col("pre").alias("total"))
    passing = whole.join(since, "conv", "left").select(
        "conv",
        F.coalesce("since", F.col("end") + 1).alias("since"),
        F.coalesce("own_from", "total").alias("own_from"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    saved = F.when(F.col("since") > F.col("depth"), F.col("own_from") - F.col("pre") + F.col("bytes")).otherwise(0)
    sums = members.select(*_KEY, "conv", "pre", "bytes").join(passing, "conv").groupBy(*_KEY).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens")
    )
    done = tree.join(sums, _KEY).join(_ends(members), _KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return done.select(
        "conv", "depth", "ref", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all conversations, each continuing the first crc32(id) % 9 turns of conversation id - id % 5."""
    turns = stored_turns(rows.table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    plan = turns.select("conv").distinct().select("conv", (conv - conv % 5).alias("base"), (F.crc32(conv.cast("string")) % 9).alias("h"))
    tree = prefix_tree(turns, plan, 8)
    return tree.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


OP13_SQL = """
WITH turns AS (
  SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT c, max(pos) AS n FROM turns GROUP BY c),
heads AS (
  SELECT c, n, c - c % 5 AS b,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)),
           4294967295) % 9 AS h
  FROM ids
), rebuilt AS (
  SELECT h.c, t.pos AS d, t.role, t.text FROM heads h JOIN turns t ON t.c = h.b AND t.pos <= h.h
  UNION ALL
  SELECT h.c, least(h.h, coalesce(i.n, 0)) + t.pos - h.h, t.role, t.text
  FROM heads h JOIN turns t ON t.c = h.c AND t.pos > h.h LEFT JOIN ids i ON i.c = h.b
), lists AS (
  SELECT ids.c, coalesce(list({'role': role, 'text': text} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS l
  FROM ids LEFT JOIN rebuilt r ON r.c = ids.c GROUP BY ids.c
), members AS (
  SELECT c, d, len(l) = d AS ended, l[1:d] AS p, CASE WHEN d > 0 THEN strlen(l[d].text) ELSE 0 END AS bytes
  FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM lists)
), nodes AS (
  SELECT d, p, min(c) AS c, count(*) AS n, max(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '')) AS sha
  FROM members GROUP BY d, p
), kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
tree AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (d, p)),
sums AS (
  SELECT e AS d, p[1:e] AS p, sum(leaf) AS leaves, sum(saved) AS saved
  FROM (SELECT p, CASE WHEN k = 0 THEN 1 ELSE 0 END AS leaf, (n - 1) * bytes AS saved, unnest(range(0, d + 1)) AS e FROM tree) GROUP BY ALL
)
SELECT t.c AS conv_id, t.d AS depth, u.c AS parent_conv_id, t.n AS n_convs, t.k AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, t.sha AS ends_sha256
FROM tree t JOIN sums s ON s.d = t.d AND s.p = t.p LEFT JOIN nodes u ON u.d = t.d - 1 AND u.p = t.p[1:t.d - 1]
"""
