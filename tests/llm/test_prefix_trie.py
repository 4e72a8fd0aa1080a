import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rolecall.llm import prefix_trie as pt
from rolecall.llm.prefix_trie import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, f1 string"


def brute(rows):
    """Nodes as (conv, depth, parent, convs, children, leaves, saved, sha)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        full = tuple(own.get(base, [])[:h] + t[h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
        ends[full].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, held in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(held) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (
            min(held), len(p), min(members[p[:-1]]) if p else -1, len(held), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, held in members.items()
    )


def run(spark, sf, rows, parts=5):
    frame = spark.createDataFrame([(*r, 3, "z") for r in rows], SCHEMA).repartition(parts)
    got = op13_prefix_trie(spark, sf.write("conversations", frame)).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in got)


def test_nodes_equal_brute_force(spark, sf):
    draw = random.Random(3)
    rows = []
    for c in range(-30, 400):
        if draw.random() < 0.9:
            for t in range(draw.randint(1, 12)):
                rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["hi", "é", "go on", f"text {c % 7} {t}"])))
    assert run(spark, sf, rows) == brute(rows)


def test_odd_rows(spark, sf):
    rows = [
        (0, None, "user", "first"), (0, 1, None, None), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"),
        (1, 3, "", ""), (2, 1, "system", "ß" * 100_000), (None, 1, "user", "lost"), (3, 1, "user", "x"), (12, 1, "user", "x"),
        (13, 1, "user", "x"), (-4, 1, "user", "x"), (7, 0, "ab", "c"), (8, 0, "a", "bc"),
    ]
    assert run(spark, sf, rows) == brute(rows)


def test_one_conversation_in_many_parts(spark, sf):
    draw = random.Random(4)
    rows = [(5, t, "user", f"t{draw.randrange(30)}") for t in range(700)]
    rows += [(c, t, "user", f"t{t % 3}") for c in range(60) for t in range(4) if c != 5]
    assert run(spark, sf, rows, 9) == brute(rows)


def test_many_equal_conversations(spark, sf, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 200)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 3000) for t in range(3)]
    assert run(spark, sf, rows) == brute(rows)


def test_empty_table(spark, sf):
    assert run(spark, sf, [], 1) == []


def test_matrices_form_a_group():
    x, y, z = (pt.elements(np.arange(50) * k, 0) for k in (1, 7, 11))
    one = np.tile(np.array([1, 0, 0, 1], np.uint64), (50, 1))
    assert (pt.product(x, pt.inverse(x)) == one).all()
    assert (pt.product(pt.product(x, y), z) == pt.product(x, pt.product(y, z))).all()
    assert (pt.product(x, y)[1:] != pt.product(y, x)[1:]).any(axis=1).all()


def test_equal_fingerprints_of_unlike_turns_draw_new_matrices(spark, sf, monkeypatch):
    plain = pt.elements

    def colliding(reference, seed):
        return plain(reference if seed else reference * 0, seed)

    rows = [(c, t, "user", f"t{c % 3} {t % 2}") for c in range(20) for t in range(3)]
    monkeypatch.setattr(pt, "elements", colliding)
    assert run(spark, sf, rows) == brute(rows)
