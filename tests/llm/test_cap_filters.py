import math

import numpy as np
import pytest

from rolecall.llm import cap_filters as cf
from rolecall.llm.cap_filters import near_vectors, op12_cap_filters


def brute(vectors, cosine=0.9):
    """id -> (links, component, kept) for unique ids."""
    good = {}
    for i, v in vectors.items():
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            good[i] = x / np.linalg.norm(x)
    links = {i: set() for i in vectors}
    for a, x in good.items():
        for b, y in good.items():
            if a != b and len(x) == len(y) and x @ y >= cosine:
                links[a].add(b)
    out = {}
    for i in sorted(vectors):
        if i not in out:
            reach, new = {i}, [i]
            while new:
                new = [b for a in new for b in links[a] if b not in reach and not reach.add(b)]
            out.update({k: (len(links[k]), i, k == i) for k in reach})
    return out


def found(frame, **options):
    return {r.id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame, **options).collect()}


def families(seed, size, centres, members, noise):
    draw = np.random.default_rng(seed)
    out = []
    for c in draw.standard_normal((centres, size)):
        out += [c + noise * draw.standard_normal(size) for _ in range(members)]
    return [[float(np.float32(v)) for v in x] for x in out]


def test_links_equal_brute_force(spark):
    vectors = dict(enumerate(families(1, 48, 30, 20, 0.3) + families(2, 48, 1, 150, 0.05)))
    vectors |= {2000 + i: v for i, v in enumerate(families(3, 5, 20, 10, 0.2))}
    vectors |= {3000: [1.0], 3001: [2.5], 3002: [-1.0], 3003: [1e-40, 0.0], 3004: [3e38, 0.0]}
    vectors |= {4000 + i: vectors[7] for i in range(40)}
    vectors |= {5000: None, 5001: [], 5002: [0.0] * 48, 5003: [None] * 48, 5004: [math.nan] * 48, 5005: [math.inf] + [0.0] * 47, 5006: None}
    frame = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>").repartition(6)
    assert found(frame) == brute(vectors)


def test_cut_filters_lose_and_repeat_nothing(spark, monkeypatch):
    monkeypatch.setattr(cf, "SPLIT", 16)
    vectors = dict(enumerate(families(4, 24, 3, 60, 0.25) + families(5, 24, 1, 90, 0.05)))
    frame = spark.createDataFrame(list(vectors.items()), "id long, vector array<float>")
    assert found(frame) == brute(vectors)


@pytest.mark.parametrize("count", [2, 3_000, 1_000_000])
def test_recall_at_the_very_threshold(count):
    """Pairs at the wanted cosine itself, by the filters planned for ``count`` vectors."""
    draw, size, n = np.random.default_rng(6), 64, 4_000
    x = draw.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = draw.standard_normal((n, size))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    plan = cf.plan(count, size, 0.9)
    held = [[set() for _ in range(n)] for _ in range(2)]
    for own, vectors in zip(held, (x, y), strict=True):
        for at in range(0, n, 1000):
            for r, f in zip(*cf.decode(vectors[at : at + 1000], *plan), strict=True):
                own[at + r].add(f)
    shared = np.array([len(a & b) for a, b in zip(*held, strict=True)])
    assert abs(shared.mean() - cf.SHARED) < 0.3 * cf.SHARED
    assert (shared > 0).mean() >= 0.999


def test_decoding_finds_all_directions():
    x = cf.unit(np.random.default_rng(7).standard_normal((50, 12)))
    least, rotations, blocks, words = 0.3, 3, 3, 5
    want = set()
    for number, (turn, code) in enumerate(cf._codes(12, rotations, blocks, words)):
        for name in range(words**blocks):
            picked = np.concatenate([code[0][name // 25], code[1][name // 5 % 5], code[2][name % 5]])
            assert abs(np.linalg.norm(picked) - 1) < 1e-9
            want |= {(int(r), number * 125 + name) for r in np.flatnonzero(x @ turn @ picked >= least)}
    assert want == {(int(r), int(f)) for r, f in zip(*cf.decode(x, least, rotations, blocks, words), strict=True)}


def test_repeated_and_null_ids_and_clashing_columns(spark, sf):
    v = [0.1, 0.9, 0.3]
    rows = [(2, v, 1, "k"), (2, v, 1, "k"), (None, v, None, None), (5, [-1.0, 0.0, 0.0], 1, "x"), (None, None, 1, "y")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class int, filter string")
    got = sorted(op12_cap_filters(spark, sf.write("embeddings", frame)).collect(), key=lambda r: (r.vec_id or -1, r.n_links))
    assert [tuple(r) for r in got] == [(None, 0, None, True), (None, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (5, 0, 5, True)]


def test_empty_table(spark, sf):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    out = op12_cap_filters(spark, sf.write("embeddings", frame))
    assert out.collect() == [] and out.columns == ["vec_id", "n_links", "component_id", "kept"]
