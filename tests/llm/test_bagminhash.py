from collections import Counter, defaultdict
from itertools import combinations
import random

import numpy as np
import pytest

from rolecall.llm import bagminhash as bm
from rolecall.llm import ragged
from rolecall.llm.bagminhash import near_duplicate_stage, near_duplicates, op9_bagminhash

from .conftest import prose


def words_of(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()


def brute(texts, threshold=0.8):
    """Groups as key -> smallest key, from all pairs that share a shingle."""
    bags, holders = {}, defaultdict(list)
    for key, text in texts.items():
        w = words_of(text)
        bags[key] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        for s in bags[key]:
            holders[s].append(key)
    pairs = {p for held in holders.values() for p in combinations(sorted(held), 2)}
    same = defaultdict(list)
    for key, text in texts.items():
        if words_of(text):
            same[tuple(words_of(text))].append(key)
    links = [(a, b) for a, b in pairs if (bags[a] & bags[b]).total() >= threshold * (bags[a] | bags[b]).total()]
    links += [(held[0], other) for held in same.values() for other in held[1:]]
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {k: find(k) for k in texts}


def groups(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "_key long, text string")
    return {r["_key"]: r.group_key for r in near_duplicates(docs)[0].collect()}


def edited(text, changes, seed):
    draw, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("top", [1, 3, 40])
def test_registers_agree_with_the_weighted_similarity(top):
    draw = np.random.default_rng(top)
    hashes = ragged.mix(draw.integers(0, 2**62, 120).astype(np.uint64))
    a = draw.integers(0, top + 1, 120)
    b = np.where(draw.random(120) < 0.7, a, draw.integers(0, top + 1, 120))
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for rep in range(60):
        h = ragged.mix(hashes + np.uint64(rep))
        x, y = (bm.signatures(h[w > 0], np.zeros((w > 0).sum(), int), w[w > 0], 1) for w in (a, b))
        got.append((x == y).mean())
    assert abs(np.mean(got) - true) < 4 * np.std(got) / 60**0.5


def test_groups_equal_all_pairs(spark):
    texts, key = {}, 0
    for family in range(12):
        base = prose(family, 90 + 20 * family)
        for copy in range(family + 1):
            texts[key] = edited(base, copy % 5, key) if copy % 3 else base
            key += 1
    texts |= {1000 + i: prose(500 + i, 60) for i in range(40)}
    assert groups(spark, texts) == brute(texts)


def test_a_large_family_meets_through_its_original(spark):
    base = prose(9, 200)
    texts = {i: edited(base, 3, i) for i in range(1, 260)} | {0: base}
    # copies of copies, which the original doesn't reach
    texts |= {500 + i: edited(texts[i], 3, 1000 + i) for i in range(1, 40)}
    want, got = brute(texts), groups(spark, texts)
    assert np.mean([want[k] == got[k] for k in texts]) > 0.99


def chains(seed, size):
    """A base, copies of it, and copies of these that are mostly unlike the base and each other."""
    base = prose(seed, 200)
    first = [edited(base, 4, 10_000 * seed + i) for i in range(size)]
    return [base, *first, *(edited(text, 4, 10_000 * seed + 5000 + i) for i, text in enumerate(first))]


def test_copies_of_copies_meet_in_large_buckets(spark):
    texts = dict(enumerate(chains(21, 150)))
    assert groups(spark, texts) == brute(texts)


def test_every_bucket_is_settled_however_many_families_it_holds(spark):
    base = prose(31, 200)
    heads = [edited(base, 8, i) for i in range(6)]  # share buckets, but are no near copies
    texts = {}
    for family, head in enumerate(heads):
        first = [edited(head, 4, 100 * family + i) for i in range(16)]
        second = [edited(text, 4, 5000 + 100 * family + i) for i, text in enumerate(first)]
        texts |= {1000 * family + i: text for i, text in enumerate([*first, *second])}
    assert groups(spark, texts) == brute(texts)


def test_weights_count(spark):
    run = prose(3, 6)
    texts = {1: " ".join([run] * 10), 2: " ".join([run] * 11), 3: " ".join([run] * 40)}
    assert groups(spark, texts) == brute(texts) == {1: 1, 2: 1, 3: 3}


def test_odd_rows_and_stage(spark, odd_docs, sf):
    got = op9_bagminhash(spark, sf.write("documents", odd_docs))
    assert got.count() == odd_docs.count()
    worded = got.filter("doc_id not in (3, 4, 5) or doc_id is null")
    assert worded.filter("kept").count() == 6  # 1, 6, 7, 8, 9 and the null text, which is near to nothing
    assert got.filter("doc_id in (3, 4, 5) and kept").count() == 3
    kept = near_duplicate_stage(spark, odd_docs, sf)
    assert kept.columns == odd_docs.columns
    assert kept.count() == got.filter("kept").count()
    assert near_duplicate_stage(spark, odd_docs.limit(0), sf).count() == 0


def test_hot_ends_and_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(bm, "HOT_PAIRS", 5)
    base = prose(1, 120)
    texts = {i: edited(base, 1, i) for i in range(60)} | {100 + i: edited(prose(2, 60), i % 2, i) for i in range(30)}
    texts |= {200 + i: prose(500 + i, 40) for i in range(30)}
    assert groups(spark, texts) == brute(texts)
