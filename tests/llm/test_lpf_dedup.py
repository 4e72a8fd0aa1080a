from collections import defaultdict
import hashlib
import random

import numpy as np
import pytest

from rolecall.llm import lpf_dedup
from rolecall.llm.lpf_dedup import op4_lpf_dedup, previous_factors, ranks, remove, repeats_stage, smaller

from .conftest import prose


def brute(texts, least, keep):
    seen, hit = {}, defaultdict(set)
    for key in sorted(texts):
        raw = (texts[key] or "").encode()
        for p in range(len(raw) - least + 1):
            s = raw[p : p + least]
            if s in seen:
                hit[key].add(p)
                if keep == "none":
                    hit[seen[s][0]].add(seen[s][1])
            else:
                seen[s] = (key, p)
    out = {}
    for key, text in texts.items():
        raw = (text or "").encode()
        covered = np.zeros(len(raw) + 1, int)
        for p in hit[key]:
            covered[p] += 1
            covered[p + least] -= 1
        covered = np.cumsum(covered)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        rest = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        out[key] = (len(raw), int(covered.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def removed(spark, texts, least, keep):
    docs = spark.createDataFrame(list(texts.items()), "_key long, text string")
    return {r["_key"]: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove(docs, least, keep).collect()}


def corpus(seed):
    draw = random.Random(seed)
    shared = [prose(1000 + i, 40) + " é" for i in range(5)]
    texts = {}
    for key in range(60):
        parts = [prose(seed * 100 + key, draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            piece = draw.choice(shared)
            cut = draw.randint(0, 40)
            parts += [piece[cut : cut + draw.randint(50, 300)], prose(draw.randint(0, 10**6), draw.randint(0, 10))]
        texts[key] = " ".join(parts)
    texts |= {100: texts[7], 101: texts[7], 102: "ab" * 400, 103: "z" * 500, 104: None, 105: "", 106: shared[0]}
    return texts


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("hot", [2048, 1, 3])
def test_every_byte(spark, keep, hot, monkeypatch):
    monkeypatch.setattr(lpf_dedup, "HOT", hot)
    texts = corpus(hot)
    assert removed(spark, texts, 100, keep) == brute(texts, 100, keep)


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(lpf_dedup, "SEGMENT", 3000)
    texts = {1: prose(1, 4000), 2: prose(2, 50), 3: prose(1, 4000)[1234:9876] + prose(4, 900)}
    assert removed(spark, texts, 100, "none") == brute(texts, 100, "none")


def test_suffix_order_and_previous_factors():
    draw = random.Random(4)
    raw = "".join(draw.choice("ab") for _ in range(3000)) + "abab" * 60
    data = np.frombuffer(raw.encode(), np.uint8)
    for least in (8, 20, 75, 130):
        at = np.arange(len(raw) - least + 1)
        rank = ranks(data, least)[at]
        order = np.argsort(rank, kind="stable")
        strings = [raw[i : i + least] for i in order]
        assert strings == sorted(strings)
        later, first = previous_factors(rank, at)
        place = defaultdict(list)
        for i in at:
            place[raw[i : i + least]].append(i)
        assert set(np.flatnonzero(later)) == {i for held in place.values() for i in held[1:]}
        assert set(np.flatnonzero(first)) == {held[0] for held in place.values() if len(held) > 1}


def test_nearest_smaller():
    draw = np.random.default_rng(0)
    for n in (0, 1, 2, 50):
        p = draw.permutation(n)
        want = [max((j for j in range(i) if p[j] < p[i]), default=-1) for i in range(n)]
        assert smaller(p).tolist() == want


def test_stage_and_odd_rows(spark, odd_docs, sf):
    got = op4_lpf_dedup(spark, sf.write("documents", odd_docs))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert got.count() == odd_docs.count()
    base = len(prose(1, 120))
    assert got.filter(f"n_removed = {base}").count() == 4
    stage = repeats_stage(spark, odd_docs, sf)
    assert stage.columns == odd_docs.columns and stage.count() == odd_docs.count()
    texts = [r.text for r in stage.filter("doc_id < 3 or doc_id is null").collect()]
    assert sorted(len(t) for t in texts if t is not None) == [0, 0, 0, base]
    assert stage.filter("text is null").count() == 2
    assert stage.filter("n_chars <> length(text)").count() == 0
    assert repeats_stage(spark, odd_docs.limit(0), sf).count() == 0
