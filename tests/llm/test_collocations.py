import re
from collections import Counter, defaultdict
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolecall.llm import quotient_filter as qf
from rolecall.llm.collocations import collocations, op11_collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        hidden = set()
        for g, a in found.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    if 100 * a >= 80 * f[g[i : i + n]]:
                        hidden.add(g[i : i + n])
        scored = []
        for g, a in found.items():
            if g not in hidden:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), g, a, f[g[:k]], f[g[k:]], score))
        for rank, (_, _, name, _, a, left, right, score) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, name.decode(), a, left, right, totals[lang], score))
    return sorted(out)


def test_phrases_equal_brute_force(spark):
    draw = random.Random(5)
    words = ["New", "york", "the", "ß", "of", "é.", "a,b", "x\tand", "City", " ", "one\x0bcut", "…"]
    docs = [(draw.choice(["en", "de", None, "und"]), " ".join(draw.choices(words, k=draw.randint(0, 60)))) for _ in range(300)]
    docs += [("en", "new york city " * 20 + "."), ("en", None), ("fr", ""), (None, " . \t"), ("en", "in new york city hall")] * 3
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(7)
    for least, top in ((3, 2000), (3, 5), (30, 2000)):
        got = sorted(tuple(r) for r in collocations(frame, least, top).collect())
        assert got == brute(docs, least, top)
    assert brute(docs, 3)


def test_query_on_odd_rows(spark, sf, odd_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    got = op11_collocations(spark, sf.write("documents", odd_docs)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 30)


def test_empty_table(spark, sf, odd_docs):
    assert op11_collocations(spark, sf.write("documents", odd_docs.limit(0))).collect() == []


def test_a_word_counts_in_its_own_language_only(spark):
    docs = [("en", "a b")] * 20 + [("de", "a b")] * 20
    frame = spark.createDataFrame(docs, "lang string, text string")
    assert collocations(frame, 30).collect() == []
    assert [tuple(r)[:4] for r in collocations(frame, 20).orderBy("lang").collect()] == [("de", 1, "a b", 20), ("en", 1, "a b", 20)]


@given(
    bits=st.integers(qf.LEAST_BITS, qf.MOST_BITS),
    prefix=st.integers(0, 12),
    seed=st.integers(0, 2**32),
    size=st.integers(0, 300),
)
@settings(max_examples=60, deadline=None)
def test_filters_give_back_what_went_in(bits, prefix, seed, size):
    draw = np.random.default_rng(seed)
    grams = draw.integers(0, min(1 << bits, draw.choice([3, 1 << 20])), (4, size))
    counts = draw.choice([1, 2, 254, 255, 256, 1 << 40], size)
    top, rest, count = qf.counted(*qf.permute(grams, bits), counts)
    want = Counter()
    for gram, n in zip(grams.T, counts, strict=True):
        want[tuple(int(x) for x in gram)] += int(n)
    bucket = (top >> np.uint64(64 - prefix)).astype(int) if prefix else np.zeros(len(top), int)
    read = []
    for b in np.unique(bucket):
        own = bucket == b
        raw = qf.encode(top[own], rest[own], count[own], bits, prefix)
        read.append(qf.decode(raw, int(b), bits, prefix))
    if read:
        merged = qf.merge(read + read)
        back = qf.restore(merged[0], merged[1], bits)
        assert {tuple(int(x) for x in g): int(n) for g, n in zip(back.T, merged[2], strict=True)} == {k: 2 * v for k, v in want.items()}
    else:
        assert not want


def test_more_words_than_bits_are_refused():
    assert qf.bits_for(1 << 20) == 21
    with pytest.raises(ValueError):
        qf.bits_for(1 << 32)
