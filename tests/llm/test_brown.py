import math
import random
import zlib
from collections import Counter

import numpy as np

from rolecall.llm import brown
from rolecall.llm.brown import op2_brown


def corpus(n, seed=1):
    """Two tongues: words follow words of their own kind, nouns follow articles."""
    draw = random.Random(seed)
    tongues = [(["the", "a"], [f"noun{i}" for i in range(40)]), (["der", "ein"], [f"wort{i}" for i in range(40)])]
    out = []
    for i in range(n):
        first, second = tongues[i % 2]
        out.append(" ".join(w for _ in range(draw.randint(3, 25)) for w in (draw.choice(first), draw.choice(second))))
    return out


def tokens(text):
    return [*(text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_base_and_better_than_base(spark, make_docs, sf):
    rows = [(i, t, "en", "s") for i, t in enumerate(corpus(150))]
    rows += [(1000, None, "en", "s"), (1001, "", None, None), (None, rows[0][1], "en", "s"), (3, rows[3][1], "en", "s"), (1002, "Unseen WORDS only", "en", "s")]
    found = op2_brown(spark, sf.write("documents", make_docs(rows))).collect()
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6))
        for i, t, *_ in rows
    )
    assert sorted((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert {r.train_tokens for r in found} == {n}
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def fitted(spark, texts, head=None, monkeypatch=None, **options):
    """(model, word -> (count, class), transitions, scores by text number) of ``texts``, all of which train."""
    if head:
        monkeypatch.setattr(brown, "HEAD", head)
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "_key long, text string, trains boolean").repartition(5)
    known = brown.vocabulary(docs.select("text"), 8)
    model, classed = brown.fit(docs.select("text"), known, 8, **options)
    scores, steps = brown.score(docs, classed, model, 8)
    by_hash = {}
    for r in classed.collect():
        words, counts, held = (np.frombuffer(x, k) for x, k in ((r.words, np.uint64), (r.counts, np.int64), (r.classes, np.uint8)))
        by_hash |= {int(w): (int(n), int(c)) for w, n, c in zip(words, counts, held, strict=True)}
    return model, by_hash, steps, {r["_key"]: r for r in scores.collect()}


def hash_of(*words):
    hashes, _, endings = brown.split(*brown.ragged.texts(brown.pa.array([b" ".join(words).decode()])))
    return hashes.tolist(), endings


def test_probabilities_sum_to_one(spark, monkeypatch):
    for head in (None, 30):
        texts = corpus(80)
        model, known, steps, _ = fitted(spark, texts, head, monkeypatch, rounds=3, classes=8)
        assert np.allclose((10**steps).sum(axis=1), 1)
        assert len(known) == len({w for t in texts for w in t.split()})
        total = np.zeros(9)
        for count, c in known.values():
            total[c] += (count + 0.5) / 10 ** model.emission_base[c]
        total[:8] += 0.5 / 10 ** model.emission_base[:8]  # the unseen word
        assert np.allclose(total[:8], 1)


def test_exchange_separates_kinds(spark, monkeypatch):
    for head in (None, 160):  # types of their own; some of them words that move in the vocabulary
        _, known, _, _ = fitted(spark, corpus(200), head, monkeypatch, classes=16)
        members = {}
        for group in (["the", "a"], [f"noun{i}" for i in range(40)], ["der", "ein"], [f"wort{i}" for i in range(40)]):
            for word in hash_of(*(w.encode() for w in group))[0]:
                members.setdefault(known[word][1], Counter())[group[0]] += 1
        assert sum(max(m.values()) for m in members.values()) >= 0.95 * 84


def test_words_take_the_class_that_fits_their_neighbours(spark, monkeypatch):
    """Brute force over every occurrence of every word that is no type of its own."""
    monkeypatch.setattr(brown, "HEAD", 25)
    texts = corpus(120)
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known = brown.vocabulary(train, 8)
    words = brown.frequent(known, sum(len(tokens(t)) for t in texts))
    found = brown.exchange(brown.streams(train, words), words, 4, 8)
    classed = brown.word_classes(train, known, words, found, 8)
    often = set(words.hashes.tolist())
    assert 0 < len(often) < 40
    fit = {}
    for text in texts:
        hashes, endings = hash_of(*tokens(text)[:-1])
        types = brown.types_of(np.array(hashes, np.uint64), endings, words)[0]
        c = [8, *found.class_of[types].tolist(), 8]
        for i, h in enumerate(hashes):
            if h not in often:
                fit[h] = fit.get(h, 0) + found.follow[:, c[i + 2]] + found.lead[:, c[i]]
    got = {}
    for r in classed.collect():
        got |= dict(zip(np.frombuffer(r.words, np.uint64).tolist(), np.frombuffer(r.classes, np.uint8).tolist(), strict=True))
    assert fit and set(got) == set(fit) | often
    for h, values in fit.items():
        assert values[got[h]] >= values.max() - 1e-9
    for h, c in zip(words.hashes.tolist(), found.class_of[brown.TAIL : -1].tolist(), strict=True):
        assert got[h] == c


def test_scores_equal_brute_force(spark, monkeypatch):
    texts = [*corpus(60), "unheard Of", "", "the unheard noun3 der"]
    monkeypatch.setattr(brown, "HEAD", 20)
    rows = [(i, t, i % 4 != 1 and i < 60) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "_key long, text string, trains boolean").repartition(4)
    train = docs.filter("trains").select("text")
    known = brown.vocabulary(train, 8)
    model, classed = brown.fit(train, known, 8, rounds=3, classes=6)
    scores, steps = brown.score(docs, classed, model, 8)
    words = {}
    for r in classed.collect():
        columns = (np.frombuffer(x, k).tolist() for x, k in ((r.words, np.uint64), (r.counts, np.int64), (r.classes, np.uint8)))
        words |= {w: (n, c) for w, n, c in zip(*columns, strict=True)}
    moves = np.zeros((7, 7))
    streams = {}
    for i, text, trains in rows:
        hashes, endings = hash_of(*tokens(text)[:-1]) if text else ([], [])
        own = [(*words.get(h, (0, int(model.class_of[e]))),) for h, e in zip(hashes, endings, strict=True)]
        streams[i] = own
        chain = [6, *(c for _, c in own), 6]
        if trains:
            for a, b in zip(chain, chain[1:], strict=False):
                moves[a, b] += 1
    want = np.log10(moves + 0.5) - np.log10(moves.sum(axis=1, keepdims=True) + 3.5)
    assert np.allclose(steps, want)
    n_words = Counter(c for _, c in words.values())
    n_tokens = Counter()
    for n, c in words.values():
        n_tokens[c] += n
    for r in scores.collect():
        own = streams[r["_key"]]
        chain = [6, *(c for _, c in own), 6]
        total = sum(want[a, b] for a, b in zip(chain, chain[1:], strict=False))
        total += sum(math.log10((n + 0.5) / (n_tokens[c] + 0.5 * (n_words[c] + 1))) for n, c in own)
        assert abs(total - r.score) < 1e-6
        assert r.n_known == sum(n > 0 for n, _ in own) + 1


def test_odd_rows(spark, odd_docs, sf):
    got = op2_brown(spark, sf.write("documents", odd_docs))
    assert got.count() == odd_docs.count()
    assert got.filter("score is null or isnan(score) or score > 0").count() == 0
    assert got.filter("doc_id in (3, 4, 5) and n_tokens <> 1").count() == 0


def test_no_training_rows_and_no_rows(spark, make_docs, tmp_path):
    only = next(i for i in range(100) if held(i))
    make_docs([(only, "some words", "en", "s")]).write.parquet(f"{tmp_path}/a/documents.parquet")
    row = op2_brown(spark, f"{tmp_path}/a").first()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3) and row.score <= 0
    make_docs([]).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op2_brown(spark, f"{tmp_path}/b").count() == 0
