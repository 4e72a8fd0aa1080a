import numpy as np

from rolecall.llm import ragged
from rolecall.llm.toxicity import BEGINNINGS, LOG_BITS, TERMS, fit, op5_toxicity, score

from .conftest import prose


def corpus(make_docs, spark):
    bad = [w for words in TERMS.values() for w in words]
    rows, marks = [], []
    for i in range(240):
        toxic = i % 4 == 0
        text = prose(i, 60, "klmnopqrst")
        if toxic:
            text += f" you {bad[i % len(bad)]} and {bad[(i * 7) % len(bad)]}, {prose(i + 999, 20)}"
        rows.append((i, text, "en", "s"))
        if i % 3:
            marks.append((i, i % 5 and 1, int(toxic)))
    return make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_unlabelled_documents(spark, make_docs):
    docs, labels = corpus(make_docs, spark)
    chain = fit(docs, labels)
    assert chain.categories == ["low_quality", *TERMS, "toxic"]
    got = {r.doc_id: r for r in score(docs, chain, ["doc_id"]).collect()}
    unseen = [i for i in got if i % 3 == 0]
    assert np.mean([got[i].toxic == (i % 4 == 0) for i in unseen]) > 0.95
    assert not any(got[i].toxic for i in unseen if i % 4)


def test_chain_uses_earlier_probabilities(spark, make_docs):
    docs, labels = corpus(make_docs, spark)
    weights = fit(docs, labels).weights
    links = weights[-1 - weights.shape[1] : -1]
    assert np.abs(np.triu(links, 1)).sum() > 0
    assert np.abs(np.tril(links)).sum() == 0


def test_odd_rows(spark, odd_docs, make_docs, sf):
    marks = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, 0), (None, 1, 1), (99, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = op5_toxicity(spark, sf.write("documents", odd_docs).write("labels", marks))
    assert got.count() == odd_docs.count()
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    assert fit(odd_docs, marks.limit(0)) is None
    none = score(odd_docs, None, ["doc_id"])
    assert none.columns == got.columns and none.filter("toxic").count() == 0
    assert score(odd_docs.limit(0), fit(odd_docs, marks), ["doc_id"]).count() == 0


def test_scores_equal_brute_force(spark, make_docs):
    """The chain of each text by itself, link after link, over plain words and their beginnings."""
    docs, labels = corpus(make_docs, spark)
    chain = fit(docs, labels)
    words, links, base = np.split(chain.weights.astype(float), [1 << LOG_BITS, (1 << LOG_BITS) + 5])
    punctuation = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
    hash_of = lambda w, n: int(ragged.span_hash(ragged.prefix(w), np.array([0]), np.array([len(w)]))[0]) * (2 * n + 1) % (1 << 64) >> (64 - LOG_BITS)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    checked = 0
    for r in score(docs.withColumn("copy", docs["text"]), chain, ["copy"]).collect()[:40]:
        found = set()
        for word in r["copy"].lower().translate(punctuation).split():
            for n in (0, *BEGINNINGS):
                if not n or len(word) > n:
                    found.add(hash_of(np.frombuffer((word[:n] if n else word).encode(), np.uint8), n))
        p = []
        for k in range(5):
            p.append(sigmoid(base[0, k] + sum(words[f, k] for f in found) + sum(a * b for a, b in zip(p, links[:k, k], strict=True))))
        assert np.allclose(p, [r[f"p_{c}"] for c in chain.categories], atol=1e-5)
        checked += r.toxic
    assert checked
