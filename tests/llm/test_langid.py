import random

import numpy as np
from pyspark.sql import functions as F

from rolecall.llm import langid
from rolecall.llm.langid import UNKNOWN, fit, language_stage, op7_langid, predict


def sentences(alphabet, n, seed):
    draw = random.Random(seed)
    return [" ".join("".join(draw.choices(alphabet, k=draw.randint(2, 6))) for _ in range(40)) for _ in range(n)]


def test_held_out_accuracy(spark, make_docs, sf):
    rows = [(i, t, "aa", "s") for i, t in enumerate(sentences("abcde", 60, 1))]
    rows += [(100 + i, t, "bb", "s") for i, t in enumerate(sentences("efghi", 60, 2))]
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 34 !?", "bb", "s"), (None, rows[0][1], None, "s"), (0, rows[0][1], "aa", "s")]
    sf.write("documents", make_docs(rows))
    got = op7_langid(spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows[:120]}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert held and all(r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1 for r in held)
    for r in found:
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == (UNKNOWN, 0.0)
        if r.doc_id is None:
            assert r.lang_pred == "aa"


def test_no_labels_and_no_rows(make_docs):
    docs = make_docs([(1, "some text", None, "s"), (2, None, None, "s")])
    assert fit(docs) is None
    assert {r.lang_pred for r in predict(docs, None, ["doc_id"]).collect()} == {UNKNOWN}
    assert predict(docs.limit(0), fit(docs.limit(0)), ["doc_id"]).count() == 0


def test_odd_rows(spark, odd_docs):
    model = fit(odd_docs)
    got = predict(odd_docs, model, ["doc_id"])
    assert got.count() == odd_docs.count()
    assert {r.lang_pred for r in got.filter("doc_id in (3, 4, 5)").collect()} == {UNKNOWN}
    kept = language_stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    assert kept.filter(F.col("text").isNull() | (F.trim("text") == "")).count() == 0
    assert kept.filter("doc_id = 2").count() == 2


def test_features_of_a_batch_equal_those_of_each_text():
    import pyarrow as pa

    from rolecall.llm import ragged

    texts = ["Änne", "", "ab", "x", "abcabc É"]
    data, offsets = ragged.texts(pa.array(texts))
    whole = list(langid.text_features(data, offsets, (1, 2, 3), 16))
    for text, (features, counts) in zip(texts, whole, strict=True):
        alone = next(iter(langid.text_features(*ragged.texts(pa.array([text])), (1, 2, 3), 16)))
        assert features.tolist() == alone[0].tolist() and counts.tolist() == alone[1].tolist()
        assert counts.sum() == sum(max(0, len(text) - n + 1) for n in (1, 2, 3))


def test_the_stage_rejects_letter_junk_and_keeps_clean_texts(spark, make_docs):
    rows = [(i, t, "aa", "s") for i, t in enumerate(sentences("abcde", 200, 1))]
    rows += [(1000 + i, t, "bb", "s") for i, t in enumerate(sentences("efghi", 200, 2))]
    rows += [(2000 + i, " ".join(t.split()[:3]), "aa", "s") for i, t in enumerate(sentences("abcde", 40, 3))]
    junk = [(9000 + i, t, None, "s") for i, t in enumerate(sentences("uvwxyz", 50, 4))]
    kept = {r.doc_id for r in language_stage(spark, make_docs(rows + junk), "").collect()}
    assert not {i for i in kept if i >= 9000}
    assert len(kept) >= 0.99 * len(rows)


def test_scores_equal_brute_force(spark, make_docs):
    """Probabilities of each text by itself from counts of its n-grams."""
    docs = make_docs([(i, t, "ab"[i % 2] * 2, "s") for i, t in enumerate(sentences("abcdé", 40, 5))] + [(77, "É a", "aa", "s")])
    model = fit(docs)
    for r in predict(docs, model, ["doc_id", "text"]).collect():
        (f, c), = langid.text_features(*langid.ragged.texts(langid.pa.array([r.text])), model.orders, model.log_bits)
        x = (1 + np.log(c)) * model.idf[f]
        x = x / np.sqrt((x * x).sum())
        z = (x @ model.weights[f] + model.weights[-1]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-5
