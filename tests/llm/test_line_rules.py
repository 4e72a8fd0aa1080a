import pytest

from checks.compare import compare, connect
from rolecall.llm.line_rules import OP3_SQL, clean, op3_line_rules


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, op3_line_rules, OP3_SQL) is None


@pytest.mark.parametrize(
    ("line", "stands"),
    [
        ("A short line ends well.", True),
        ("A short line without an end", False),
        ("A line of ten words or more needs no full stop", True),
        ("Home | News | Sport.", False),
        ("Save &&& 50 %%% now ### today.", False),
        ("Accept the use of cookies here.", False),
        ("function f() { return; }.", False),
        ("   ", None),
    ],
)
def test_line(spark, line, stands):
    other = "This first line of the text is long enough to stand alone and it ends with a full stop."
    docs = spark.createDataFrame([(1, f"{other}\n{line}")], "doc_id long, text string")
    row = clean(docs, ["doc_id"], with_text=True).first()
    assert row.clean_text == (f"{other}\n{line}" if stands else other)
    assert row.n_lines == (1 if stands is None else 2)


def test_repeats_and_losses(spark):
    line = "one two three four five six seven eight nine ten."
    docs = spark.createDataFrame([(1, f"{line}\n{line}\n{line}"), (2, "w " * 30 + "end."), (3, "a | b | c\n" * 9 + line)], "doc_id long, text string")
    got = {r.doc_id: r for r in clean(docs, ["doc_id"]).collect()}
    assert (got[1].n_dup_lines, got[1].n_repeat_words, got[1].base_failed) == (2, 30, True)
    assert got[2].n_repeat_words == 30 and got[2].base_failed
    assert got[3].kept_words == 10 and not got[3].kept


def test_odd_rows(odd_docs):
    got = clean(odd_docs, ["doc_id", "score"], with_text=True)
    assert got.columns[:2] == ["doc_id", "score"]
    found = got.collect()
    assert len(found) == odd_docs.count()
    empty = [r for r in found if r.doc_id in (3, 4, 5)]
    assert all(r.n_words == 0 and r.base_failed and not r.kept and r.clean_text == "" for r in empty)
    assert next(r for r in found if r.doc_id == 8).word_chars == 300_000
    assert clean(odd_docs.limit(0), ["doc_id"]).count() == 0
