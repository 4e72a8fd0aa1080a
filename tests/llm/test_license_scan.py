import numpy as np
import pytest

from rolecall.llm import linear
from rolecall.llm.license_scan import (
    STEP,
    TEMPLATES,
    UNKNOWN,
    WINDOW,
    background,
    example,
    fit,
    runs_of,
    scan,
    sentence_words,
    windows,
)

from .conftest import prose


@pytest.fixture(scope="module")
def scanner(make_docs):
    return fit(make_docs([(i, "\n".join(prose(i * 50 + j, 25) for j in range(6)), "en", "s") for i in range(60)]))


def test_each_template_is_found(make_docs, scanner):
    notices = [(name, s) for name, group in TEMPLATES.items() for s in group if len(s.split()) > 3]
    docs = make_docs([(i, f"{prose(i, 30)}\n\n{s}\n{prose(i + 500, 30)}", "en", "s") for i, (_, s) in enumerate(notices)])
    got = {r.doc_id: r for r in scan(docs, scanner, ["doc_id"]).collect()}
    right = [got[i].family == name and got[i].paragraph == 2 for i, (name, _) in enumerate(notices) if i in got]
    assert len(got) == len(notices) and sum(right) >= 0.9 * len(notices)


def test_changed_wording_and_unknown(make_docs, scanner):
    docs = make_docs(
        [
            (1, "This work, too, is licensed under the GNU General Public License, version 3 or later.", "en", "s"),
            (2, "This work is licensed under the Strange Seas License, version 7.", "en", "s"),
            (3, prose(77, 40), "en", "s"),
        ]
    )
    got = {r.doc_id: r.family for r in scan(docs, scanner, ["doc_id"]).collect()}
    assert got == {1: "GPL", 2: UNKNOWN}


def test_odd_rows(odd_docs, make_docs, scanner):
    assert scan(odd_docs, scanner, ["doc_id"]).count() == 0
    line = TEMPLATES["MIT"][0]
    rows = [(None, line, None, None), (1, line, "en", "s"), (1, line, "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (4, prose(5, 20_000) + "\n" + line, "en", "s")]
    found = scan(make_docs(rows), scanner, ["doc_id", "score"]).drop("score")
    assert sorted((r.doc_id or 0, r.family) for r in found.collect()) == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (4, "MIT")]
    assert fit(odd_docs.limit(0)).classes == scanner.classes


def test_headings(make_docs, scanner):
    lines = {1: "MIT License", 2: "GPLv3", 3: "CC0", 4: "# Apache License", 5: "Mit und.", 6: "License", 7: "GPLv3 x", 8: "mit"}
    got = scan(make_docs([(i, f"{prose(i, 20)}\n{x}\n{prose(i + 50, 20)}", "en", "s") for i, x in lines.items()]), scanner, ["doc_id"])
    assert {r.doc_id: (r.family, r.paragraph) for r in got.collect()} == {1: ("MIT", 1), 2: ("GPL", 1), 3: ("CC0", 1), 4: ("Apache-2.0", 1)}


@pytest.mark.parametrize("ahead", [0, 60, 250, 480])
def test_a_notice_inside_a_long_paragraph(make_docs, scanner, ahead):
    notices = {1: ("GPL", TEMPLATES["GPL"][0]), 2: ("MIT", TEMPLATES["MIT"][2]), 3: ("BSD", TEMPLATES["BSD"][1]), 4: ("Apache-2.0", TEMPLATES["Apache-2.0"][1])}
    docs = make_docs([(i, f"{prose(i, ahead)} {x} {prose(i + 50, 500 - ahead)}", "en", "s") for i, (_, x) in notices.items()] + [(9, prose(99, 600), "en", "s")])
    assert {r.doc_id: r.family for r in scan(docs, scanner, ["doc_id"]).collect()} == {i: name for i, (name, _) in notices.items()}


def test_windows_cover_every_word_half_a_window_deep():
    for size in (1, 95, 96, 97, 144, 145, 500):
        words = np.arange(size, dtype=np.uint64)
        held, own, of = windows(words, np.zeros(size, np.int64), 1)
        spans = [held[own == i] for i in range(len(of))]
        assert all((np.diff(x) == 1).all() and len(x) == min(size, WINDOW) for x in spans)
        for a in range(max(0, size - STEP) + 1):
            piece = set(range(a, min(size, a + STEP)))
            assert any(piece <= set(x.tolist()) for x in spans)
    held, own, of = windows(np.arange(5, dtype=np.uint64), np.array([0, 0, 2, 2, 2]), 3)
    assert of.tolist() == [0, 2] and own.tolist() == [0, 0, 1, 1, 1]


def test_families_equal_brute_force(make_docs, scanner):
    """Every window of every line by itself, without the bound that skips most of them."""
    texts = {i: "\n".join([prose(i, 30), draw_notice(i), prose(i + 900, 150)]) for i in range(40)}
    want = {}
    for i, text in texts.items():
        for number, line in enumerate(text.split("\n")):
            words = sentence_words(line)
            best = None
            for at in {min(a, max(0, len(words) - WINDOW)) for a in range(0, max(1, len(words)), STEP)}:
                mine = words[at : at + WINDOW]
                f, x = example(mine)
                p = linear.softmax((x @ scanner.weights[f] + scanner.weights[-1]) / scanner.temperature)
                if p[0] < scanner.least and (best is None or p[0] < best[0]):
                    k = 1 + int(p[1:].argmax())
                    name = scanner.classes[k]
                    share = max(np.isin(t, runs_of(mine)).mean() for t in scanner.templates[name]) if k > 1 else 0
                    if k > 1 and (p[k] < scanner.least or share < scanner.overlap):
                        name = UNKNOWN
                    if name != UNKNOWN or len(mine) > 2 and (share > 0 or k == 1 and p[k] >= scanner.least):
                        best = (p[0], name)
            if best:
                want[i, number] = best[1]
    got = scan(make_docs([(i, t, "en", "s") for i, t in texts.items()]), scanner, ["doc_id"]).collect()
    assert {(r.doc_id, r.paragraph): r.family for r in got} == want and len(want) >= 30


def draw_notice(i):
    group = [s for group in TEMPLATES.values() for s in group]
    words = group[i % len(group)].split()
    return " ".join([*prose(i + 300, i % 5).split(), *words[: len(words) - i % 2], *prose(i + 600, 7 * (i % 30)).split()])


def test_the_sample_is_bounded_and_the_same_in_any_layout(make_docs):
    docs = make_docs([(i, "\n".join(prose(i * 9 + j, 40 + 60 * j) for j in range(4)), "en", "s") for i in range(100)])
    one, other = background(docs.repartition(1), 50), background(docs.repartition(7), 50)
    assert len(one) <= 50 and sorted(w.tobytes() for w in one) == sorted(w.tobytes() for w in other)
    assert max(map(len, one)) <= WINDOW
