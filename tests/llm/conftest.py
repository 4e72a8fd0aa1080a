import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, words int, score string, bucket string, n int"


def prose(seed: int, words: int, alphabet: str = "abcdefghij") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(alphabet, k=draw.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def build(rows):
        full = [(i, t, lang, src, None if t is None else len(t), "k", 1, "s", "b", 0) for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empties, repeated rows and ids, ties, a very long text and clashing columns."""
    base = prose(1, 120)
    return make_docs(
        [
            (1, base, "en", "a"),
            (2, base, "en", "a"),
            (2, base, "en", "a"),
            (None, base, "en", None),
            (None, None, None, None),
            (3, None, "en", "b"),
            (4, "", "en", "b"),
            (5, " \t\n ", None, "b"),
            (6, "one", "en", "c"),
            (7, prose(2, 30_000), "en", "c"),
            (8, "x" * 300_000, "fr", "c"),
            (9, "…¿é ß" * 40, "fr", None),
        ]
    )


@pytest.fixture
def sf(tmp_path):
    """A folder of tables; write(name, frame) adds one."""

    class Folder(str):
        def write(self, name, frame):
            frame.write.parquet(f"{self}/{name}.parquet")
            return self

    return Folder(tmp_path)
