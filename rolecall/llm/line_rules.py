"""Line-first cleaning: rules judge each line, failed lines go, and a text that loses too much is rejected.

Lines without a word are not judged and drop out. A line with words fails if it

* ends without terminal punctuation and has fewer than ``short`` words (punctuation);
* has two or more separator words, at least a quarter of its words (navigation);
* holds more than one symbol of ``#*$%&|<>`` per ten word characters (symbols);
* holds a brace, or a stock phrase within ``stock_words`` words or fewer (boilerplate);
* equals an earlier line of the text (repetition).

Defined results: a null text counts as empty and an empty or wordless text fails the
base rules; every row gets one result, repeated rows and null ids included; an empty
table gives no rows; extra columns have no influence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import ragged, rows

SYMBOLS = b"#*$%&|<>"
SEPARATORS = ("|", ">", "»", "·", "•", "/")
TERMINAL = (".", "!", "?", ":", ";", '"', "'", ")", "»", "”", "…", "。", "！", "？")
STOCK = (
    "javascript", "cookie policy", "use of cookies", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "lorem ipsum", "click here", "read more", "sign up", "log in", "subscribe to",
    "share on", "back to top", "skip to content",
)
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    short: int = 10
    stock_words: int = 40
    least_words: int = 20
    repeat_percent: int = 30
    lost_percent: int = 50


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "kept_words"]


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _repeated(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where the same hash occurs again for the same owner, first ones included."""
    mixed = ragged.mix(hashes ^ ragged.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    starts, ends = ragged.runs(mixed[order])
    out = np.zeros(len(hashes), bool)
    out[order] = np.repeat(ends - starts > 1, ends - starts)
    return out


def _later(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where the same hash occurred before for the same owner."""
    mixed = ragged.mix(hashes ^ ragged.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    out = np.ones(len(hashes), bool)
    out[order[ragged.runs(mixed[order])[0]]] = False
    return out


def _ends_well(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ends), bool)
    for mark in TERMINAL:
        raw = mark.encode()
        hit = ends >= len(raw)
        for i, byte in enumerate(raw):
            hit &= data[np.maximum(ends - len(raw) + i, 0)] == byte
        out |= hit
    return out


def inspect(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text (columns ``COUNTS``) and (start, end, text) of the kept lines."""
    n = len(offsets) - 1
    starts, ends, text = ragged.token_spans(data, offsets)
    if not len(starts):
        return np.zeros((len(COUNTS), n), np.int64), starts, ends, text
    per_text = lambda values, owner: np.bincount(owner, values, n).astype(np.int64)
    lead = _sums((data & 0xC0) != 0x80)
    symbol = _sums(_table(SYMBOLS)[data])
    word_chars = lead[ends] - lead[starts]
    sums = ragged.prefix(data)
    words = ragged.span_hash(sums, starts, ends)

    windows, owner = ragged.text_windows(words, text, WINDOW)
    again = np.zeros(len(words) + 1, np.int64)
    if len(windows):
        first = np.flatnonzero(text[: len(words) - WINDOW + 1] == text[WINDOW - 1 :])
        hit = first[_repeated(owner, windows)]
        np.add.at(again, hit, 1)
        np.add.at(again, hit + WINDOW, -1)
    repeats = np.cumsum(again[:-1]) > 0

    feeds = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    line_starts = line_starts[line_starts < len(data)]
    text_ends = offsets[np.searchsorted(offsets, line_starts, "right")]
    line_ends = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, line_starts)], text_ends)
    line_of = np.searchsorted(line_starts, starts, "right") - 1
    held, first_word = np.unique(line_of, return_index=True)
    last_word = np.append(first_word[1:], len(starts)) - 1
    a, b, own = line_starts[held], line_ends[held], text[first_word]
    size = np.bincount(line_of, minlength=len(line_starts))[held]
    chars = np.bincount(line_of, word_chars, len(line_starts))[held]
    later = _later(own, ragged.span_hash(sums, a, b))
    separator = np.zeros(len(starts), bool)
    for mark in SEPARATORS:
        raw = mark.encode()
        hit = ends - starts == len(raw)
        for i, byte in enumerate(raw):
            hit &= data[np.minimum(starts + i, len(data) - 1)] == byte
        separator |= hit
    split = np.bincount(line_of, separator, len(line_starts))[held]
    failed = (size < rules.short) & ~_ends_well(data, ends[last_word])
    failed |= (split >= 2) & (4 * split >= size)
    failed |= (symbol[b] - symbol[a]) * 10 > chars
    brace = _sums(_table(b"{}")[data])
    failed |= brace[b] > brace[a]
    lower, stock = ragged.LOWER[data].tobytes(), np.zeros(len(data) + 1, np.int64)
    for phrase in STOCK:
        raw, at = phrase.encode(), 0
        while (at := lower.find(raw, at)) >= 0:
            stock[at] += 1
            at += 1
    stock = _sums(stock[:-1])
    failed |= (stock[b] > stock[a]) & (size <= rules.stock_words)
    failed |= later
    counts = np.stack(
        [
            per_text(None, text),
            per_text(word_chars, text),
            symbol[offsets[1:]] - symbol[offsets[:-1]],
            per_text(later, own),
            per_text(repeats, text),
            per_text(None, own),
            per_text(failed, own),
            per_text(np.where(failed, 0, size), own),
        ]
    )
    return counts, a[~failed], b[~failed], own[~failed]


def clean(docs: DataFrame, keep: list[str], rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """``keep`` columns of each row with the counts, ``base_failed``, ``kept`` and, if asked for, ``clean_text``."""
    bare = docs.select("text", *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])

    def judge(batches):
        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for first, end, d, o in ragged.chunks(data, offsets):
                counts, a, b, own = inspect(d, o, rules)
                out = [c.slice(first, end - first) for c in batch.columns[1:]] + [pa.array(c) for c in counts]
                if with_text:
                    raw, lines = d.tobytes(), [[] for _ in range(end - first)]
                    for i, j, t in zip(a.tolist(), b.tolist(), own.tolist(), strict=True):
                        lines[t].append(raw[i:j].decode("utf-8", "replace"))
                    out.append(pa.array(["\n".join(x) for x in lines], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[1:], *COUNTS, *["clean_text"] * with_text])

    kinds = dict(bare.dtypes)
    schema = ", ".join([f"_{i} {kinds[f'_{i}']}" for i in range(len(keep))] + [f"{c} bigint" for c in COUNTS] + ["clean_text string"] * with_text)
    base = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    enough = 100 * (F.col("n_words") - F.col("kept_words")) <= rules.lost_percent * F.col("n_words")
    found = bare.mapInArrow(judge, schema)
    names = {f"_{i}": c for i, c in enumerate(keep)}
    return found.select(*[F.col(c).alias(names.get(c, c)) for c in found.columns], base.alias("base_failed"), (~base & enough).alias("kept"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole document."""
    return clean(rows.table(spark, sf_dir, "documents"), ["doc_id"])


WORD = r"[^\x20\x09-\x0D]+"
OP3_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS window_text
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS i FROM docs)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, window_text) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY doc_id
), cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM docs
), lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '{WORD}') AS w,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY n) > 1 AS later FROM cut
), judged AS (
  SELECT doc_id, len(w) AS size, later,
    later
    OR (len(w) < 10 AND NOT regexp_matches(w[-1], '[{"".join(TERMINAL).replace("'", "''")}]$'))
    OR (len(list_filter(w, lambda x: x IN ('{"', '".join(SEPARATORS)}'))) >= 2
        AND 4 * len(list_filter(w, lambda x: x IN ('{"', '".join(SEPARATORS)}'))) >= len(w))
    OR 10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > length(array_to_string(w, ''))
    OR regexp_matches(line, '[{{}}]')
    OR (len(w) <= 40 AND regexp_matches(lower(line), '{"|".join(STOCK)}')) AS failed
  FROM lines WHERE len(w) > 0
), sums AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines, count(*) FILTER (later) AS n_dup_lines,
    coalesce(sum(size) FILTER (NOT failed), 0) AS kept_words FROM judged GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
    CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
  FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN repeats r USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - kept_words) <= 50 * n_words AS kept
FROM counted
"""
