"""Vectorised work on many texts at once: bytes, offsets, tokens and span hashes.

A batch of texts is one byte array with offsets. Spans are hashed by prefix sums of
a polynomial modulo 2**64, so the hash of every word, window or n-gram costs a few
array operations however many spans there are. Two spans get one hash only if their
polynomials agree modulo 2**64 (about 3e-20 for a pair).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII characters but letters and digits: what is left are words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.empty(size, np.uint64)
    out[0], filled, step = 1, 1, np.uint64(base)
    while filled < size:  # doubles what is filled; step is base ** filled
        n = min(filled, size - filled)
        out[filled : filled + n] = out[:n] * step
        filled, step = filled + n, step * step if filled + n < size else step
    return out


def powers(base: np.uint64, size: int) -> np.ndarray:
    """base ** 0, 1, 2 ... modulo 2**64."""
    with np.errstate(over="ignore"):
        return _powers(int(base), 1 << max(CHUNK.bit_length(), int(size).bit_length()))[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def token_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words (runs without bytes of ``space``)."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~space[data]
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # words end with their text
    begin[inner], last[inner - 1] = word[inner], word[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the spans, equal for equal bytes wherever they are."""
    with np.errstate(over="ignore"):
        value = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
        return mix(value + np.uint64(0x632BE59BD9B4E019) * (ends - starts).astype(np.uint64))


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashes, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * BASE + hashes[i : i + n]
        return mix(out)


def text_windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window hash, text number) of all runs of ``size`` words within one text, in order."""
    windows = window_hash(hashes, size)
    if not len(windows):
        return windows, np.zeros(0, np.int64)
    same = text[: len(windows)] == text[size - 1 :]
    return windows[same], text[: len(windows)][same]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end index of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(values)]])
