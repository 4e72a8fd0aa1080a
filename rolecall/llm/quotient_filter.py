"""Counting quotient filters over packed word-id n-grams, exact because the whole remainder is kept.

An n-gram of one to four word ids (0: no word) is one number of ``4 * bits`` bits. A
Feistel network permutes these numbers, so that every prefix of the permuted number is
spread evenly, whatever the n-grams are, and the n-gram can be had back from it. The
first bits name the bucket, the next ones the quotient, i.e. the slot of the filter; what
is left is the remainder. A filter stores its entries in the order of the permuted
numbers: the slots as one bit a slot and one a entry, the remainders in as few bytes as
they need, and counters of one byte with a list of the larger ones.

Permuted numbers are held as ``top`` (their first 64 bits) and ``rest`` (the bits after them).
"""

from __future__ import annotations

import struct

import numpy as np

from rolecall.llm import ragged

#: Word ids take 16 to 32 bits.
LEAST_BITS, MOST_BITS = 16, 32
ROUNDS = 4
_HEAD = struct.Struct("<IBI")


def bits_for(largest: int) -> int:
    """Bits of a word id."""
    bits = max(LEAST_BITS, int(largest).bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"{largest} word ids are more than {MOST_BITS} bits can name")
    return bits


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _round(half: np.ndarray, i: int, width: int) -> np.ndarray:
    return ragged.mix(half + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) & _mask(width)


def permute(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(top, rest) of n-grams, given as four rows of word ids."""
    ids = grams.astype(np.uint64)
    width = 2 * bits
    with np.errstate(over="ignore"):
        left, right = (ids[0] << np.uint64(bits)) | ids[1], (ids[2] << np.uint64(bits)) | ids[3]
        for i in range(ROUNDS):
            left, right = right, left ^ _round(right, i, width)
    if width == 64:
        return left, right
    extra = 2 * width - 64  # bits of the right half that don't fit the top
    return (left << np.uint64(64 - width)) | (right >> np.uint64(extra)), right & _mask(extra)


def restore(top: np.ndarray, rest: np.ndarray, bits: int) -> np.ndarray:
    """The n-grams, as four rows of word ids, of permuted numbers."""
    width = 2 * bits
    if width == 64:
        left, right = top, rest
    else:
        extra = 2 * width - 64
        left = top >> np.uint64(64 - width)
        right = ((top & _mask(64 - width)) << np.uint64(extra)) | rest
    with np.errstate(over="ignore"):
        for i in reversed(range(ROUNDS)):
            left, right = right ^ _round(left, i, width), left
    low = _mask(bits)
    return np.stack([left >> np.uint64(bits), left & low, right >> np.uint64(bits), right & low]).astype(np.int64)


def counted(top: np.ndarray, rest: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order, each number once with the sum of its counts; sorted runs are merged."""
    if not len(top):
        return top, rest, count
    order = np.argsort(top, kind="stable")  # merges runs that are in order already
    top, rest, count = top[order], rest[order], count[order]
    same = top[1:] == top[:-1]
    if (same & (rest[1:] != rest[:-1])).any():
        order = np.lexsort((rest, top))
        top, rest, count = top[order], rest[order], count[order]
        same = top[1:] == top[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same | (rest[1:] != rest[:-1])]))
    return top[first], rest[first], np.add.reduceat(count, first)


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of each value in whole bytes."""
    size = -(-bits // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes() if size else b""


def _values(raw: memoryview, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    if size:
        out[:, :size] = np.frombuffer(raw[: n * size], np.uint8).reshape(n, size)
    return out.reshape(-1).view("<u8").astype(np.uint64), n * size


def _below(bits: int, prefix: int, q: int) -> tuple[int, int]:
    """Bits of the remainder in ``top`` and in ``rest``."""
    return 64 - prefix - q, 4 * bits - 64


def encode(top: np.ndarray, rest: np.ndarray, count: np.ndarray, bits: int, prefix: int) -> bytes:
    """The filter of ordered, distinct entries that share their first ``prefix`` bits."""
    n = len(top)
    q = min(max(0, n.bit_length() - 1), 64 - prefix)
    own = top & _mask(64 - prefix)
    inner, outer = _below(bits, prefix, q)
    quotient = (own >> np.uint64(inner)).astype(np.int64) if q else np.zeros(n, np.int64)
    remainder = own & _mask(inner)
    slots = np.zeros(n + (1 << q), np.uint8)
    slots[quotient + np.arange(n)] = 1
    if inner + outer <= 64:
        kept = _planes((remainder << np.uint64(outer)) | rest if outer < 64 else rest, inner + outer)
    else:
        kept = _planes(remainder, inner) + _planes(rest, outer)
    large = count[count >= 255]
    small = np.minimum(count, 255).astype(np.uint8)
    return _HEAD.pack(n, q, len(large)) + np.packbits(slots).tobytes() + kept + small.tobytes() + large.astype("<i8").tobytes()


def decode(raw: bytes, bucket: int, bits: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries (top, rest, count) of a filter."""
    n, q, n_large = _HEAD.unpack_from(raw)
    view = memoryview(raw)[_HEAD.size :]
    size = n + (1 << q)
    slots = np.unpackbits(np.frombuffer(view[: -(-size // 8)], np.uint8))[:size]
    view = view[-(-size // 8) :]
    quotient = (np.flatnonzero(slots) - np.arange(n)).astype(np.uint64)
    inner, outer = _below(bits, prefix, q)
    if inner + outer <= 64:
        both, used = _values(view, n, inner + outer)
        remainder, rest = (both >> np.uint64(outer) if outer < 64 else np.zeros(n, np.uint64)), both & _mask(outer)
    else:
        remainder, used = _values(view, n, inner)
        rest, more = _values(view[used:], n, outer)
        used += more
    view = view[used:]
    count = np.frombuffer(view[:n], np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(view[n : n + 8 * n_large], "<i8")
    top = remainder | (quotient << np.uint64(inner) if q else np.uint64(0))
    if prefix:
        top |= np.uint64(bucket << (64 - prefix))
    return top, rest, count


def merge(filters: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of several filters, counters of equal n-grams added."""
    return counted(*(np.concatenate(x) for x in zip(*filters, strict=True)))
