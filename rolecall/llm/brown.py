"""Class-based bigram scoring with classes from exchange clustering.

Training counts every word of the training texts, and exchange clustering gives each of
them a class by its own neighbours:

1. *Types*: a word with at least 1 / ``HEAD`` of all tokens is a type of its own (so there are
   at most ``HEAD`` of them), the others share the type of their last three characters for now.
   Starting with the most frequent types as classes, every other half of the types moves,
   round after round, to the class under which their left and right neighbours are
   likeliest. Each round is one pass over the stored type streams; tasks send count tables of
   fixed size and nothing else.
2. *Words*: then every word that shared a type moves by the same rule. Tasks send the classes
   beside each occurrence, grouped by word, to the word's bucket of the vocabulary, where it
   takes its class. No occurrence of a frequent word travels, so no bucket is hot. Only
   words that training has not seen keep the class of their ending.

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

with add-one-half smoothing of both factors; every class keeps one place for unseen
words, so the probabilities of all known words and the unknown one sum to one. The end
of a text is a class of its own, and it is the context of a text's first word.

Scoring asks the buckets for the distinct rare words of each batch of texts (batches are
made twice alike, once to ask and once to read the answers) and stores the classes of
all texts, one byte a token. The transitions are counted over those of the training
texts, and a last pass scores all of them.

Words are known by their 64-bit hash. Defined results: a null or empty text is its end
token alone; a null id trains; repeated rows are texts of their own; without training
texts all counts are 0; an empty table gives no rows; extra columns have no influence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import ragged, rows
from rolecall.session import staged

#: With the endings' types and the end, types fit 16 bits.
HEAD = 60_000
TAIL_BITS = 10
TAIL = 1 << TAIL_BITS
CLASSES = 64
ROUNDS = 8
#: Bytes of texts in one batch of questions; occurrences of rare words sent at once.
BATCH = 1 << 20
SENT = 1 << 20
#: Words whose blocks one group of the vocabulary join holds, in expectation.
BUCKET_WORDS = 1_000_000
BLOCK = 512


@dataclass
class Words:
    """Frequent words by hash, in hash order; types are TAIL + position, the end is the last type."""

    hashes: np.ndarray
    counts: np.ndarray

    @property
    def types(self) -> int:
        return TAIL + len(self.hashes) + 1


@dataclass
class Classes:
    """Classes of types, and how well neighbours fit the members of each class."""

    class_of: np.ndarray  # by type; the end's class is the last
    follow: np.ndarray  # log P(next class | class), by class; the last column is the end
    lead: np.ndarray  # log P(class before | class)


@dataclass
class ClassModel:
    words: Words
    class_of: np.ndarray  # by type: of frequent words, and of endings for words that training hasn't seen
    emission_base: np.ndarray  # log10 of the denominator of P(w | class)
    tokens: int
    vocabulary: int
    texts: int


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and ending type of every word."""
    data = ragged.LOWER[data]
    starts, ends, text = ragged.token_spans(data, offsets)
    sums = ragged.prefix(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    last = np.searchsorted(lead, ends) - 3
    tail_start = np.maximum(lead[np.maximum(last, 0)] if len(lead) else starts, starts)
    ending = ragged.span_hash(sums, tail_start, ends) >> np.uint64(64 - TAIL_BITS)
    return ragged.span_hash(sums, starts, ends), text, ending.astype(np.int64)


def types_of(hashes: np.ndarray, endings: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Type of each word and its place among the frequent words (-1: not one)."""
    if not len(words.hashes):
        return endings, np.full(len(hashes), -1)
    place = np.minimum(np.searchsorted(words.hashes, hashes), len(words.hashes) - 1)
    place = np.where(words.hashes[place] == hashes, place, -1)
    return np.where(place >= 0, TAIL + place, endings), place


def vocabulary(train: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: sorted word hashes, their counts and ending types, and the sums of both."""
    schema = "bucket int, words binary, counts binary, endings binary"

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            words, first, back = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate([h[1] for h in held]), len(words)).astype(np.int64)
            endings = np.concatenate([h[2] for h in held])[first]
            bucket = (words % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for a, b in zip(*ragged.runs(bucket[order]), strict=True):
                at = order[a:b]
                yield {"bucket": int(bucket[at[0]]), "words": words[at].tobytes(), "counts": n[at].tobytes(), "endings": endings[at].astype(np.uint16).tobytes()}

        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for _, _, d, o in ragged.chunks(data, offsets):
                hashes, _, endings = split(d, o)
                words, first, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((words, n, endings[first]))
                size += len(words)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_pylist(list(flush()), schema=arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(flush()), schema=arrow)

    arrow = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("endings", pa.binary())])

    def merge(table: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["words"]])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"]])
        endings = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table["endings"]])
        words, first, back = np.unique(words, return_index=True, return_inverse=True)
        n = np.bincount(back, counts, len(words)).astype(np.int64)
        out = {"bucket": table["bucket"][0].as_py(), "words": words.tobytes(), "counts": n.tobytes(), "endings": endings[first].tobytes()}
        return pa.Table.from_pylist([out | {"n_words": len(words), "n_tokens": int(n.sum())}], schema=arrow.append(pa.field("n_words", pa.int64())).append(pa.field("n_tokens", pa.int64())))

    sent = train.select("text").mapInArrow(count, schema)
    return staged(sent.groupBy("bucket").applyInArrow(merge, schema + ", n_words bigint, n_tokens bigint"), "vocabulary")


def frequent(known: DataFrame, tokens: int) -> Words:
    """The words with at least 1 / HEAD of all tokens: at most HEAD rows reach the driver."""

    def pick(batches):
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                n = np.frombuffer(counts.as_buffer(), np.int64)
                at = n * HEAD >= tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words.as_buffer(), np.uint64)[at].view(np.int64)), pa.array(n[at])], ["word", "n"])

    got = known.select("words", "counts").mapInArrow(pick, "word bigint, n bigint").collect()
    hashes = np.array([r.word for r in got], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Words(hashes[order], np.array([r.n for r in got], np.int64)[order])


def streams(train: DataFrame, words: Words) -> DataFrame:
    """The training texts as type numbers, each text followed by its end; one row per batch of texts."""
    sent = train.sparkSession.sparkContext.broadcast(words)

    def encode(batches):
        known = sent.value
        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for first, end, d, o in ragged.chunks(data, offsets, 4 * ragged.CHUNK):
                hashes, text, endings = split(d, o)
                out = np.full(len(hashes) + end - first, known.types - 1, np.uint16)
                out[np.arange(len(hashes)) + text] = types_of(hashes, endings, known)[0]
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["types"])

    return staged(train.select("text").mapInArrow(encode, "types binary"), "streams")


def neighbours(stream: DataFrame, class_of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): how often each type follows and precedes each class."""
    sent, types = stream.sparkSession.sparkContext.broadcast(class_of.astype(np.int64)), len(class_of)
    width = 2 * classes

    def count(batches):
        total = np.zeros(types * width, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                t = np.frombuffer(blob.as_buffer(), np.uint16).astype(np.int64)
                c = sent.value[t]
                before = np.concatenate([[classes - 1], c[:-1]])  # a batch starts after the end of a text
                total += np.bincount(np.concatenate([t * width + before, t[:-1] * width + classes + c[1:]]), minlength=len(total))
        cells = np.flatnonzero(total)
        blocks = cells // (BLOCK * width)
        for a, b in zip(*ragged.runs(blocks), strict=True):
            yield pa.RecordBatch.from_pylist(
                [{"block": int(blocks[a]), "cells": cells[a:b].astype(np.uint32).tobytes(), "counts": total[cells[a:b]].tobytes()}], schema=arrow
            )

    arrow = pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def add(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        total = np.zeros(BLOCK * width, np.int64)
        for cells, counts in zip(table["cells"], table["counts"], strict=True):
            total[np.frombuffer(cells.as_buffer(), np.uint32).astype(np.int64) - block * BLOCK * width] += np.frombuffer(counts.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        return pa.Table.from_pylist([{"block": block, "cells": (at + block * BLOCK * width).astype(np.uint32).tobytes(), "counts": total[at].tobytes()}], schema=arrow)

    schema = "block int, cells binary, counts binary"
    sums = np.zeros(types * width, np.int64)
    for r in stream.mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect():
        sums[np.frombuffer(r.cells, np.uint32)] = np.frombuffer(r.counts, np.int64)
    sums = sums.reshape(types, width)
    return sums[:, :classes], sums[:, classes:]


def exchange(stream: DataFrame, words: Words, rounds: int = ROUNDS, classes: int = CLASSES) -> Classes:
    """Classes of the types by exchange; the end of a text is class ``classes``."""
    types, end = words.types, classes
    class_of = np.full(types, classes + 1)  # not yet in a class
    leaders = np.lexsort((words.hashes, -words.counts))[:classes]
    class_of[TAIL + leaders] = np.arange(len(leaders))
    class_of[-1] = end
    turn = ragged.mix(np.arange(types, dtype=np.uint64)) & np.uint64(1)
    for step in range(rounds + 1):
        # the end of a text is the last class in every pass
        place = np.where(class_of == end, classes + 1, np.where(class_of == classes + 1, classes, class_of))
        left, right = neighbours(stream, place, classes + 2)
        into, out = np.zeros((classes + 2, classes + 2)), np.zeros((classes + 2, classes + 2))
        np.add.at(into, place, left)
        np.add.at(out, place, right)
        # row k of each: how likely the neighbours are for members of class k
        follow = np.log(out[:classes] + 0.1) - np.log(out[:classes].sum(axis=1, keepdims=True) + 0.1 * (classes + 2))
        lead = np.log(into[:classes] + 0.1) - np.log(into[:classes].sum(axis=1, keepdims=True) + 0.1 * (classes + 2))
        if step == rounds:
            keep = [*range(classes), classes + 1]  # no type is without a class any more
            return Classes(np.where(class_of == classes + 1, 0, class_of), follow[:, keep], lead[:, keep])
        fit = right @ follow.T + left @ lead.T
        best = fit.argmax(axis=1)
        moves = (class_of == classes + 1) if step == 0 else (turn == step % 2)
        moves[-1] = False
        class_of = np.where(moves, best, class_of)


def contexts(train: DataFrame, words: Words, found: Classes, buckets: int) -> DataFrame:
    """(bucket, words, counts, left, right): the classes beside every occurrence of each rare word, grouped by word."""
    sent, end = train.sparkSession.sparkContext.broadcast((words, found.class_of)), len(found.follow)

    def collect(batches):
        head, class_of = sent.value
        held, size = [], 0

        def flush():
            rare, left, right = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = rare % np.uint64(buckets)
            order = np.lexsort((rare, bucket))
            rare, left, right, bucket = rare[order], left[order], right[order], bucket[order]
            for a, b in zip(*ragged.runs(bucket), strict=True):
                first, last = ragged.runs(rare[a:b])
                yield {
                    "bucket": int(bucket[a]),
                    "words": rare[a:b][first].tobytes(),
                    "counts": (last - first).astype(np.uint32).tobytes(),
                    "left": left[a:b].tobytes(),
                    "right": right[a:b].tobytes(),
                }

        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for first, last, d, o in ragged.chunks(data, offsets, 4 * ragged.CHUNK):
                hashes, text, endings = split(d, o)
                types, place = types_of(hashes, endings, head)
                at = np.arange(len(hashes)) + text
                stream = np.full(len(hashes) + last - first + 1, end, np.uint8)
                stream[at + 1] = class_of[types]  # an end stands before the first text and after each
                rare = place < 0
                held.append((hashes[rare], stream[at[rare]], stream[at[rare] + 2]))
                size += int(rare.sum())
                if size > SENT:
                    yield pa.RecordBatch.from_pylist(list(flush()), schema=arrow)
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pylist(list(flush()), schema=arrow)

    arrow = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("words", "counts", "left", "right")]])
    return train.select("text").mapInArrow(collect, "bucket int, words binary, counts binary, left binary, right binary")


def best_classes(word: np.ndarray, left: np.ndarray, right: np.ndarray, words: int, found: Classes) -> np.ndarray:
    """The class under which the neighbours of each word's occurrences are likeliest; ``word`` numbers the words."""
    order = np.argsort(word, kind="stable")
    word, left, right = word[order], left[order], right[order]
    first, last = ragged.runs(word)
    best = np.zeros(words, np.uint8)
    follow, lead = np.ascontiguousarray(found.follow.T), np.ascontiguousarray(found.lead.T)
    at = 0
    while at < len(first):  # some occurrences at a time
        until = max(at + 1, int(np.searchsorted(last, first[at] + (1 << 15), "right")))
        a, b = first[at], last[until - 1]
        fit = np.add.reduceat(follow[right[a:b]] + lead[left[a:b]], first[at:until] - a, axis=0)
        best[word[first[at:until]]] = fit.argmax(axis=1)
        at = until
    return best


def word_classes(train: DataFrame, known: DataFrame, words: Words, found: Classes, buckets: int) -> DataFrame:
    """``known`` with the class of every word, in the order of its hashes."""
    sent = train.sparkSession.sparkContext.broadcast((words, found))

    def settle(near: pa.Table, own: pa.Table) -> pa.Table:
        head, classes = sent.value
        row = own.to_pylist()[0]  # a bucket without words of training has no neighbours either
        hashes = np.frombuffer(row["words"], np.uint64)
        parts = []
        for w, n, x, y in zip(*(near[c] for c in ("words", "counts", "left", "right")), strict=True):
            place = np.searchsorted(hashes, np.frombuffer(w.as_buffer(), np.uint64))
            sides = (np.frombuffer(c.as_buffer(), np.uint8) for c in (x, y))
            parts.append((np.repeat(place, np.frombuffer(n.as_buffer(), np.uint32)), *sides))
        best = np.zeros(len(hashes), np.uint8)
        if parts:
            best = best_classes(*(np.concatenate(c) for c in zip(*parts, strict=True)), len(hashes), classes)
        _, place = types_of(hashes, np.zeros(len(hashes), np.int64), head)
        best[place >= 0] = classes.class_of[TAIL + place[place >= 0]]
        return pa.Table.from_pylist([{k: row[k] for k in ("bucket", "words", "counts")} | {"classes": best.tobytes()}], schema=arrow)

    arrow = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("words", "counts", "classes")]])
    near = contexts(train, words, found, buckets).groupBy("bucket")
    settled = near.cogroup(known.select("bucket", "words", "counts").groupBy("bucket"))
    return staged(settled.applyInArrow(settle, "bucket int, words binary, counts binary, classes binary"), "word-classes")


def fit(train: DataFrame, known: DataFrame, buckets: int, rounds: int = ROUNDS, classes: int = CLASSES) -> tuple[ClassModel, DataFrame]:
    """The model of the texts of ``train``, whose vocabulary is ``known``, and the vocabulary with classes."""
    facts = known.agg(F.sum("n_words").alias("v"), F.sum("n_tokens").alias("n")).first()
    texts = train.count()
    tokens, size = (facts.n or 0) + texts, (facts.v or 0) + (texts > 0)
    words = frequent(known, tokens)
    found = exchange(streams(train, words), words, rounds, classes)
    classed = word_classes(train, known, words, found, buckets)

    def sizes(batches):
        n = np.zeros((2, classes + 1), np.int64)
        for batch in batches:
            for counts, held in zip(*batch.columns, strict=True):
                c = np.frombuffer(held.as_buffer(), np.uint8)
                n[0] += np.bincount(c, minlength=classes + 1)
                n[1] += np.bincount(c, np.frombuffer(counts.as_buffer(), np.int64), classes + 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes + 1)), pa.array(n[0]), pa.array(n[1])], ["class", "v", "n"])

    held = classed.select("counts", "classes").mapInArrow(sizes, "class bigint, v bigint, n bigint")
    by_class = {r["class"]: r for r in held.groupBy("class").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()}
    emission = np.array([np.log10(by_class[c].n + 0.5 * (by_class[c].v + 1)) if c in by_class else np.log10(0.5) for c in range(classes + 1)])
    return ClassModel(words, found.class_of, emission, tokens, size, texts), classed


def _batches(batch: pa.RecordBatch, head: Words):
    """Per run of texts: (first row, end row, hashes, text, endings, types, places among the frequent words) of its words."""
    data, offsets = ragged.texts(batch.column(1))
    for first, last, d, o in ragged.chunks(data, offsets, BATCH):
        hashes, text, endings = split(d, o)
        yield first, last, hashes, text, endings, *types_of(hashes, endings, head)


def resolved(docs: DataFrame, classed: DataFrame, model: ClassModel, buckets: int) -> DataFrame:
    """Stored per batch of texts of ``docs`` (_key, text, trains): ``keys, trains``, the ``classes`` of all tokens, ends included,
    and per text ``n_tokens, n_known, base`` and ``emission``, the log10 probabilities without transitions."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most HEAD + TAIL types
    base = float(np.log10(model.tokens + 0.5 * (model.vocabulary + 1)))

    def ask(batches):
        for batch in batches:
            for first, _, hashes, _, _, _, place in _batches(batch, sent.value.words):
                rare = np.unique(hashes[place < 0])
                bucket = (rare % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                out = [
                    {"bucket": int(bucket[order[a]]), "batch": batch.column(0)[first].as_py(), "words": rare[order[a:b]].tobytes()}
                    for a, b in zip(*ragged.runs(bucket[order]), strict=True)
                ]
                yield pa.RecordBatch.from_pylist(out, schema=question)

    def look_up(asked: pa.Table, own: pa.Table) -> pa.Table:
        """Counts (0: not seen) and classes of the words asked for, in their order."""
        words, counts, held = (
            np.frombuffer(own[c][0].as_buffer(), kind) if len(own) else np.zeros(0, kind)
            for c, kind in (("words", np.uint64), ("counts", np.int64), ("classes", np.uint8))
        )
        out = []
        for bucket, batch, wanted in zip(*(asked[c] for c in ("bucket", "batch", "words")), strict=True):
            want = np.frombuffer(wanted.as_buffer(), np.uint64)
            place = np.minimum(np.searchsorted(words, want), max(0, len(words) - 1))
            seen = words[place] == want if len(words) else np.zeros(len(want), bool)
            n = np.zeros(len(want), np.int64)
            c = np.zeros(len(want), np.uint8)
            n[seen], c[seen] = counts[place[seen]], held[place[seen]]
            width = np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64
            out.append({"batch": batch.as_py(), "bucket": bucket.as_py(), "counts": n.astype(width).tobytes(), "classes": c.tobytes()})
        return pa.Table.from_pylist(out, schema=answer)

    def hold(batches):
        m = sent.value
        for batch in batches:
            for first, last, hashes, text, endings, types, place in _batches(batch, m.words):
                n = last - first
                rare, at, back = np.unique(hashes[place < 0], return_index=True, return_inverse=True)
                endings = endings[place < 0][at]
                known = np.where(place >= 0, m.words.counts[np.maximum(place, 0)] if len(m.words.counts) else 0, 0)
                stream = np.full(len(text) + n, len(m.emission_base) - 1, np.uint8)
                stream[np.arange(len(text)) + text] = m.class_of[types]
                often = place >= 0
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "batch": batch.column(0)[first].as_py(),
                            "keys": batch.column(0).slice(first, n).to_numpy(zero_copy_only=False).tobytes(),
                            "trains": batch.column(2).slice(first, n).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                            "sizes": np.bincount(text, minlength=n).astype(np.uint32).tobytes(),
                            "stream": stream.tobytes(),
                            "rare": (rare % np.uint64(buckets)).astype(np.uint32).tobytes(),
                            "endings": m.class_of[endings].astype(np.uint8).tobytes(),
                            "back": back.astype(np.uint32).tobytes(),
                            "often": np.packbits(often).tobytes(),
                            "known": np.bincount(text[often], minlength=n).astype(np.uint32).tobytes(),
                            "above": np.bincount(text[often], np.log10(known[often] + 0.5), n).tobytes(),
                        }
                    ],
                    schema=holding,
                )

    def add(table: pa.Table) -> pa.Table:
        """One batch of texts with the answers of the buckets."""
        m = sent.value
        told = table.to_pylist()
        own = next(r for r in told if r["keys"] is not None)
        sizes, stream = np.frombuffer(own["sizes"], np.uint32).astype(np.int64), np.frombuffer(own["stream"], np.uint8).copy()
        n, tokens = len(sizes), int(sizes.sum())
        text = np.repeat(np.arange(n), sizes)
        often = np.unpackbits(np.frombuffer(own["often"], np.uint8))[:tokens].astype(bool)
        bucket, back = np.frombuffer(own["rare"], np.uint32), np.frombuffer(own["back"], np.uint32)
        order = np.argsort(bucket, kind="stable")
        start = dict(zip(*(x.tolist() for x in np.unique(bucket[order], return_index=True)), strict=True))
        count, held = np.full(len(bucket), -1, np.int64), np.frombuffer(own["endings"], np.uint8).copy()
        for r in told:
            if r["keys"] is None:
                c = np.frombuffer(r["classes"], np.uint8)
                at = order[start[r["bucket"]] : start[r["bucket"]] + len(c)]
                count[at] = np.frombuffer(r["counts"], np.uint32 if len(r["counts"]) == 4 * len(c) else np.uint64)
                held[at[count[at] > 0]] = c[count[at] > 0]
        if (count < 0).any():
            raise RuntimeError("a batch of texts has asked for other words than it holds")
        rare_text = text[~often]
        stream[(np.arange(tokens) + text)[~often]] = held[back]
        known = np.frombuffer(own["known"], np.uint32) + np.bincount(rare_text[count[back] > 0], minlength=n) + (m.texts > 0)
        above = np.frombuffer(own["above"], np.float64) + np.bincount(rare_text, np.log10(count[back] + 0.5), n)
        classes = stream[np.arange(tokens) + text]
        out = {
            "keys": own["keys"],
            "trains": own["trains"],
            "classes": stream.tobytes(),
            "n_tokens": (sizes + 1).tobytes(),
            "n_known": known.astype(np.int64).tobytes(),
            "base": (above + np.log10(m.texts + 0.5) - (sizes + 1) * base).tobytes(),
            "emission": (above - np.bincount(text, m.emission_base[classes], n)).tobytes(),
        }
        return pa.Table.from_pylist([out], schema=result)

    binary = lambda *names: [(c, pa.binary()) for c in names]
    ddl = lambda schema: ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int' if f.type == pa.int32() else 'bigint'}" for f in schema)
    question = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *binary("words")])
    answer = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *binary("counts", "classes")])
    holding = pa.schema([("batch", pa.int64()), *binary("keys", "trains", "sizes", "stream", "rare", "endings", "back", "often", "known", "above")])
    result = pa.schema(binary("keys", "trains", "classes", "n_tokens", "n_known", "base", "emission"))
    source = docs.select("_key", "text", "trains")
    asked = source.mapInArrow(ask, ddl(question)).groupBy("bucket")
    answers = asked.cogroup(classed.select("bucket", "words", "counts", "classes").groupBy("bucket")).applyInArrow(look_up, ddl(answer))
    own = source.mapInArrow(hold, ddl(holding))
    return staged(own.unionByName(answers, allowMissingColumns=True).groupBy("batch").applyInArrow(add, ddl(result)), "resolved")


def transitions(held: DataFrame, classes: int) -> np.ndarray:
    """log10 P(next class | class), the last being the end, over the training texts of ``held`` (``resolved``)."""

    def count(batches):
        n = np.zeros((classes + 1) ** 2, np.int64)
        for batch in batches:
            for trains, sizes, stream in zip(*batch.columns, strict=True):
                c = np.frombuffer(stream.as_buffer(), np.uint8).astype(np.int64)
                counts = np.repeat(np.frombuffer(trains.as_buffer(), np.uint8), np.frombuffer(sizes.as_buffer(), np.int64)) > 0
                before = np.concatenate([[classes], c[:-1]])
                n += np.bincount((before * (classes + 1) + c)[counts], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["cell", "n"])

    sums = held.select("trains", "n_tokens", "classes").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros((classes + 1) ** 2)
    for r in sums.collect():  # one row per pair of classes
        table[r.cell] = r.n
    table = table.reshape(classes + 1, classes + 1)
    return np.log10(table + 0.5) - np.log10(table.sum(axis=1, keepdims=True) + 0.5 * (classes + 1))


def score(docs: DataFrame, classed: DataFrame, model: ClassModel, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """(_key, n_tokens, n_known, base_score, score) of each row of ``docs`` (_key, text, trains), and the transitions."""
    held = resolved(docs, classed, model, buckets)
    end = len(model.emission_base) - 1
    steps = transitions(held, end)

    def last(batches):
        for batch in batches:
            for keys, stream, sizes, n_known, base, emission in zip(*batch.columns, strict=True):
                c = np.frombuffer(stream.as_buffer(), np.uint8)
                n = np.frombuffer(sizes.as_buffer(), np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                moved = np.bincount(owner, steps[np.concatenate([[end], c[:-1]]), c], len(n))
                values = np.frombuffer(emission.as_buffer(), np.float64) + moved
                known = (np.frombuffer(keys.as_buffer(), np.int64), n, np.frombuffer(n_known.as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (*known, np.frombuffer(base.as_buffer(), np.float64), values))], fields)

    fields = ["_key", "n_tokens", "n_known", "base_score", "score"]
    columns = held.select("keys", "classes", "n_tokens", "n_known", "base", "emission")
    return columns.mapInArrow(last, "_key bigint, n_tokens bigint, n_known bigint, base_score double, score double"), steps


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole document under the model of the documents that aren't held out."""
    docs = rows.keyed(rows.table(spark, sf_dir, "documents"), "doc_id", "text")
    docs = docs.withColumn("trains", rows.training("_id", 5, 1))
    train = docs.filter("trains").select("text")
    volume = docs.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    buckets = max(8, rows.shards(volume // 6, BUCKET_WORDS))
    known = vocabulary(train, buckets)
    model, classed = fit(train, known, buckets)
    scores, _ = score(docs, classed, model, buckets)
    ids = docs.select("_key", F.col("_id").alias("doc_id"), (~F.col("trains")).alias("held_out"))
    return ids.join(scores, "_key").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
