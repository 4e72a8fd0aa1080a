"""Licence scans: a trained paragraph classifier names the licence family of each notice.

A paragraph is a line with a word. It is judged by windows of up to ``WINDOW`` words, each
half of which the next one covers again, so a notice of ``WINDOW`` / 2 words lies whole in one
of them wherever it stands. A multinomial logistic regression over hashed word one- and
two-grams gives a window's family probabilities beside two further classes: ``none`` (no
notice) and ``unknown`` (speaks of a licence but of no listed family). It is fitted on varied
templates, alone and inside windows of other words, and on about ``most`` windows of the
corpus, drawn by a hash. The probabilities are calibrated by a temperature on variants the
fit hasn't seen. A predicted family stands if the window also shares enough three-word
runs with one of the family's templates. With a smaller share it is ``unknown``, with none no notice, as is a window whose
``unknown`` is not likelier than all else. A paragraph of one or two words is a notice only if it
is one of the templates (headings). A paragraph is what its window with the
least probability of ``none`` says.

Result: one row per paragraph that is a notice. Defined results: null, empty and
wordless texts have no notices; repeated rows and null ids are scanned like others;
an empty table gives no rows; extra columns have no influence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import linear, ragged, rows

#: The usual wording of licence notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License",
        "Apache License, Version 2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "The MIT License (MIT)",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD License",
        "BSD 3-Clause License",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPLv3",
        "GPLv2",
        "GNU General Public License",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "LGPLv3",
        "GNU Lesser General Public License",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "AGPLv3",
        "GNU Affero General Public License",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "MPL 2.0",
        "Mozilla Public License",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "CC BY 4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "CC BY-SA 4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "CC BY-NC 4.0",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "CC0",
        "CC0 1.0 Universal",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
#: Speaks of licences without naming a listed family; trains ``unknown``.
GENERIC = (
    "Licensed under the terms of the accompanying agreement.",
    "This software is distributed under a custom license, see the LICENSE file.",
    "The license of this work is described in the documentation.",
    "Released under the Public Works License, version 5.",
    "This work is licensed under the Example General License, version 9.",
    "Permission is granted to copy this text for private study.",
)
LOG_BITS = 16
#: Words of a window, and of the step to the next one.
WINDOW, STEP = 96, 48
NONE, UNKNOWN = "none", "unknown"


@dataclass
class Scanner:
    classes: list[str]
    weights: np.ndarray
    temperature: float
    least: float
    overlap: float
    templates: dict[str, list[np.ndarray]]


def paragraphs(data: np.ndarray, offsets: np.ndarray):
    """Words and lines with words: (word hash, line of word), (start, end, text, number in its text) of the lines."""
    data = ragged.LOWER[data]
    starts, ends, _ = ragged.token_spans(data, offsets, ragged.PUNCTUATION)
    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    begin = begin[begin < len(data)]
    text = np.searchsorted(offsets, begin, "right") - 1
    until = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, begin)], offsets[text + 1])
    number = np.arange(len(begin)) - np.searchsorted(text, text)
    line = np.searchsorted(begin, starts, "right") - 1
    words = ragged.span_hash(ragged.prefix(data), starts, ends)
    return words, line, begin, until, text, number


def grams(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, line) of the one- and two-word runs."""
    pairs, own = ragged.text_windows(words, line, 2)
    shift = np.uint64(64 - LOG_BITS)
    return (np.concatenate([ragged.mix(words), pairs]) >> shift).astype(np.int64), np.concatenate([line, own])


def sentence_words(sentence: str) -> np.ndarray:
    data, offsets = ragged.texts(pa.array([sentence]))
    return paragraphs(data, offsets)[0]


def runs_of(words: np.ndarray) -> np.ndarray:
    """Distinct three-word runs; of shorter paragraphs the paragraph itself."""
    size = min(3, len(words))
    return np.unique(ragged.window_hash(words, size)) if size else words


def example(words: np.ndarray) -> linear.Example:
    found, counts = np.unique(grams(words, np.zeros(len(words), np.int64))[0], return_counts=True)
    return found, np.minimum(counts, 3) / np.sqrt(max(1, len(words)))


def windows(words: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of all windows, window of each, line of each window)."""
    size = np.bincount(line, minlength=lines)
    count = np.where(size > 0, np.maximum(-(-(size - WINDOW) // STEP), 0) + 1, 0)
    of = np.repeat(np.arange(lines), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(number * STEP, np.maximum(size[of] - WINDOW, 0)) + (np.cumsum(size) - size)[of]
    length = np.minimum(size[of], WINDOW)
    own = np.repeat(np.arange(len(of)), length)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
    return words[start[own] + inner], own, of


def background(docs: DataFrame, most: int) -> list[np.ndarray]:
    """Words of up to ``most`` distinct windows of the corpus, those of the smallest hashes; none shares a run with a template.

    Tasks send the windows below a bound of the hash that follows from the size of the corpus.
    """
    known = np.concatenate([runs_of(sentence_words(s)) for group in (*TEMPLATES.values(), GENERIC) for s in group])
    volume = docs.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    below = min(1.0, 4 * most / max(1.0, volume / (6 * STEP)))  # words take about six characters
    bound = np.uint64(min(int(below * 2.0**64), (1 << 64) - 1))

    def draw(batches):
        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for _, _, d, o in ragged.chunks(data, offsets):
                words, line, begin, *_ = paragraphs(d, o)
                held, own, _ = windows(words, line, len(begin))
                first, end = ragged.runs(own)
                place = ragged.mix(np.arange(len(own)).astype(np.uint64) - np.repeat(first, end - first).astype(np.uint64))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(ragged.mix(held + place), dtype=np.uint64)])
                mark = ragged.mix(sums[end] - sums[first])
                some = np.flatnonzero(mark <= bound)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((mark[some] >> np.uint64(1)).view(np.int64)), pa.array([held[first[i] : end[i]].tobytes() for i in some], pa.binary())],
                    ["mark", "words"],
                )

    found = docs.select("text").mapInArrow(draw, "mark bigint, words binary").groupBy("mark").agg(F.first("words").alias("words"))
    drawn = [np.frombuffer(r.words, np.uint64) for r in found.orderBy("mark").limit(most).collect()]
    return [w for w in drawn if not np.isin(runs_of(w), known).any()]


def fit(
    docs: DataFrame, most: int = 3000, variants: int = 60, least: float = 0.5, overlap: float = 0.5, seed: int = 11
) -> Scanner:
    """``most``: windows of the corpus in the fit; ``variants``: changed forms of each template."""
    draw = np.random.default_rng(seed)
    noise = background(docs, most)
    classes = [NONE, UNKNOWN, *TEMPLATES]
    stock = np.concatenate(noise) if noise else np.zeros(1, np.uint64)
    examples, truth = [example(w) for w in noise], [0] * len(noise)
    for k, (_, group) in enumerate([(UNKNOWN, GENERIC), *TEMPLATES.items()], start=1):
        for sentence in group:
            words = sentence_words(sentence)
            for v in range(variants):
                out = words
                if v:
                    out = out[draw.random(len(out)) > 0.08 * draw.random()]
                    if v % 3:  # inside other words, every other time of a whole window
                        room = int(draw.integers(0, 17)) if v % 2 else max(0, WINDOW - len(out))
                        ahead = int(draw.integers(0, room + 1))
                        at = draw.integers(0, len(stock), 2)
                        a, b = (stock[(at[j] + np.arange(n)) % len(stock)] for j, n in enumerate((ahead, room - ahead)))
                        out = np.concatenate([a, out, b])
                if len(out):
                    examples.append(example(out))
                    truth.append(k)
    truth = np.array(truth)
    held = draw.random(len(truth)) < 0.2
    model = linear.Ftrl(1 << LOG_BITS, len(classes), alpha=1.0, l1=0.3)
    model.fit([examples[i] for i in np.flatnonzero(~held)], np.eye(len(classes))[truth[~held]], 3)
    weights = model.weights().astype(np.float32)
    heat = linear.temperature(linear.logits([examples[i] for i in np.flatnonzero(held)], weights), truth[held])
    templates = {name: [runs_of(sentence_words(s)) for s in group] for name, group in TEMPLATES.items()}
    return Scanner(classes, weights, heat, least, overlap, templates)


def scan(docs: DataFrame, scanner: Scanner, keep: list[str]) -> DataFrame:
    """One row per notice: ``keep`` columns, ``paragraph`` (line from 0), ``family``, ``score``, ``overlap``, ``notice``."""
    bare = docs.select("text", *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    sent = docs.sparkSession.sparkContext.broadcast(scanner)  # a table of fixed size

    def judge(batches):
        s = sent.value
        w, base = s.weights[:-1], s.weights[-1]
        ahead = (w[:, 1:] - w[:, :1]).max(axis=1)
        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for first, end, d, o in ragged.chunks(data, offsets):
                words, line, begin, until, text, number = paragraphs(d, o)
                held, own, of = windows(words, line, len(begin))
                size = np.bincount(own, minlength=len(of))
                found, window = grams(held, own)
                # no class can be ahead of none where the sum of the best leads isn't
                norm = np.sqrt(np.maximum(size, 1))
                lead = np.bincount(window, np.maximum(ahead[found], 0.0), len(of)) / norm + (base[1:] - base[0]).max()
                best: dict[int, tuple] = {}
                cut = np.cumsum(size) - size
                for i in np.flatnonzero(lead > 0):
                    mine = held[cut[i] : cut[i] + size[i]]
                    f, x = example(mine)
                    p = linear.softmax((x @ w[f] + base) / s.temperature)
                    if p[0] >= s.least or (of[i] in best and best[of[i]][0] <= p[0]):
                        continue
                    k = 1 + int(p[1:].argmax())
                    family, share = s.classes[k], 0.0
                    if k > 1:
                        have = runs_of(mine)
                        share = max(float(np.isin(t, have).mean()) for t in s.templates[family])
                    if k > 1 and (share < s.overlap or p[k] < s.least):
                        family = UNKNOWN
                    if family == UNKNOWN and (size[i] < 3 or (share == 0 and (k > 1 or p[k] < s.least))):
                        continue
                    best[of[i]] = (p[0], family, float(p[k]), share)
                out = [(i, *best[i][1:]) for i in sorted(best)]
                at = np.array([x[0] for x in out], np.int64)
                raw = d.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [c.slice(first, end - first).take(pa.array(text[at])) for c in batch.columns[1:]]
                    + [pa.array(number[at]), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.float64())]
                    + [pa.array([x[3] for x in out], pa.float64())]
                    + [pa.array([raw[begin[i] : until[i]].decode("utf-8", "replace") for i in at], pa.string())],
                    [*batch.schema.names[1:], "paragraph", "family", "score", "overlap", "notice"],
                )

    kinds = dict(bare.dtypes)
    schema = ", ".join(
        [f"_{i} {kinds[f'_{i}']}" for i in range(len(keep))]
        + ["paragraph bigint", "family string", "score double", "overlap double", "notice string"]
    )
    found = bare.mapInArrow(judge, schema)
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *found.columns[len(keep) :])


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice of every whole document."""
    docs = rows.table(spark, sf_dir, "documents")
    return scan(docs, fit(docs), ["doc_id"]).select("doc_id", "paragraph", "family", "score", "overlap")
