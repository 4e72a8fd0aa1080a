"""Language identification by multinomial logistic regression on TF-IDF character n-grams.

Fitted by follow-the-regularised-leader with an elastic net on a bounded, stratified
sample of labelled rows; document frequencies cover every labelled training row;
probabilities are calibrated by a temperature on sample rows the fit hasn't seen.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Rows
without a language never train. With no training rows at all every text is ``und``.
Repeated rows and null ids get a result each; extra columns have no influence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import linear, ragged, rows

UNKNOWN = "und"
#: Share of held-back texts of a language that may fall below the reference of ``floor``.
RARE = 0.005
LATIN_LOWER = np.arange(256, dtype=np.uint8)
LATIN_LOWER[0x80:0x9F] += 0x20  # second byte after C3: the capitals of Latin-1
LATIN_LOWER[0x97] = 0x97

#: Odd multipliers of the characters of a gram, by place.
GRAM = [0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    orders: tuple[int, ...]
    log_bits: int
    #: Probability below which a text is in none of the languages.
    least: float = 0.0

    @property
    def features(self) -> int:
        return 1 << self.log_bits


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; the length stays."""
    out = ragged.LOWER[data]
    if len(out) > 1:
        after = np.flatnonzero(out[:-1] == 0xC3) + 1
        out[after] = LATIN_LOWER[out[after]]
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes; bytes that aren't UTF-8 stand for themselves."""
    text = data.tobytes()
    try:
        return np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return data[(data & 0xC0) != 0x80].astype(np.uint32)


def text_features(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], log_bits: int):
    """For each text the numbers of its character n-grams and how often each occurs (``log_bits`` up to 16)."""
    data = fold(data)
    points = code_points(data)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])[offsets]
    hashed = []
    for n in orders:
        total = np.full(max(0, len(points) - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            total += points[j : j + len(total)] * np.uint32(GRAM[j])
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D)
        total ^= total >> np.uint32(13)
        total *= np.uint32(0x297A2D39)
        hashed.append((total >> np.uint32(32 - log_bits)).astype(np.uint16))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        grams = np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(orders, hashed, strict=True)])
        grams.sort(kind="stable")  # by radix for 16 bits
        starts, ends = ragged.runs(grams)
        yield grams[starts], ends - starts


def weigh(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with dampened frequencies and unit length."""
    x = (1.0 + np.log(counts)) * idf[features]
    norm = float(np.sqrt(x @ x))
    return x / norm if norm else x


def document_frequencies(train: DataFrame, orders: tuple[int, ...], log_bits: int) -> tuple[int, np.ndarray]:
    """Rows, and rows holding each feature, over all of ``train``; tasks send fixed-size count arrays."""

    def count(batches):
        total, n = np.zeros(1 << log_bits, np.int64), 0
        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for first, end, d, o in ragged.chunks(data, offsets):
                n += end - first
                for features, _ in text_features(d, o, orders, log_bits):
                    total[features] += 1
        found = np.flatnonzero(total)
        blocks = found >> 12
        firsts, ends = ragged.runs(blocks)
        yield pa.RecordBatch.from_pylist(
            [{"block": -1, "counts": [n]}]
            + [
                {"block": int(blocks[a]), "counts": np.bincount(found[a:b] & 4095, total[found[a:b]], 4096).astype(np.int64).tolist()}
                for a, b in zip(firsts, ends, strict=True)
            ],
            schema=pa.schema([("block", pa.int32()), ("counts", pa.list_(pa.int64()))]),
        )

    sent = train.select("text").mapInArrow(count, "block int, counts array<bigint>")
    one = sent.select("block", F.posexplode("counts").alias("at", "n")).groupBy("block", "at").agg(F.sum("n").alias("n"))
    # at most 2 ** log_bits + 1 rows, whatever the input
    df, n = np.zeros(1 << log_bits), 0
    for r in one.collect():
        if r.block < 0:
            n += r.n
        else:
            df[(r.block << 12) + r.at] += r.n
    return n, df


def sample_features(sample: DataFrame, orders: tuple[int, ...], log_bits: int) -> list:
    """Features of the bounded sample, as rows of (language, calibrates, features, counts)."""

    def extract(batches):
        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for first, end, d, o in ragged.chunks(data, offsets):
                found = list(text_features(d, o, orders, log_bits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[first:end], batch.column(2)[first:end], batch.column(3)[first:end]]
                    + [pa.array([f[i].astype(np.int32).tobytes() for f in found], pa.binary()) for i in (0, 1)],
                    ["lang", "calibrates", "place", "features", "counts"],
                )

    return sample.mapInArrow(extract, "lang string, calibrates boolean, place bigint, features binary, counts binary").collect()


def fit(
    train: DataFrame,
    id_col: str = "doc_id",
    rows_per_language: int = 1000,
    orders: tuple[int, ...] = (1, 2, 3),
    log_bits: int = 16,
    epochs: int = 2,
    l1: float = 0.02,
    l2: float = 0.2,
) -> LanguageModel | None:
    """A model of the languages of ``train`` (text, lang, id); None if it has no labelled rows.

    ``rows_per_language``: expected number of rows of a language in the sample the
    weights are fitted on, drawn by a hash of id and text.
    """
    train = train.filter(F.col("lang").isNotNull()).select(
        F.col("text"), F.col("lang"), F.xxhash64(F.col(id_col).cast("string"), "text").alias("place")
    )
    sizes = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    n, df = document_frequencies(train, orders, log_bits)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_language / sizes[lang]))).otherwise(share)
    drawn = train.filter(F.pmod(F.col("place"), F.lit(1 << 30)) < share * (1 << 30)).select(
        "text", "lang", (F.pmod(F.shiftrightunsigned("place", 32), F.lit(5)) == 0).alias("calibrates"), "place"
    )
    got = sorted(sample_features(drawn, orders, log_bits), key=lambda r: (r.place, r.lang))
    code = {lang: i for i, lang in enumerate(languages)}
    examples = []
    for r in got:
        f = np.frombuffer(r.features, np.int32)
        examples.append((f, weigh(f, np.frombuffer(r.counts, np.int32), idf)))
    truth = np.array([code[r.lang] for r in got])
    held = np.array([r.calibrates for r in got])
    fitted = np.flatnonzero(~held) if (~held).any() else np.arange(len(got))
    model = linear.Ftrl(1 << log_bits, len(languages), alpha=2.0, l1=l1, l2=l2)
    model.fit([examples[i] for i in fitted], np.eye(len(languages))[truth[fitted]], epochs)
    weights = model.weights().astype(np.float32)
    back = np.flatnonzero(held)
    z = linear.logits([examples[i] for i in back], weights)
    heat = linear.temperature(z, truth[back])
    return LanguageModel(languages, idf, weights, heat, orders, log_bits, floor(z, heat, truth[back]))


def floor(z: np.ndarray, heat: float, truth: np.ndarray) -> float:
    """Halfway from chance to the probability that all but ``RARE`` of the rightly named held-back texts exceed.

    A text without any known n-gram gets about the same probability for all languages, a
    short text of a language less than a long one; 0 without held-back texts or with one language.
    """
    if not len(z) or z.shape[1] < 2:
        return 0.0
    p = linear.softmax(z / heat)
    right = p[np.arange(len(p)), truth][p.argmax(axis=1) == truth]
    chance = 1.0 / z.shape[1]
    return chance + max(0.0, float(np.quantile(right, RARE)) - chance) / 2 if len(right) else 0.0


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: does it hold a letter of any script."""
    low = data | 0x20
    sums = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    out = (sums[offsets[1:]] - sums[offsets[:-1]]) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score``, the calibrated probability."""
    bare = docs.select("text", *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    if model is None:
        return bare.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** log_bits rows of weights at most

    def label(batches):
        m = sent.value
        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for first, end, d, o in ragged.chunks(data, offsets):
                z = np.zeros((end - first, len(m.languages)))
                for i, (f, c) in enumerate(text_features(d, o, m.orders, m.log_bits)):
                    z[i] = weigh(f, c, m.idf) @ m.weights[f] + m.weights[-1]
                p = linear.softmax(z / m.temperature)
                best = p.argmax(axis=1)
                known = has_letter(d, o)
                names = np.where(known, np.array(m.languages, object)[best], UNKNOWN)
                score = np.where(known, p[np.arange(len(p)), best], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(first, end - first) for c in batch.columns[1:]] + [pa.array(names, pa.string()), pa.array(score)],
                    [*batch.schema.names[1:], "lang_pred", "score"],
                )

    kinds = dict(bare.dtypes)
    schema = "".join(f"_{i} {kinds[f'_{i}']}, " for i in range(len(keep))) + "lang_pred string, score double"
    return bare.mapInArrow(label, schema).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from the documents that aren't held out."""
    docs = rows.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(rows.training("doc_id", 3, 1)))
    marked = docs.withColumn("held_out", ~rows.training("doc_id", 3, 1))
    return predict(marked, model, ["doc_id", "held_out"])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognisable language; the columns stay as they are.

    Fitted on the documents' own ``lang`` like ``op7_langid``. Rejected: ``und``, and
    texts whose calibrated probability is below the model's ``least``, which follows from
    held-back texts (``floor``); without any labelled document all are ``und``.
    """
    model = fit(docs.filter(rows.training("doc_id", 3, 1)))
    least = model.least if model else 0.0
    places = [f"_place{i}" for i in range(len(docs.columns))]
    flat = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, places, strict=True)], F.col("text"))
    found = predict(flat, model, places).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, places, strict=True)])
