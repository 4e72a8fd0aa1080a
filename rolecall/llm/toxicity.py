"""Toxicity categories by a chain of linear classifiers.

The categories are predicted one after another; each link is a logistic regression on
the words of the text and on the probabilities of all earlier categories. While
training, those probabilities are out-of-fold: a row's earlier probabilities come from
models that haven't seen the row.

The labels say whether a text is toxic and whether it is of good quality. The chain is
``low_quality``, then one link per group of ``TERMS`` (toxic texts that hold a term of
the group), then ``toxic`` itself, whose probability is the score.

Defined results: a null or empty text gets the intercepts' probabilities; every row gets
one result; labels that are null or name no document don't train, of repeated labels the
worst counts; without labels all probabilities are 0; extra columns have no influence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import linear, ragged, rows

#: Words that tell the kinds of toxic text apart in training, in English, German, French and Spanish; what weighs in the end is learned.
TERMS = {
    "insult": (
        "idiot", "moron", "stupid", "dumb", "fool", "loser", "clown", "imbecile", "jerk", "coward",
        "dumm", "trottel", "dummkopf", "versager", "feigling", "idioten", "blöd",
        "stupide", "imbécile", "crétin", "lâche", "idiote", "perdant",
        "idiota", "estúpido", "estúpida", "tonto", "imbécil", "cobarde", "payaso",
    ),
    "degradation": (
        "trash", "garbage", "scum", "vermin", "filth", "worthless", "pathetic", "disgusting", "pig",
        "abschaum", "müll", "ungeziefer", "wertlos", "erbärmlich", "widerlich", "schwein",
        "ordure", "vermine", "pathétique", "dégoûtant", "minable", "porc",
        "basura", "escoria", "patético", "asqueroso", "inútil", "cerdo",
    ),
    "threat": (
        "kill", "murder", "hurt", "destroy", "burn", "shoot", "attack",
        "töten", "umbringen", "ermorden", "verletzen", "vernichten", "erschießen",
        "tuer", "assassiner", "blesser", "détruire", "brûler",
        "matar", "asesinar", "herir", "destruir", "quemar", "disparar",
    ),
}
LOG_BITS = 18
#: Lengths in characters of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)


@dataclass
class Chain:
    categories: list[str]
    weights: np.ndarray  # (2 ** LOG_BITS + categories + 1, categories); intercepts last
    threshold: float


def word_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs of the distinct words of each text and of the words' beginnings, sorted.

    Beginnings let inflected and compounded forms share weight. Only ``wanted`` features if given.
    """
    data = ragged.LOWER[data]
    starts, ends, text = ragged.token_spans(data, offsets, ragged.PUNCTUATION)
    sums = ragged.prefix(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first, size = np.searchsorted(lead, starts), np.searchsorted(lead, ends)
    size = size - first
    pairs = []
    for n in (0, *BEGINNINGS):  # 0: the whole word
        hit = size > n
        until = lead[first[hit] + n] if n else ends
        found = (ragged.span_hash(sums, starts[hit], until) * np.uint64(2 * n + 1) >> np.uint64(64 - LOG_BITS)).astype(np.int64)
        owner = text[hit]
        if wanted is not None:
            use = wanted[found]
            found, owner = found[use], owner[use]
        pairs.append((owner << LOG_BITS) | found)
    both = np.unique(np.concatenate(pairs))
    return both >> LOG_BITS, both & ((1 << LOG_BITS) - 1)


def term_features(words: tuple[str, ...]) -> np.ndarray:
    data, offsets = ragged.texts(pa.array(words))
    starts, ends, _ = ragged.token_spans(data, offsets)
    return (ragged.span_hash(ragged.prefix(data), starts, ends) >> np.uint64(64 - LOG_BITS)).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str) -> list:
    """(place, quality, toxic, features) of about ``max_rows`` labelled texts, half of them toxic if there are so many."""
    marks = (
        labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"), F.coalesce(F.min("quality"), F.lit(1)).cast("int").alias("quality"))
        .withColumn("place", F.xxhash64(F.col("_id").cast("string")))
    )
    sizes = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for kind, size in sizes.items():
        share = F.when(F.col("toxic") == kind, F.lit(min(1.0, max_rows / 2 / size))).otherwise(share)
    drawn = marks.filter(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30))  # about max_rows rows
    joined = docs.select(F.col(id_col).alias("_id"), "text").join(F.broadcast(drawn), "_id").select("text", "place", "quality", "toxic")

    def extract(batches):
        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for first, end, d, o in ragged.chunks(data, offsets):
                text, found = word_features(d, o)
                cut = np.searchsorted(text, np.arange(end - first + 1))
                words = [found[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(first, end - first) for c in batch.columns[1:]] + [pa.array(words, pa.binary())],
                    [*batch.schema.names[1:], "features"],
                )

    return joined.mapInArrow(extract, "place bigint, quality int, toxic int, features binary").collect()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    max_rows: int = 5000,
    folds: int = 3,
    epochs: int = 3,
    l1: float = 6.0,
    l2: float = 0.0,
    threshold: float = 0.5,
) -> Chain | None:
    """The chain, fitted on a sample of about ``max_rows`` labelled documents; None without labels."""
    got = sorted(sample(docs, labels, max_rows, id_col), key=lambda r: (r.place, r.features))
    if not got:
        return None
    words = [np.frombuffer(r.features, np.int32).astype(np.int64) for r in got]
    toxic = np.array([r.toxic > 0 for r in got])
    truths = {"low_quality": np.array([r.quality < 1 for r in got])}
    for name, terms in TERMS.items():
        listed = term_features(terms)
        truths[name] = toxic & np.array([np.isin(w, listed).any() for w in words])
    truths["toxic"] = toxic
    fold = np.array([(r.place >> 40) % folds for r in got])
    earlier = np.zeros((len(got), 0))
    size, links = 1 << LOG_BITS, len(truths)
    weights = np.zeros((size + links + 1, links), np.float32)
    for link, truth in enumerate(truths.values()):
        places = size + np.arange(link)
        examples = [
            (np.concatenate([w, places]), np.concatenate([np.ones(len(w)), p])) for w, p in zip(words, earlier, strict=True)
        ]
        target = truth.astype(float)[:, None]

        def trained(chosen, examples=examples, target=target):
            model = linear.Ftrl(size + links, 1, alpha=1.0, l1=l1, l2=l2)
            return model.fit([examples[i] for i in chosen], target[chosen], epochs).weights()

        own = np.zeros(len(got))
        for k in range(folds):
            out, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(out):
                own[out] = linear.sigmoid(linear.logits([examples[i] for i in out], trained(rest if len(rest) else out))[:, 0])
        weights[:, link] = trained(np.arange(len(got)))[:, 0]
        earlier = np.column_stack([earlier, own])
    return Chain(list(truths), weights, threshold)


def score(docs: DataFrame, chain: Chain | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of each row with ``p_<category>`` for each link, ``score`` and ``toxic``."""
    names = chain.categories if chain else ["low_quality", *TERMS, "toxic"]
    bare = docs.select("text", *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    back = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]
    if chain is None:
        return bare.select(*back, *[F.lit(0.0).alias(f"p_{c}") for c in names], F.lit(0.0).alias("score"), F.lit(False).alias("toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # a table of fixed size

    def judge(batches):
        w = sent.value.weights
        words, links, base = w[: 1 << LOG_BITS], w[1 << LOG_BITS : -1], w[-1]
        wanted = (words != 0).any(axis=1)
        for batch in batches:
            data, offsets = ragged.texts(batch.column(0))
            for first, end, d, o in ragged.chunks(data, offsets):
                text, found = word_features(d, o, wanted)
                p = np.zeros((end - first, len(names)))
                for k in range(len(names)):
                    z = base[k] + np.bincount(text, words[found, k], end - first) + p[:, :k] @ links[:k, k]
                    p[:, k] = linear.sigmoid(z)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(first, end - first) for c in batch.columns[1:]] + [pa.array(np.ascontiguousarray(x)) for x in p.T],
                    [*batch.schema.names[1:], *[f"p_{c}" for c in names]],
                )

    kinds = dict(bare.dtypes)
    schema = ", ".join([f"_{i} {kinds[f'_{i}']}" for i in range(len(keep))] + [f"p_{c} double" for c in names])
    last = F.col(f"p_{names[-1]}")
    return bare.mapInArrow(judge, schema).select(
        *back, *[f"p_{c}" for c in names], last.alias("score"), (last >= chain.threshold).alias("toxic")
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and verdict of every whole document; trained on the table ``labels``."""
    docs = rows.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, rows.table(spark, sf_dir, "labels")), ["doc_id"])
