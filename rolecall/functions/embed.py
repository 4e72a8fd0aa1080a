"""Text -> vector, in batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of the default vectors.
DIM = 256


def word_counts(df: DataFrame, text: str, dim: int = DIM) -> DataFrame:
    """Adds ``_counts``: the hashed words of the whole text; the same for a text in any batch."""
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim)
    return counts.transform(words.transform(df.withColumn("_text", F.coalesce(text, F.lit(""))))).drop("_text", "_words")


def fit_weights(df: DataFrame, text: str, dim: int = DIM) -> IDFModel:
    """Inverse document frequencies of a corpus, one number per dimension.

    Save it with ``model.save(path)``, load it with ``IDFModel.load(path)`` and use it for
    postings and resumes alike: vectors compare only under one model.
    """
    return IDF(inputCol="_counts", outputCol="_weights").fit(word_counts(df, text, dim))


def hashed_embedding(
    df: DataFrame, text: str, out: str = "embedding", dim: int = DIM, weights: IDFModel | None = None
) -> DataFrame:
    """Unit vectors of hashed words, weighted by ``weights`` if a model is given. Nothing is fitted here."""
    counted = word_counts(df, text, dim)
    weighted = counted.withColumn("_weights", F.col("_counts")) if weights is None else weights.transform(counted)
    unit = Normalizer(inputCol="_weights", outputCol="_unit").transform(weighted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_counts", "_weights", "_unit")


def embed_text(
    df: DataFrame,
    text: str,
    encoder: Callable | None = None,
    out: str = "embedding",
    batch_size: int = 256,
    weights: IDFModel | None = None,
) -> DataFrame:
    """Adds a vector per text.

    ``encoder`` is a function without arguments that loads a model once per
    Python worker and returns a function from a numpy array of texts to a matrix
    of vectors. Without one, ``hashed_embedding``
    is used, with ``weights`` from ``fit_weights`` if given.
    """
    if encoder is None:
        return hashed_embedding(df, text, out, weights=weights)
    predict = predict_batch_udf(encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, predict(F.coalesce(text, F.lit(""))))


def model_name(weights: IDFModel | None = None, dim: int = DIM, encoder: str | None = None) -> str:
    """The fingerprint stored with each vector: of the named encoder, or of hashed words and their weights."""
    if encoder is not None:
        return f"encoder:{encoder}"
    if weights is None:
        return f"hashed:{dim}"
    rounded = ",".join(f"{w:.12g}" for w in weights.idf.toArray())
    return f"hashed:{dim}:{hashlib.sha256(rounded.encode()).hexdigest()[:16]}"


def stamped(df: DataFrame, model: str, vector: str = "embedding", out: str = "embedding_model") -> DataFrame:
    """``df`` with the model of each vector; none where there is no vector."""
    return df.withColumn(out, F.when(F.col(vector).isNotNull(), F.lit(model)))


def one_model(*frames: DataFrame, column: str = "embedding_model") -> str | None:
    """The model of all vectors of ``frames``; more than one is an error, as vectors compare only within a model."""
    found: set[str] = set()
    for df in frames:
        lowest, highest = df.agg(F.min(column), F.max(column)).first()
        found |= {m for m in (lowest, highest) if m is not None}
    if len(found) > 1:
        raise ValueError("vectors of different models: " + ", ".join(sorted(found)))
    return next(iter(found), None)


def stale_vectors(
    texts: DataFrame, vectors: DataFrame, model: str, key: str = "id", text: str = "text"
) -> DataFrame:
    """Rows of ``texts`` (``key, text``) without a vector of ``model`` for the text they have now.

    ``vectors`` has ``key, text_hash, embedding_model``. A row is stale if it is new, if
    its text has changed, or if another model has made its vector. Only hashes travel.
    """
    marked = texts.withColumn("text_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    fresh = vectors.filter(F.col("embedding_model") == model).select(key, "text_hash")
    stale = marked.select(key, "text_hash").join(fresh, [key, "text_hash"], "left_anti").select(key)
    return marked.join(stale.distinct(), key, "left_semi")


def refresh_vectors(
    texts: DataFrame,
    vectors: DataFrame,
    model: str,
    embed: Callable[[DataFrame, str], DataFrame],
    key: str = "id",
    text: str = "text",
) -> DataFrame:
    """``key, text_hash, embedding_model, embedding`` for every row of ``texts``; only stale ones are embedded again."""
    stale = stale_vectors(texts, vectors, model, key, text)
    made = embed(stale, text).withColumn("embedding_model", F.lit(model))
    columns = [key, "text_hash", "embedding_model", "embedding"]
    wanted = texts.select(key, F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    kept = vectors.filter(F.col("embedding_model") == model).join(wanted, [key, "text_hash"], "left_semi")
    return kept.select(*columns).unionByName(made.select(*columns))
