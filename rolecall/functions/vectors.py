"""Vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_AVAILABLE

# Bonus per matched skill, its limit, and the limit of a score.
BONUS_PER_SKILL = 4
BONUS_LIMIT = 20
SCORE_LIMIT = 100


def from_json(text: Column) -> Column:
    """JSON list -> vector; anything else is NULL."""
    return F.from_json(text, "array<double>")


def to_json(vector: Column, description: Column) -> Column:
    """Vector -> JSON list of its exact values; NULL for a posting without a description."""
    return F.when(description != NOT_AVAILABLE, F.to_json(vector.cast("array<double>")))


def is_usable(vector: Column, dim: int | None = None) -> Column:
    """A non-empty vector of the right length without NULL, NaN or infinite entries."""
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.size(vector) > 0 if dim is None else F.size(vector) == dim
    return F.coalesce(vector.isNotNull() & length & sound, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.sqrt(squares)


def cosine_percent(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity times 100 from precomputed norms; a zero vector scores 0."""
    scale = norm_a * norm_b
    return F.when(scale > 0, dot(a, b) / scale * 100).otherwise(F.lit(0.0))


def with_bonus(score: Column, matched: Column) -> Column:
    """Score plus the skill bonus, capped; a score without matches stays as it is."""
    bonus = F.least(matched * BONUS_PER_SKILL, F.lit(BONUS_LIMIT))
    return F.when(matched > 0, F.least(score + bonus, F.lit(float(SCORE_LIMIT)))).otherwise(score)
