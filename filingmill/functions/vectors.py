"""Vector helpers on array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NULL when either vector is all zeros."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def volume_score(similarity: Column, total: Column) -> Column:
    """Similarity weighted by the logarithm of the filing count."""
    return similarity * F.log1p(F.greatest(F.coalesce(total, F.lit(0)), F.lit(0)))


def to_literal(vector: Column) -> Column:
    return F.to_json(vector)


def from_literal(text: Column) -> Column:
    return F.from_json(text, "array<float>")
