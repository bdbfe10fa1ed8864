"""Vectors as arrays: products, norms, cosines, weighted combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; NULL where it has none."""
    return F.transform(a, lambda x: x.cast("double") / F.nullif(norm(a), F.lit(0.0)))


def combine(parts: list[tuple[Column, float]]) -> Column:
    """Weighted sum of the vectors that are present, weights shared out anew, at length 1."""
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    size = F.greatest(*[F.coalesce(F.size(v), F.lit(0)) for v, _ in parts]) if len(parts) > 1 else F.size(parts[0][0])
    zeros = F.array_repeat(F.lit(0.0), size)
    out = zeros
    for v, w in parts:
        share = F.lit(w) / F.nullif(total, F.lit(0.0))
        part = F.transform(F.coalesce(v, zeros), _times(share))
        out = F.zip_with(out, part, lambda s, x: s + x)
    return unit(out)


def _times(share: Column):
    return lambda x: x.cast("double") * share
