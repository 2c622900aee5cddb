"""Vector expressions over ``array<float>`` columns, evaluated in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    """An ``array<double>`` constant."""
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, left to right."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def magnitude(v: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, a_norm: Column, b: Column, b_norm: Column) -> Column:
    """Cosine from precomputed norms; 0 where either norm is 0, never clamped."""
    return F.when((a_norm == 0) | (b_norm == 0), F.lit(0.0)).otherwise(dot(a, b) / (a_norm * b_norm))


def l2_normalize(v: Column) -> Column:
    """Divides by the norm where it is above 0."""
    norm = magnitude(v)
    scaled = F.transform(v, lambda x: x.cast("double") / norm)
    return F.when(norm > 0, scaled).otherwise(v.cast("array<double>"))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; null where none is.

    ``vectors`` is ``array<array<double>>``, ``mask`` an ``array<int>`` of the same length.
    """
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda t: t["m"] == 1)
    rows = F.transform(kept, lambda t: t["v"])
    total = F.aggregate(
        rows,
        F.transform(F.element_at(rows, 1), lambda x: F.lit(0.0)),
        lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double")),
    )
    return F.when(F.size(rows) > 0, F.transform(total, lambda x: x / F.size(rows)))
