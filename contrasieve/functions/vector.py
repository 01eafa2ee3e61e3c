"""Column functions on ARRAY<FLOAT|DOUBLE> vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays zero.

    The norm is bound once as the single element of an outer array; written directly inside
    the lambda it would be recomputed for every dimension.
    """
    unit = F.transform(
        F.array(l2_norm(a)),
        lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))),
    )
    return F.get(unit, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either side is a zero vector."""
    size = l2_norm(a) * l2_norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
