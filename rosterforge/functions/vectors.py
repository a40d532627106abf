"""Vector arithmetic over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(a: Column) -> Column:
    """a over its length; a zero vector stays zero."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0]


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def literal(values: list[float]) -> Column:
    """A query vector as one foldable constant."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")
