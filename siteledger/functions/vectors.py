"""Vector functions in double precision, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its norm; null for a zero vector."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))[0]


def truncated(a: Column, dims: int) -> Column:
    """The first dims dimensions, at norm 1 again."""
    return unit(F.slice(a, 1, dims))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def valid(a: Column, dims: int, slack: float = 1e-4) -> Column:
    """Of the right length, finite, at norm 1 within the slack."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dims) & finite & (F.abs(norm(a) - 1) <= slack), F.lit(False))
