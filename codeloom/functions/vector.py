"""Vector functions over array<float> columns, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _c


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Between 0 and 1; 0 for empty vectors, vectors of unequal length and zero vectors."""
    x, y = _c(a), _c(b)
    bottom = norm(x) * norm(y)
    value = F.when((F.size(x) != F.size(y)) | (F.size(x) <= 0) | (bottom == 0), F.lit(0.0)).otherwise(dot(x, y) / bottom)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
