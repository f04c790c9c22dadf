"""Vectors as array columns: norms, cosine and distances; nulls and empty vectors give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def normalised(x: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.greatest(norm(x), F.lit(1e-12))
    return F.transform(x, lambda v: v.cast("double") / n)


def distance(x: Column, y: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - cosine(x, y)
    if metric == "euclidean_l2":
        x, y = normalised(x), normalised(y)
    elif metric != "euclidean":
        raise ValueError(f"unknown metric {metric}")
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v))


def usable(x: Column) -> Column:
    """False for null, empty and zero vectors, which failed models leave."""
    return F.coalesce((F.size(x) > 0) & F.exists(x, lambda v: v != 0), F.lit(False))
