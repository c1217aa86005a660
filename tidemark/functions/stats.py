"""Aggregate expressions with defined results for empty and constant input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default).cast("double"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; 0 for fewer than two rows or a constant side."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    cov = n * F.sum(x * y) - sx * sy
    var = F.sqrt(F.greatest(n * F.sum(x * x) - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * F.sum(y * y) - sy * sy, F.lit(0.0)))
    return F.when(n < 2, 0.0).otherwise(F.coalesce(F.try_divide(cov, var), F.lit(0.0)))


def ranked(values: Column, q: float, rank: str) -> Column:
    """Quantile of a sorted array by place: 'even' rounds the place half to even, 'floor' cuts it."""
    place = F.lit(q) * (F.size(values) - 1)
    return F.element_at(values, ((F.bround(place) if rank == "even" else F.floor(place)) + 1).cast("int"))


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return p, r, safe_ratio(2 * p * r, p + r)
