"""Compositional functions on ARRAY<DOUBLE> columns, all inside the JVM.

Arrays hold parts in a fixed order; a null part is unknown. Functions that need every part give
null if one is missing, and null instead of an error outside their domain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum of the known parts, in order."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def known(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: v.isNotNull()))


def complete(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull())


def closure(x: Column) -> Column:
    """x over its sum; null where the sum isn't positive."""
    s = total(x)
    return F.when(s > 0, F.transform(x, lambda v: v / s))


def clr(x: Column) -> Column:
    """Centred log-ratio; null unless all parts are positive."""
    good = F.forall(x, lambda v: F.coalesce(v > 0, F.lit(False)))
    logs = F.transform(x, lambda v: F.log(v))
    mean = total(logs) / F.size(x)
    return F.when(good, F.transform(logs, lambda v: v - mean))


def softmax(z: Column) -> Column:
    """Stable inverse of clr."""
    top = F.array_max(z)
    return closure(F.transform(z, lambda v: F.exp(v - top)))


def pivot_basis(d: int) -> list[list[float]]:
    """Rows of an orthonormal basis of the clr plane: part k against those after it."""
    rows = []
    for k in range(1, d):
        rest = d - k
        scale = math.sqrt(rest / (rest + 1))
        rows.append([0.0] * (k - 1) + [scale] + [-scale / rest] * rest)
    return rows


def dot(x: Column, weights: list[float]) -> Column:
    return total(F.zip_with(x, F.array(*(F.lit(w) for w in weights)), lambda a, b: a * b))


def ilr(x: Column, d: int) -> Column:
    z = clr(x)
    return F.when(z.isNotNull(), F.array(*(dot(z, row) for row in pivot_basis(d))))


def ilr_inverse(y: Column, d: int) -> Column:
    basis = pivot_basis(d)
    return softmax(F.array(*(dot(y, [basis[k][j] for k in range(d - 1)]) for j in range(d))))


def jsd(x: Column, y: Column) -> Column:
    """sum x ln(x/m) + y ln(y/m), m the mean; 0 ln 0 = 0; never negative. Twice the usual measure."""
    term = lambda a, m: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    parts = F.zip_with(x, y, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.greatest(total(parts), F.lit(0.0))


def aitchison(x: Column, y: Column) -> Column:
    """Distance of the clr images."""
    return F.sqrt(total(F.zip_with(clr(x), clr(y), lambda a, b: (a - b) * (a - b))))


def median_of(x: Column) -> Column:
    """Median of the known values; the mean of the middle two of an even number."""
    s = F.array_sort(F.filter(x, lambda v: v.isNotNull()))
    n = F.size(s)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.element_at(s, F.greatest(low, F.lit(1))) + F.element_at(s, F.least(high, n))) / 2)


def power_mean(values: list[Column] | Column, alpha: float) -> Column:
    """Fréchet mean of closed compositions (an array of arrays) for exponent alpha, closed.

    alpha 1: arithmetic; alpha 0: geometric on the common support; between: (mean x^alpha)^(1/alpha).
    """
    n = F.size(values).cast("double")
    zero = F.transform(F.element_at(values, 1), lambda v: F.lit(0.0))
    plus = lambda f: F.aggregate(values, zero, lambda a, x: F.zip_with(a, x, lambda s, v: s + f(v)))
    if alpha == 1:
        return closure(F.transform(plus(lambda v: v), lambda s: s / n))
    if alpha == 0:
        least = F.aggregate(values, F.element_at(values, 1), lambda a, x: F.zip_with(a, x, lambda u, v: F.least(u, v)))
        logs = plus(lambda v: F.when(v > 0, F.log(v)).otherwise(0.0))
        return closure(F.zip_with(logs, least, lambda s, low: F.when(low > 0, F.exp(s / n)).otherwise(0.0)))
    return closure(F.transform(plus(lambda v: F.pow(v, F.lit(alpha))), lambda s: F.pow(s / n, F.lit(1 / alpha))))


def group_mean(rows: DataFrame, by: str, parts: str, alpha: float) -> DataFrame:
    """by, part, value: the Fréchet mean of each group's compositions, as plain aggregates of its parts."""
    v = F.col("v")
    raised = {1: F.avg(v), 0: F.when(F.min(v) > 0, F.exp(F.avg(F.log(F.when(v > 0, v))))).otherwise(0.0)}.get(alpha, F.pow(F.avg(F.pow(v, F.lit(alpha))), F.lit(1 / alpha if alpha else 1.0)))
    means = rows.select(by, F.posexplode(parts).alias("part", "v")).groupBy(by, "part").agg(raised.alias("m"))
    return means.select(by, "part", (F.col("m") / F.sum("m").over(Window.partitionBy(by))).alias("value"))  # a group has its parts only
