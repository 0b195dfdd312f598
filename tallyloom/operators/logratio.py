"""Log-ratio regression imputation: additive log-ratio coefficients and their fixed point.

With an intercept-only design every update depends on a row only through its missing pattern, so one
aggregation by pattern gathers all that the iteration needs: row count, sums of logs, sums of
squares. There are at most 2^D patterns; the iteration runs on them, and one projection then fills
the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import compositions as co
from tallyloom.operators.residual import allocate
from tallyloom.panel import half_least_positive, known_sum, residual


class FitError(ValueError):
    """A fit that the data can't carry."""


def prepared(panel: DataFrame, other: bool = True) -> DataFrame:
    """The panel with y: positive shares of the targets (and Other), null where unknown.

    Zeros become delta, half the least positive target share. A complete row takes Other from its
    residual and is closed. A partial row's known mass stays under 1 less a headroom of its gaps.
    """
    delta = half_least_positive(panel, with_other=False)
    raised = F.transform("c", lambda v: F.when(v == 0, F.col("delta")).otherwise(v / F.col("n")))
    gaps = F.size(F.filter("c", lambda v: v.isNull())) + F.lit(1 if other else 0)
    rows = panel.join(F.broadcast(delta)).withColumn("raised", raised)
    own = F.when(residual() > 0, residual() / F.col("n")).otherwise(F.col("delta"))
    whole = co.closure(F.concat("raised", F.array(own)) if other else F.col("raised"))
    room = 1 - F.greatest(F.lit(1e-12), gaps * F.col("delta"))
    mass = co.total(F.col("raised"))
    shrunk = F.transform("raised", lambda v: F.when(mass > room, v / mass * room).otherwise(v))
    partial = F.concat(shrunk, F.array(F.lit(None).cast("double"))) if other else shrunk
    return rows.withColumn("y", F.when(co.complete(F.col("c")), whole).otherwise(partial)).drop("raised", "delta")


def usable(rows: DataFrame) -> DataFrame:
    """Without complete rows that count nothing."""
    return rows.where(~(co.complete(F.col("c")) & (known_sum() == 0)))


def alr_start(rows: DataFrame, d: int, reference: int) -> DataFrame:
    """One row: rows, beta, the mean log-ratio of each part to the reference over complete rows."""
    part = lambda j: F.get("y", F.lit(j))
    return rows.where(co.complete(F.col("y"))).agg(F.count(F.lit(1)).alias("rows"), F.array(*(F.avg(F.log(part(j) / part(reference))) for j in range(d))).alias("beta"))


def pattern_statistics(rows: DataFrame, d: int) -> DataFrame:
    """By missing pattern (bits): n, sums of ln y by part, of ln R, of R^2 and of known y^2.

    R is what the known parts of a row leave of 1. A pattern has room for 31 parts, more are refused;
    alr.fit takes any number.
    """
    if d > 31:
        raise FitError(f"invalid_input: {d} parts, and a pattern holds 31")
    bits = co.total(F.transform("y", lambda v, j: F.when(v.isNull(), F.pow(F.lit(2.0), j)).otherwise(0.0))).cast("int")
    left = F.greatest(1 - co.total(F.col("y")), F.lit(1e-300))
    gaps = F.exists("y", lambda v: v.isNull())
    return rows.groupBy(bits.alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.coalesce(F.sum(F.log(F.get("y", F.lit(j)))), F.lit(0.0)) for j in range(d))).alias("log_sums"),
        F.coalesce(F.sum(F.when(gaps, F.log(left))), F.lit(0.0)).alias("log_left"),
        F.coalesce(F.sum(F.when(gaps, left * left)), F.lit(0.0)).alias("left_squares"),
        F.sum(co.total(F.transform("y", lambda v: v * v))).alias("known_squares"),
    )


@dataclass
class Fit:
    beta: list[float]
    iterations: int
    converged: bool
    history: list[float] = field(default_factory=list)


def iterate(patterns: list, start: list[float], reference: int, max_iter: int = 120, tol: float = 1e-8) -> Fit:
    """The fixed point on pattern statistics; history holds the relative changes from round two on."""
    d, beta, history = len(start), list(start), []
    count = sum(p["n"] for p in patterns)

    def shares(beta: list[float], pattern: int) -> list[float]:
        gone = [j for j in range(d) if pattern >> j & 1]
        top = max((beta[j] for j in gone), default=0.0)
        e = {j: math.exp(beta[j] - top) for j in gone}
        return [e[j] / sum(e.values()) if j in e else 0.0 for j in range(d)]

    before, converged, step = None, False, 0
    for step in range(1, max_iter + 1):
        now = {p["pattern"]: shares(beta, p["pattern"]) for p in patterns}
        sums = [0.0] * d
        for p in patterns:
            for j in range(d):
                sums[j] += p["log_left"] + p["n"] * math.log(now[p["pattern"]][j]) if p["pattern"] >> j & 1 else p["log_sums"][j]
        beta = [(s - sums[reference]) / count for s in sums]
        if before is not None:
            moved = sum(p["left_squares"] * sum((a - b) ** 2 for a, b in zip(now[p["pattern"]], before[p["pattern"]], strict=True)) for p in patterns)
            size = sum(p["known_squares"] + p["left_squares"] * sum(a * a for a in before[p["pattern"]]) for p in patterns)
            history.append(math.sqrt(moved) / math.sqrt(size))
            if history[-1] <= tol:
                converged = True
                break
        before = now
    return Fit(beta, step, converged, history)


def reference_part(panel: DataFrame, d: int) -> int:
    """The target with the fewest missing cells; the first among equals."""
    counts = panel.agg(*(F.count_if(F.get("c", F.lit(j)).isNull()).alias(f"m{j}") for j in range(d))).first()
    return min(range(d), key=lambda j: (counts[j], j))


def fit(panel: DataFrame, d: int = 4, other: bool = True, reference: int | None = None, max_iter: int = 120, tol: float = 1e-8) -> tuple[DataFrame, Fit, int]:
    """The prepared rows, the fit and the reference part. Needs more than one complete row."""
    rows = usable(prepared(panel, other))
    parts = d + (1 if other else 0)
    reference = reference_part(panel, d) if reference is None else reference
    start = alr_start(rows, parts, reference).first()
    if start["rows"] <= 1:
        raise FitError("insufficient_data: fewer than two complete rows")
    return rows, iterate(pattern_statistics(rows, parts).collect(), list(start["beta"]), reference, max_iter, tol), reference


def restored(rows: DataFrame, beta: list[float], other: bool = True) -> DataFrame:
    """rows with filled: the residual of n split over missing targets (and Other) by softmax(beta).

    Without Other the targets take all of it. Observed counts stay as they are.
    """
    d = len(beta)
    logits = F.array(*(F.lit(b) for b in beta))
    unknown = F.transform("c", lambda v: v.isNull())
    if other:
        unknown = F.concat(unknown, F.array(F.lit(True)))
    split = allocate(F.greatest(residual(), F.lit(0.0)), logits, unknown)
    return rows.withColumn("filled", F.transform("c", lambda v, i: F.coalesce(v, F.get(split, i)))).withColumn("_d", F.lit(d)).drop("_d")


def normal_equations(rows: DataFrame, xs: list[Column], y: Column) -> tuple[list[list[float]], list[float]]:
    """X'X and X'y of least squares by one aggregation; the first of xs may be a constant."""
    k = len(xs)
    found = rows.agg(*(F.sum(xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(xs[i] * y).alias(f"b{i}") for i in range(k))).first()
    return [[found[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], [found[f"b{i}"] for i in range(k)]


def ols(rows: DataFrame, xs: list[Column], y: Column) -> list[float]:
    """Least-squares coefficients; FitError where the design is rank deficient."""
    import numpy as np

    a, b = (np.array(m, float) for m in normal_equations(rows, xs, y))
    scale = np.sqrt(np.diag(a))
    if (scale == 0).any() or np.linalg.matrix_rank(a / scale / scale[:, None], tol=1e-12) < len(b):
        raise FitError("rank_deficient: the design has dependent columns")
    return np.linalg.solve(a, b).tolist()


def trimmed(rows: DataFrame, xs: list[Column], y: Column, keep: float = 0.75, steps: int = 10) -> list[float]:
    """Least trimmed squares by concentration steps from the full fit: refits on the best share.

    The cut is an approximate quantile of squared residuals, so a step is one aggregation.
    """
    beta = ols(rows, xs, y)
    for _ in range(steps):
        error = sum((F.lit(b) * x for b, x in zip(beta, xs, strict=True)), F.lit(0.0)) - y
        sized = rows.withColumn("_r", error * error)
        limit = sized.agg(F.percentile_approx("_r", keep, 100_000)).first()[0]
        new = ols(sized.where(F.col("_r") <= limit), xs, y)
        if max(abs(a - b) for a, b in zip(new, beta, strict=True)) < 1e-10:
            return new
        beta = new
    return beta
