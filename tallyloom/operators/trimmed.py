"""Least trimmed squares: the line whose h smallest squared residuals have the least sum.

All starts are rows of one plan. A round sizes every row's residual under every start, finds each
start's h-th smallest exactly by counting in placed ranges, and refits on the h rows by one
aggregation; cross products by start are all that the driver sees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.logratio import FitError
from tallyloom.operators.quantiles import quantiles
from tallyloom.storage import saved

#: With so few choices of h rows every one of them is fitted.
EXACT_LIMIT = 5000


@dataclass
class Trimmed:
    """certified: all choices of h rows were fitted, so that no line is better. skipped: starts without full rank."""

    beta: list[float]
    objective: float
    h: int
    solver: str
    certified: bool
    valid: int
    skipped: int


def solve(row, width: int) -> list[float] | None:
    """The fit of one start's cross products; None without full rank."""
    import numpy as np

    if row is None:
        return None
    a, b = np.zeros((width, width)), np.array(row["xv"], float)
    upper = [(i, k) for i in range(width) for k in range(i, width)]
    for (i, k), v in zip(upper, row["xx"], strict=True):
        a[i, k] = a[k, i] = v
    scale = np.sqrt(np.diag(a))
    if (scale == 0).any() or np.linalg.matrix_rank(a / scale / scale[:, None], tol=1e-12, hermitian=True) < width:
        return None
    beta = np.linalg.solve(a / scale / scale[:, None], b / scale) / scale
    return beta.tolist() if np.isfinite(beta).all() else None


def products(rows: DataFrame, width: int, *more: Column) -> dict[int, object]:
    """Cross products of x and v by start, a row a start, and more aggregates."""
    x = [F.get("x", F.lit(k)) for k in range(width)]
    sums = rows.groupBy("start").agg(F.array(*(F.sum(x[i] * x[k]) for i in range(width) for k in range(i, width))).alias("xx"), F.array(*(F.sum(x[k] * F.col("v")) for k in range(width))).alias("xv"), *more)
    return {r["start"]: r for r in sums.collect()}


def sized(rows: DataFrame, betas: dict[int, list[float]]) -> DataFrame:
    """rows once for each start, with r, the squared residual."""
    lines = F.array(*(F.struct(F.lit(s).alias("start"), F.array(*(F.lit(b) for b in beta)).alias("beta")) for s, beta in betas.items()))
    error = F.aggregate(F.zip_with("x", "line.beta", lambda a, b: a * b), -F.col("v"), lambda t, u: t + u)
    return rows.withColumn("line", F.explode(lines)).select("key", "x", "v", F.col("line.start").alias("start"), (error * error).alias("r"))


def best_rows(errors: DataFrame, h: int, starts: list[int]) -> DataFrame:
    """Of each start the h rows with the smallest r, equal ones by key."""
    cut = {r["start"]: r["quantile"] for r in quantiles(errors, ["start"], F.col("r"), at=F.lit(h - 1)).collect()}
    limit = F.create_map(*(F.lit(v) for s in starts for v in (s, cut[s])))[F.col("start")]
    counts = errors.groupBy("start").agg(F.count_if(F.col("r") < limit).alias("below"), F.count_if(F.col("r") == limit).alias("same")).collect()
    taken = F.col("r") <= limit
    if any(c["below"] + c["same"] > h for c in counts):
        more = F.create_map(*(F.lit(v) for c in counts for v in (c["start"], h - c["below"] - 1)))[F.col("start")]
        last = {r["start"]: int(r["quantile"]) for r in quantiles(errors.where(F.col("r") == limit), ["start"], F.col("key"), at=more).collect()}
        taken = (F.col("r") < limit) | ((F.col("r") == limit) & (F.col("key") <= F.create_map(*(F.lit(v) for s in starts for v in (s, last[s])))[F.col("start")]))
    return errors.where(taken)


def every_choice(rows: DataFrame, n: int, h: int, width: int) -> Trimmed:
    """Fits all choices of h of the n rows; there are at most EXACT_LIMIT, so n is small unless h is n."""
    spark = rows.sparkSession
    left_out = list(combinations(range(n), n - h))
    choices = spark.createDataFrame([(s, list(out)) for s, out in enumerate(left_out)], "start int, gone array<int>")
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy("key")) - 1) if h < n else rows.withColumn("place", F.lit(-1))
    chosen = placed.join(F.broadcast(choices), ~F.array_contains("gone", F.col("place")))
    betas = {s: b for s, row in products(chosen, width).items() if (b := solve(row, width)) is not None}
    if not betas:
        raise FitError("rank_deficient: no choice of rows has full rank")
    lines = spark.createDataFrame(list(betas.items()), "start int, beta array<double>")
    error = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), -F.col("v"), lambda t, u: t + u)
    best = chosen.join(F.broadcast(lines), "start").groupBy("start").agg(F.sum(error * error).alias("objective")).orderBy("objective", "start").first()
    skipped = len(left_out) - len(betas)
    return Trimmed(betas[best["start"]], best["objective"], h, "every_choice", skipped == 0, len(betas), skipped)


def lts(rows: DataFrame, xs: list[Column], y: Column, key: Column, h: int | None = None, starts: int = 64, steps: int = 50, seed: int = 0, exact: int = EXACT_LIMIT) -> Trimmed:
    """Least trimmed squares of y on xs, where one of xs may be a constant.

    key: whole numbers below 2^53, unique (repeated rows need keys of their own). h: rows kept, by
    default half of them and the parameters. Rows with a null in y or xs take no part. Starts are the
    fit of all rows and `starts` fits of as many seeded rows as there are parameters; each is
    concentrated until it rests, at most `steps` times. FitError: h out of range (an empty table too),
    or no start of full rank.
    """
    width = len(xs)
    base = saved(rows.select(key.cast("long").alias("key"), F.array(*(x.cast("double") for x in xs)).alias("x"), y.cast("double").alias("v")).where("v IS NOT NULL AND forall(x, a -> a IS NOT NULL)"), "trimmed")
    n = base.count()
    h = (n + width + 1) // 2 if h is None else h
    if not width <= h <= n:
        raise FitError(f"insufficient_data: h = {h} isn't between {width} parameters and {n} rows")
    if starts < 1 or steps < 1:
        raise ValueError("starts and steps are at least 1")
    fewer = min(h, n - h)
    if fewer <= 64 and math.comb(n, fewer) <= exact:
        return every_choice(base, n, h, width)
    # A start's rows: of each of as many hash classes as there are parameters the first by another hash.
    draws = base.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(starts))))
    classed = draws.withColumn("class", F.pmod(F.xxhash64("key", "start", F.lit(seed)), F.lit(width)))
    few = classed.groupBy("start", "class").agg(F.min_by(F.struct("x", "v"), F.struct(F.xxhash64("start", "key", F.lit(seed)), "key")).alias("row")).select("start", "row.*")
    sums = products(few, width) | products(base.withColumn("start", F.lit(0)), width)
    active = {s: b for s, row in sorted(sums.items()) if (b := solve(row, width)) is not None}
    valid, skipped, done = len(active), starts + 1 - len(active), {}
    for _ in range(steps):
        if not active:
            break
        found = products(best_rows(sized(base, active), h, list(active)), width, F.sum("r").alias("objective"))
        after = {}
        for s, beta in active.items():
            done[s] = (found[s]["objective"], beta)
            new = solve(found[s], width)
            if new is not None and any(abs(a - b) > 1e-12 + 1e-12 * abs(b) for a, b in zip(new, beta, strict=True)):
                after[s] = new
        active = after
    if not done:
        raise FitError("rank_deficient: no start has full rank")
    _, best = min((value[0], s) for s, value in done.items())
    return Trimmed(done[best][1], done[best][0], h, "concentration", False, valid, skipped)
