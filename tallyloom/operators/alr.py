"""Log-ratio regression with covariates: parts against a reference part, gaps refilled until they rest.

logratio has the case of a lone intercept, where missing patterns decide everything. Here each row has
covariates of its own. A step needs cross products only: they are summed by the pattern of usable
parts in one aggregation and then merged for each pair (part, reference) on Spark, so that the driver
gets a row a part, whatever the number of rows and patterns. In version 2 a row's filling depends on
its known parts and the coefficients alone, so a round is one aggregation over the given rows and
writes nothing; version 1 goes on from its last filling, which is written each round.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import compositions as co
from tallyloom.operators.logratio import FitError
from tallyloom.storage import release, saved

EXACT = 1e-10


@dataclass(frozen=True)
class Options:
    """version v1 or v2; rows of the first fit: complete or pairwise (null: as author_code says).

    author_code: pairwise rows, and in version 2 the reference is filled anew in each partial row even
    where it is known. shift is added to each known part and taken out by rescaling at the end
    (unless rescale is false). fixed: all max_iter rounds, whatever the change.
    """

    version: str = "v2"
    reference: int | None = None
    shift: float = 0.0
    max_iter: int = 50
    tol: float = 1e-8
    author_code: bool = False
    fit_rows: str | None = None
    rescale: bool = True
    fixed: bool = False

    def __post_init__(self):
        if self.version not in ("v1", "v2") or self.fit_rows not in (None, "complete", "pairwise"):
            raise ValueError("version is v1 or v2, fit_rows complete or pairwise")
        if not (math.isfinite(self.shift) and self.shift >= 0 and self.max_iter >= 1 and math.isfinite(self.tol) and self.tol >= 0):
            raise ValueError("shift and tol are finite and not negative, max_iter is at least 1")

    @property
    def pairwise(self) -> bool:
        return (self.fit_rows or ("pairwise" if self.author_code else "complete")) == "pairwise"


@dataclass
class Fit:
    """coefficients and rows of the first fit by part (zeros and 0 for the reference), and how it went.

    history has the relative change of each round, null for a first round that had gaps to fill.
    """

    options: Options
    reference: int
    coefficients: list[list[float]]
    supports: list[int]
    history: list[float | None] = field(default_factory=list)

    @property
    def converged(self) -> bool:
        return bool(self.history) and self.history[-1] is not None and self.history[-1] <= self.options.tol


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split(row: Column, unknown: Column, logits: Column, total: float) -> Column:
    """row with the unknown parts sharing what the others leave of total by the softmax of their logits."""
    left = F.greatest(F.lit(total) - co.total(F.zip_with(row, unknown, lambda v, m: F.when(~m, v))), F.lit(0.0))
    top = F.array_max(F.zip_with(logits, unknown, lambda z, m: F.when(m, z)))
    weights = lambda a: F.zip_with(logits, unknown, lambda z, m: F.when(m, F.exp(z - a["top"])))
    filled = lambda e, k: F.zip_with(row, e, lambda v, x: F.coalesce(x * k, v))
    return let(F.struct(left.alias("left"), top.alias("top")), lambda a: let(weights(a), lambda e: let(a["left"] / co.total(e), lambda k: filled(e, k))))


def in_turn(row: Column, logits: Column, reference: int, parts: int, total: float) -> Column:
    """row with each part in turn set anew together with the reference, the others held as they stand."""

    def turn(now: Column, j: Column) -> Column:
        moving = lambda i: (i == j) | (i == reference)
        done = split(now, F.transform(now, lambda v, i: v.isNull() | moving(i)), logits, total)
        return let(done, lambda s: F.transform(now, lambda v, i: F.when(moving(i), F.get(s, i)).otherwise(v)))

    return F.aggregate(F.array(*(F.lit(j) for j in range(parts) if j != reference)), row, turn)


def updated(state: Column, source: Column, fit: Fit) -> Column:
    """The next filling of a row. Complete rows stay; rows without any known part take the softmax."""
    parts, o = len(fit.coefficients), fit.options
    total = 1.0 + parts * o.shift
    logits = F.array(*(sum((F.get("z", F.lit(k)) * b for k, b in enumerate(beta[1:])), F.lit(beta[0])) for beta in fit.coefficients))
    gap = F.transform(source, lambda v, i: v.isNull() | (i == fit.reference) if o.author_code else v.isNull())
    none = F.forall(source, lambda v: v.isNull())
    known = F.forall(source, lambda v: v.isNotNull())
    if o.version == "v2":
        return F.when(known, source).otherwise(split(source, gap, logits, total))
    return F.when(known, source).when(none, split(source, F.transform(source, lambda v: F.lit(True)), logits, total)).otherwise(in_turn(state, logits, fit.reference, parts, total))


def cross_products(rows: DataFrame, x: Column, before: Column, parts: int, width: int, reference: int, whole: bool = False) -> DataFrame:
    """A row a part: part, n, zz and zl of the rows in which the part and the reference are positive.

    zz: the upper half of Z'Z, row by row; zl: Z' ln(part / reference); Z has a constant before the
    covariates. whole: only rows in which all parts are positive. moved and size: squared change of
    x from before (null where before has a gap) and squared size of before, over all rows.
    """
    design = [F.lit(1.0), *(F.get("z", F.lit(k)) for k in range(width - 1))]
    log = [F.when(F.get("x", F.lit(j)) > 0, F.log(F.get("x", F.lit(j)))) for j in range(parts)]
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sides = rows.select("z", x.alias("x"), before.alias("before"))
    usable = F.transform("x", lambda v: F.coalesce(v > 0, F.lit(False))).alias("usable")
    patterns = sides.groupBy(usable).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.sum(design[a] * design[b]) for a in range(width) for b in range(a, width))).alias("zz"),
        F.array(*(zero(design[a] * log[j]) for a in range(width) for j in range(parts))).alias("zl"),
        F.sum(co.total(F.zip_with("x", "before", lambda v, w: (v - w) * (v - w)))).alias("moved"),
        F.sum(co.total(F.transform("before", lambda w: w * w))).alias("size"),
        F.count_if(F.exists("before", lambda w: w.isNull())).alias("gaps"),
    )
    each = patterns.select("*", F.posexplode("usable").alias("part", "own"))
    fits = F.forall("usable", lambda u: u) if whole else F.col("own") & F.get("usable", F.lit(reference))
    took = lambda c: F.coalesce(F.sum(F.when(fits, c)), F.lit(0))
    ratio = lambda a: F.get("zl", F.lit(a * parts) + F.col("part")) - F.get("zl", F.lit(a * parts + reference))
    return each.groupBy("part").agg(
        took(F.col("n")).alias("n"),
        F.array(*(took(F.get("zz", F.lit(i))).cast("double") for i in range(width * (width + 1) // 2))).alias("zz"),
        F.array(*(took(ratio(a)).cast("double") for a in range(width))).alias("zl"),
        F.when(F.sum("gaps") == 0, F.sum("moved")).alias("moved"),
        F.sum("size").alias("size"),
    )


def solved(rows: list, parts: int, width: int, reference: int) -> tuple[list[list[float]], list[int]]:
    """Coefficients and rows by part of what cross_products() gave; FitError where they can't carry a fit."""
    import numpy as np

    found = {r["part"]: r for r in rows}
    beta, support = [[0.0] * width for _ in range(parts)], [0] * parts
    upper = [(a, b) for a in range(width) for b in range(a, width)]
    for j in range(parts):
        if j == reference:
            continue
        row = found[j]
        if row["n"] <= width:
            raise FitError(f"insufficient_data: part {j} has {row['n']} rows for {width} parameters")
        a = np.zeros((width, width))
        for (i, k), v in zip(upper, row["zz"], strict=True):
            a[i, k] = a[k, i] = v
        scale = np.sqrt(np.diag(a))
        if (scale == 0).any() or np.linalg.matrix_rank(a / scale / scale[:, None], tol=1e-12, hermitian=True) < width:
            raise FitError(f"rank_deficient: part {j}: the covariates of its rows depend on each other")
        beta[j] = (np.linalg.solve(a / scale / scale[:, None], np.array(row["zl"]) / scale) / scale).tolist()
        if not np.isfinite(beta[j]).all():
            raise FitError(f"numerical: part {j}: the coefficients aren't finite")
        support[j] = row["n"]
    return beta, support


def checked(rows: DataFrame, o: Options) -> tuple[DataFrame, int, int, int]:
    """rows with y shifted, the number of parts, of columns of the design, and the reference part.

    FitError: no rows; rows of another width; a covariate that is null or not finite; a part that
    isn't finite or, with the shift, not positive; known parts above 1; complete rows that don't sum to 1.
    """
    first = rows.select(F.size("y").alias("parts"), F.size("z").alias("covariates")).first()
    if first is None:
        raise FitError("insufficient_data: no rows")
    parts, width = first["parts"], first["covariates"] + 1
    if parts < 2 or (o.reference is not None and not 0 <= o.reference < parts):
        raise FitError("invalid_input: two parts at least, and the reference is one of them")
    odd = lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == math.inf), F.lit(False))
    mass = co.total(F.col("y"))
    tests = {
        "width": (F.size("y") != parts) | (F.size("z") != width - 1),
        "covariates": F.exists("z", lambda v: v.isNull() | odd(v)),
        "not_finite": F.exists("y", lambda v: odd(v)),
        "not_positive": F.exists("y", lambda v: F.coalesce(v + o.shift <= 0, F.lit(False))),
        "above_total": mass > 1 + EXACT,
        "not_closed": F.forall("y", lambda v: v.isNotNull()) & (F.abs(mass - 1) > EXACT),
    }
    counts = rows.agg(*(F.count_if(F.coalesce(t, F.lit(True))).alias(k) for k, t in tests.items()), *(F.count_if(F.get("y", F.lit(j)).isNull()).alias(f"m{j}") for j in range(parts))).first()
    for k in tests:
        if counts[k]:
            raise FitError(f"invalid_input: {k} in {counts[k]} rows")
    reference = min(range(parts), key=lambda j: (counts[f"m{j}"], j)) if o.reference is None else o.reference
    return rows.withColumn("y", F.transform("y", lambda v: v + o.shift)), parts, width, reference


def first_fit(rows: DataFrame, options: Options = Options()) -> tuple[DataFrame, Fit]:
    """The shifted rows and the regression on known parts only."""
    ready, parts, width, reference = checked(rows, options)
    y = F.col("y")
    beta, support = solved(cross_products(ready, y, y, parts, width, reference, not options.pairwise).collect(), parts, width, reference)
    return ready, Fit(options, reference, beta, support)


def fit(rows: DataFrame, options: Options = Options()) -> tuple[DataFrame, Fit]:
    """rows with x, their parts filled, and the fit. rows: y, shares with null for unknown; z, covariates.

    Rounds of filling and refitting go on until the filling moves by at most tol of its size.
    Equal rows count as often as they stand; other columns are handed through.
    """
    ready, now = first_fit(rows, options)
    parts, width, total = len(now.coefficients), len(now.coefficients[0]), 1.0 + len(now.coefficients) * options.shift
    source, before, state = F.col("y"), F.col("y"), None
    at = ready.withColumn("_x", source) if options.version == "v1" else ready
    for _ in range(options.max_iter):
        if options.version == "v1":
            last, at = at, saved(at.withColumn("_before", F.col("_x")).withColumn("_x", updated(F.col("_before"), source, now)), "filling")
            if now.history:
                release(last)
            state, before = F.col("_x"), F.col("_before")
        else:
            state = updated(source, source, now)
        sums = cross_products(at, state, before, parts, width, now.reference).collect()
        moved, size = sums[0]["moved"], sums[0]["size"]
        now.history.append(None if moved is None else math.sqrt(moved) / max(math.sqrt(size), 2.3e-308))
        final, before = now.coefficients, state
        now.coefficients, _ = solved(sums, parts, width, now.reference)
        if now.converged and not options.fixed:
            break
    filled = at.withColumn("x", state if options.version == "v1" else updated(source, source, Fit(options, now.reference, final, now.supports)))
    return output(filled, options, total), now


def predict(rows: DataFrame, fitted: Fit) -> DataFrame:
    """rows with x by the coefficients as they are: nothing is fitted to these rows."""
    ready, parts, width, _ = checked(rows, fitted.options)
    if (parts, width) != (len(fitted.coefficients), len(fitted.coefficients[0])):
        raise FitError("invalid_input: other parts or covariates than the fit has")
    return output(ready.withColumn("x", updated(F.col("y"), F.col("y"), fitted)), fitted.options, 1.0 + parts * fitted.options.shift)


def output(filled: DataFrame, o: Options, total: float) -> DataFrame:
    """Without the shift: x rescaled to 1, y as it was given."""
    scaled = filled.withColumn("x", F.transform("x", lambda v: v / total)) if o.rescale and o.shift else filled
    return scaled.withColumn("y", F.transform("y", lambda v: v - o.shift)).drop("_x", "_before")
