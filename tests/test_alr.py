"""Log-ratio regression with covariates against a plain row-wise NumPy version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import alr
from tallyloom.operators.logratio import FitError

KIND = "row_id long, y array<double>, z array<double>"


def made(seed=1, n=60, d=4, p=2):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, p))
    logits = np.column_stack([np.zeros(n), 0.5 + z @ rng.normal(size=(p, d - 1)) * 0.4 + rng.normal(size=(n, d - 1)) * 0.2])
    y = np.exp(logits)
    y /= y.sum(1, keepdims=True)
    gone = rng.random((n, d)) < np.array([0.1, 0.2, 0.3, 0.25])[:d]
    gone[: n // 4] = False
    gone[-1] = True
    gone[(~gone).sum(1) == d - 1] &= rng.random((n, d))[(~gone).sum(1) == d - 1] < 0.5
    return np.where(gone, np.nan, y), z


def frame(spark, y, z):
    return spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, z))], KIND)


def plain(y, z, o):
    """Row by row: what the rounds ought to give."""
    d = y.shape[1]
    r = int(np.isnan(y).sum(0).argmin()) if o.reference is None else o.reference
    source, total = y + o.shift, 1 + d * o.shift
    design = np.column_stack([np.ones(len(z)), z])

    def regress(x, whole):
        beta = np.zeros((design.shape[1], d))
        for j in range(d):
            if j != r:
                use = ~np.isnan(x).any(1) if whole else ~np.isnan(x[:, j]) & ~np.isnan(x[:, r])
                beta[:, j] = np.linalg.lstsq(design[use], np.log(x[use, j] / x[use, r]), rcond=None)[0]
        return beta

    def share(row, open_, eta):
        e = np.exp(eta[open_])
        out = row.copy()
        out[open_] = max(0.0, total - row[~open_].sum()) * e / e.sum()
        return out

    def fill(state, beta):
        out = source.copy()
        for i in range(len(y)):
            gap, eta = np.isnan(source[i]), design[i] @ beta
            if not gap.any():
                continue
            if o.version == "v2" or gap.all():
                out[i] = share(source[i], gap | (np.arange(d) == r) if o.author_code else gap, eta)
                continue
            row = state[i].copy()
            for j in range(d):
                if j != r:
                    one = share(row, np.isnan(row) | np.isin(np.arange(d), (j, r)), eta)
                    row[[j, r]] = one[[j, r]]
            out[i] = row
        return out

    beta, state, history = regress(source, not o.pairwise), source, []
    for _ in range(o.max_iter):
        new = fill(state, beta)
        history.append(None if np.isnan(state).any() else np.linalg.norm(new - state) / np.linalg.norm(state))
        state, beta = new, regress(new, False)
        if not o.fixed and history[-1] is not None and history[-1] <= o.tol:
            break
    return state * (1 / total if o.rescale else 1), beta, history


@pytest.mark.parametrize(
    "o",
    [
        alr.Options(max_iter=6),
        alr.Options(fit_rows="pairwise", reference=2, max_iter=4),
        alr.Options(author_code=True, reference=3, max_iter=4, fixed=True),
        alr.Options(shift=0.05, max_iter=3, rescale=False),
        alr.Options(version="v1", max_iter=4, fit_rows="pairwise"),
        alr.Options(version="v1", shift=0.02, tol=0.05, max_iter=9),
    ],
    ids=lambda o: f"{o.version}-{'pair' if o.pairwise else 'whole'}-{o.shift}",
)
def test_rounds_against_numpy(spark, o):
    y, z = made()
    out, fitted = alr.fit(frame(spark, y, z), o)
    want, beta, history = plain(y, z, o)
    got = np.array([r.x for r in out.orderBy("row_id").collect()])
    assert np.allclose(got, want, atol=1e-9)
    assert np.allclose(np.array(fitted.coefficients).T, beta, atol=1e-7)
    assert len(fitted.history) == len(history) and fitted.history[0] is None
    assert np.allclose([h for h in fitted.history if h is not None], [h for h in history if h is not None], atol=1e-9)
    assert out.columns == ["row_id", "y", "z", "x"]


def test_version_two_keeps_known_parts_and_predicts(spark):
    y, z = made(3)
    rows = frame(spark, y, z)
    out, fitted = alr.fit(rows, alr.Options(max_iter=80, tol=1e-6))
    assert fitted.converged
    seen = out.select(F.explode(F.arrays_zip("y", "x")).alias("c")).where("c.y IS NOT NULL AND abs(c.y - c.x) > 1e-12")
    assert seen.isEmpty() and out.where("abs(aggregate(x, 0D, (a, v) -> a + v) - 1) > 1e-9").isEmpty()
    again = alr.predict(rows, fitted).orderBy("row_id").collect()
    assert np.allclose([r.x for r in again], [r.x for r in out.orderBy("row_id").collect()], atol=1e-5)
    # No covariate at all is the lone intercept.
    bare, lone = alr.fit(rows.withColumn("z", F.array().cast("array<double>")), alr.Options(max_iter=2))
    assert len(lone.coefficients[0]) == 1 and bare.count() == len(y)


def test_refusals(spark):
    y, z = made(5, n=24)
    good = frame(spark, y, z)
    for rows, said in (
        (good.limit(0), "no rows"),
        (good.withColumn("z", F.transform("z", lambda v: F.lit(2.0))), "rank_deficient"),
        (good.withColumn("z", F.transform("z", lambda v, i: F.when(i == 0, v))), "covariates"),
        (good.withColumn("y", F.transform("y", lambda v: v * 1.5)), "above_total"),
        (good.withColumn("y", F.transform("y", lambda v: v * 0.9)), "not_closed"),
        (good.withColumn("y", F.transform("y", lambda v, i: F.when(i > 0, v).when(v.isNotNull(), F.lit(0.0)))), "not_positive"),
        (good.where("row_id < 3"), "insufficient_data"),
        (good.withColumn("y", F.when(F.col("row_id") == 7, F.slice("y", 1, 3)).otherwise(F.col("y"))), "width"),
    ):
        with pytest.raises(FitError, match=said):
            alr.fit(rows, alr.Options(max_iter=2))
    with pytest.raises(ValueError, match="version"):
        alr.Options(version="v3")
