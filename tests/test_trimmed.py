"""Trimmed fits against every choice of rows in NumPy."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.logratio import FitError
from tallyloom.operators.trimmed import lts

def xs():
    return [F.lit(1.0), F.col("a")]



def frame(spark, a, v):
    return spark.createDataFrame([(i, float(x), None if y is None else float(y)) for i, (x, y) in enumerate(zip(a, v))], "k long, a double, v double")


def exhaustive(a, v, h):
    x = np.column_stack([np.ones(len(a)), a])
    best = None
    for take in combinations(range(len(a)), h):
        t = list(take)
        beta = np.linalg.lstsq(x[t], v[t], rcond=None)[0]
        loss = ((v[t] - x[t] @ beta) ** 2).sum()
        if best is None or loss < best[0]:
            best = (loss, beta)
    return best


def test_both_solvers_reach_the_optimum(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=11)
    v = 1 + 2 * a + rng.normal(size=11) * 0.1
    v[:4] += np.array([30, -20, 25, 40])
    loss, beta = exhaustive(a, v, 7)
    rows = frame(spark, a, v)
    whole = lts(rows, xs(), F.col("v"), F.col("k"))
    assert (whole.solver, whole.h, whole.certified, whole.valid) == ("every_choice", 7, True, 330)
    moved = lts(rows, xs(), F.col("v"), F.col("k"), starts=24, exact=0)
    assert (moved.solver, moved.certified, moved.valid + moved.skipped) == ("concentration", False, 25)
    for got in (whole, moved):
        assert abs(got.objective - loss) < 1e-9 and np.allclose(got.beta, beta, atol=1e-7)


def test_a_third_of_wrong_rows_and_equal_rows(spark):
    """Outliers on a third of the rows, many equal rows and equal residuals, rows with nulls."""
    a = np.tile(np.arange(10.0), 30)
    v = 5 - 3 * a
    v[::3] = 500 + a[::3]
    rows = frame(spark, list(a) + [1.0], list(v) + [None])
    got = lts(rows, xs(), F.col("v"), F.col("k"), starts=6)
    assert got.solver == "concentration" and got.h == (300 + 2 + 1) // 2
    assert np.allclose(got.beta, [5, -3], atol=1e-8) and got.objective < 1e-12


def test_refusals(spark):
    rows = frame(spark, [1, 1, 1, 1], [1, 2, 3, 4])
    with pytest.raises(FitError, match="rank_deficient"):
        lts(rows, xs(), F.col("v"), F.col("k"))
    with pytest.raises(FitError, match="rank_deficient"):
        lts(rows, xs(), F.col("v"), F.col("k"), starts=2, exact=0)
    with pytest.raises(FitError, match="insufficient_data"):
        lts(rows.limit(0), xs(), F.col("v"), F.col("k"))
    with pytest.raises(FitError, match="insufficient_data"):
        lts(rows, xs(), F.col("v"), F.col("k"), h=5)
