"""The metric index, exact quantiles and nested folds against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import folds, metric, neighbours
from tallyloom.operators.quantiles import quantiles

SCHEMA = "row_id long, e long, entity string, grp string, days long, n double, c array<double>"


def panel_rows(count, seed=1, lumps=6, copies=0):
    """Rows around a few centres, a fifth of the cells missing; some compositions many times."""
    rng = np.random.default_rng(seed)
    centres, rows = rng.dirichlet(np.ones(4), lumps), []
    for i in range(count):
        n = float(rng.integers(60, 400))
        p = rng.dirichlet(centres[i % lumps] * 400 + 0.5)
        c = [float(v) if u > 0.2 else None for v, u in zip(np.floor(p[:3] * n), rng.random(3))]
        rows.append((i, i % 17, f"e{i % 17}", "abc"[i % 17 % 3], i, n, c))
    rows += [(10_000 + i, i % 17, f"e{i % 17}", "abc"[i % 17 % 3], i, 100.0, [20.0, 30.0, 40.0]) for i in range(copies)]
    rows += [(20_000, 1, "e1", "b", 0, 50.0, [None, None, None]), (20_001, 2, "e2", "c", 0, 50.0, [0.0, None, 10.0])]
    return rows


def shares(rows):
    x = {}
    for row_id, e, *_, n, c in rows:
        parts = [None if v is None else v / n for v in c]
        x[row_id] = (e, parts + [None if None in c else (n - sum(c)) / n])
    least = min(p for _, parts in x.values() for p in parts if p) / 2
    return x, {k: (e, [least if p == 0 else p for p in parts]) for k, (e, parts) in x.items()}


def aitchison(q, y, s):
    a, b = np.log([q[i] for i in s]), np.log([y[i] for i in s])
    return float(np.sqrt((((a - a.mean()) - (b - b.mean())) ** 2).sum()))


def brute_hron(rows, k, ties, exclude):
    _, x = shares(rows)
    out = {}
    for row, (e, q) in x.items():
        s = [i for i, v in enumerate(q) if v is not None]
        for t in (i for i, v in enumerate(q) if v is None and s):
            found = [(round(d := aitchison(q, y, s), 12), other, d, y[t] / np.median([y[i] for i in s]) * np.median([q[i] for i in s])) for other, (oe, y) in x.items() if y[t] is not None and all(y[i] is not None for i in s) and not (exclude and oe == e)]
            found.sort()
            if ties == "group" and len(found) > k:
                limit = max(f[2] for f in found[:k])
                found = [f for f in found if f[2] <= limit + 1e-12 * max(1.0, limit)]
            elif ties != "group":
                found = found[:k]
            if found:
                out[row, t] = (len(found), float(np.median([f[3] for f in found])))
    return out


@pytest.mark.parametrize("ties, exclude", [("group", False), ("index", True)])
def test_blocks_are_skipped_and_rows_stay(spark, ties, exclude):
    rows = panel_rows(300, copies=60)
    panel, index = spark.createDataFrame(rows, SCHEMA), []
    found = neighbours.hron_candidates(panel, 3, "median", ties, exclude, donor_rows=40, index=index)
    chosen = neighbours.nearest_copies(found, 3, ties, ["row_id", "t"]).groupBy("row_id", "t").agg(F.sum("copies").alias("donors"), F.percentile("value", 0.5, F.col("copies")).alias("p"))
    got = {(r.row_id, r.t): (r.donors, r.p) for r in chosen.collect()}
    want = brute_hron(rows, 3, ties, exclude)
    assert got.keys() == want.keys()
    assert all(got[key][0] == want[key][0] and got[key][1] == pytest.approx(want[key][1], rel=1e-9) for key in want)
    assert len(index[0].blocks) > 5
    asked = panel.select("row_id").where("row_id < 300")
    x = spark.createDataFrame([(row, e, q) for row, (e, q) in shares(rows)[1].items() if None in q], "query long, e long, x array<double>").join(asked.withColumnRenamed("row_id", "query"), "query")
    visits = index[0].routed(x, 3, True).count()
    assert visits < 0.6 * x.count() * len(index[0].blocks)


def test_divergence_skips_blocks_too(spark):
    rows = panel_rows(300, seed=4, copies=30)
    panel, index = spark.createDataFrame(rows, SCHEMA), []
    found = neighbours.nearest_copies(neighbours.tsagris_candidates(panel, 4, donor_rows=30, index=index), 4, "index", ["row_id"])
    got = {}
    for r in found.collect():
        got.setdefault(r.row_id, []).append((round(r.d, 12), r.donor))
    x, _ = shares(rows)
    for row, (_, q) in x.items():
        s = [i for i, v in enumerate(q) if v is not None]
        if None not in q or not s or sum(q[i] for i in s) <= 0:
            assert row not in got
            continue
        every = []
        for other, (_, y) in x.items():
            if None not in y and sum(y[i] for i in s) > 0:
                a, b = np.array([q[i] for i in s]), np.array([y[i] for i in s])
                every.append((round(float(metric.distances((a / a.sum())[None], (b / b.sum())[None], "divergence")[0, 0]), 12), other))
        assert sorted(got[row]) == sorted(every)[:4]
    assert len(index[0].blocks) > 5 and index[0].bounds


def test_patterns_beyond_the_table_visit_every_block(spark, monkeypatch):
    monkeypatch.setattr(metric, "PATTERNS", 1)
    rows = panel_rows(200, seed=8)
    found = neighbours.hron_candidates(spark.createDataFrame(rows, SCHEMA), 3, donor_rows=20)
    chosen = neighbours.nearest_copies(found, 3, "group", ["row_id", "t"]).groupBy("row_id", "t").agg(F.sum("copies").alias("donors"))
    assert {(r.row_id, r.t): r.donors for r in chosen.collect()} == {key: n for key, (n, _) in brute_hron(rows, 3, "group", False).items()}


def test_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(0)
    values = {"a": rng.normal(size=3001), "b": np.exp(8 * rng.normal(size=2000)), "c": np.repeat([1.0, 2.0], 1500), "d": np.array([5.0]), "e": np.full(4000, 7.0)}
    df = spark.createDataFrame([(g, float(v)) for g, all_ in values.items() for v in all_] + [("a", None), ("f", None)], "g string, v double")
    for q in (0.0, 0.3, 0.5, 1.0):
        got = {r.g: (r.n, r.quantile) for r in quantiles(df, ["g"], F.col("v"), q, few=50).collect()}
        assert got == {g: (len(v), pytest.approx(float(np.quantile(v, q)), rel=1e-12)) for g, v in values.items()}
    assert quantiles(df.limit(0), ["g"], F.col("v")).count() == 0
    assert quantiles(df, [], F.col("v"), few=100).first().quantile == pytest.approx(float(np.median(np.concatenate(list(values.values())))))


def test_folds_against_one_by_one(spark):
    """Each fold by itself: training rows only, other entities only."""
    rows = panel_rows(180, seed=3, lumps=3)
    panel = spark.createDataFrame(rows, SCHEMA)
    got = {(r.fold, r.entity, r.k): r for r in folds.fold_scores(panel, (1, 4), 0.4, 5, donor_rows=40).collect()}
    from tallyloom.operators import masking

    gone = {r.row_id: r.h for r in panel.where(F.forall("c", lambda v: v.isNotNull())).select("row_id", masking.random_cell(0.4, 5).alias("h")).collect()}
    _, x = shares(rows)
    group = {e: "abc"[e % 3] for e in range(17)}
    want = {}
    for fold in "abc":
        train = {row: (e, p) for row, (e, p) in x.items() if group[e] != fold}
        middle = [np.median([p[t] for _, p in train.values() if p[t] is not None]) for t in range(4)]
        for row, (e, truth) in train.items():
            if not any(gone.get(row, [False])):
                continue
            lost = [t for t, h in enumerate(gone[row] + [True]) if h]
            s = [t for t in range(4) if t not in lost]
            for k in (1, 4):
                filled = list(truth)
                for t in lost:
                    near = sorted((round(aitchison(truth, y, s), 12), other) for other, (oe, y) in train.items() if oe != e and y[t] is not None and all(y[i] is not None for i in s))[:k]
                    filled[t] = np.median([train[o][1][t] / np.median([train[o][1][i] for i in s]) * np.median([truth[i] for i in s]) for _, o in near]) if near else middle[t]
                want.setdefault((fold, f"e{e}", k), []).append(aitchison(filled, truth, range(4)) ** 2)
    assert got.keys() == want.keys()
    assert all(got[key].m2 == pytest.approx(np.mean(scores), rel=1e-9) and got[key].rows == len(scores) for key, scores in want.items())
    chosen = {r.fold: r.k for r in folds.choice(folds.fold_scores(panel, (1, 4), 0.4, 5)).collect()}
    mean = lambda f, k: np.mean([np.mean(v) for (fold, _, kk), v in want.items() if fold == f and kk == k])
    assert chosen == {f: min((1, 4), key=lambda k: (mean(f, k), k)) for f in "abc"}


def test_medians_stand_in(spark):
    rows = [(1, 1, "a", "g", 0, 10.0, [1.0, 2.0]), (2, 2, "b", "g", 0, 10.0, [3.0, 5.0]), (3, 3, "c", "g", 0, 10.0, [None, None]), (4, 4, "d", "g", 0, 10.0, [2.0, None])]
    got = {(r.row_id, r.t): (round(r.p, 12), r.fallback) for r in folds.with_medians(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert got[3, 0] == (0.2, True) and got[3, 1] == (0.35, True) and got[3, 2] == (0.45, True)
    assert not got[4, 1][1]
