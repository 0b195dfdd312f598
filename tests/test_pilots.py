"""Cases of the older baselines and checks that the catalog's data don't hold."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import pilots

SCHEMA = "row_id long, e long, days long, n double, c array<double>"


def panel(spark, rows):
    return spark.createDataFrame([(i, i, i, float(n), c) for i, (n, c) in enumerate(rows)], SCHEMA)


def test_scaled_means_by_hand(spark):
    rows = panel(spark, [(10, [2.0, 6.0]), (10, [4.0, None]), (10, [None, 0.0]), (10, [None, None])])
    got = {r.row_id: r.filled for r in pilots.scaled_means(rows, 2).collect()}
    # Means 3 and 3: the composition is a half each.
    assert got[1] == [4.0, pytest.approx(4.0)]
    assert got[2] == [pytest.approx(0.5), 0.0]
    assert got[3] == [pytest.approx(0.5), pytest.approx(0.5)]


def test_row_means_without_positive_counts(spark):
    got = {r.row_id: r.filled for r in pilots.row_means(panel(spark, [(9, [2.0, 4.0]), (9, [None, 0.0])]), 2).collect()}
    assert got[0] == [2.0, 4.0] and got[1] == [pytest.approx(2.0), 0.0]


def test_intercept_meets_rate(spark):
    scores = spark.range(1000).select((F.col("id") / 100.0 - 5).alias("score"))
    b = pilots.solve_intercept(scores, 0.25)
    mean = sum(1 / (1 + math.exp(-(k / 100 - 5 + b))) for k in range(1000)) / 1000
    assert mean == pytest.approx(0.25, abs=1e-7)
    assert pilots.solve_intercept(scores.limit(0), 0.25) == 0.0


def test_logistic_mask_refuses_dependence_on_itself(spark):
    rows = panel(spark, [(9, [2.0, 4.0])])
    with pytest.raises(ValueError, match="weight"):
        pilots.logistic_mask(rows, [0.5, 0.1], [1], 0.3, F.array(F.lit(0.1), F.lit(0.2)))
    with pytest.raises(ValueError, match="rate"):
        pilots.logistic_mask(rows, [0.5, 0.0], [1], 1.0, F.array(F.lit(0.1), F.lit(0.2)))


def test_fixed_count_hides_exactly_k_also_in_ties(spark):
    rows = spark.createDataFrame([([0.5, 0.5, 0.5, 0.1],), ([0.9, 0.8, 0.7, 0.6],)], "u array<double>")
    assert [r.h for r in rows.select(pilots.fixed_count(F.col("u"), 2).alias("h")).collect()] == [[True, False, False, True], [False, False, True, True]]


def test_anchored_keeps_known_counts(spark):
    rows = spark.createDataFrame([([2.0, None], [0.0, math.log(3)]), ([None, None], [0.0, 0.0]), ([0.0, None], [0.0, 0.0])], "c array<double>, z array<double>")
    got = [r.x for r in rows.select(pilots.anchored(F.col("c"), F.col("z")).alias("x")).collect()]
    assert got[0] == [2.0, pytest.approx(6.0)] and got[1] == [pytest.approx(0.5)] * 2 and got[2] == [0.0, pytest.approx(0.5)]


def test_empty_tables(spark):
    none = panel(spark, [(1, [1.0, 1.0])]).limit(0)
    assert pilots.scaled_means(none, 2).count() == 0
    assert pilots.hidden_variants(none, 2).count() == 0
    assert pilots.scale_guard(none.withColumn("filled", F.col("c"))).first().flagged == 0


def test_gates_need_every_cell(spark):
    rows = [("a", "x", 1, 0.5, 1.0, 1.0, 1.0), ("a", "y", 1, 0.5, 1.0, 1.0, 1.0), ("b", "x", 1, 0.5, 1.0, 1.0, 1.0), ("b", "y", 1, 0.99, 1.0, 1.0, 1.0), ("c", "x", 1, None, 1.0, 1.0, 1.0)]
    scores = spark.createDataFrame(rows, "config string, scenario string, seed int, m2 double, mae double, start_m2 double, start_mae double")
    gated = pilots.gates(scores, 0.1)
    assert {r.config: (r.qualified, r.rank_stat) for r in gated.collect()} == {"a": (True, 0.5), "b": (False, pytest.approx(0.745)), "c": (False, None)}
    assert [r.config for r in pilots.finalists(gated).collect()] == ["a"]
