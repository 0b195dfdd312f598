"""Verdicts by mask, decoys, mask targets and masks of many targets."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cases, logratio, masking
from tallyloom.sources import targets

PANEL = "row_id long, e long, entity string, grp string, days long, n double, c array<double>"


def test_verdicts_by_mask(spark):
    rows = [("a", 1.0)] * 3 + [("a", 0.5), ("a", None)] + [("b", 1.0)] * 4 + [("c", 1.0), ("c", None)]
    got = {r.mask: r for r in cases.verdict_by_mask(spark.createDataFrame(rows, "mask string, rate double")).collect()}
    assert [(got[m].cases, got[m].verdict) for m in "abc"] == [(4, "pass"), (4, "pass"), (1, "insufficient")]
    assert (got[None].verdict, got[None].cases) == ("insufficient", 9)
    low = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 0.4)] + [("b", 1.0)] * 4, "mask string, rate double")
    assert {r.mask: r.verdict for r in cases.verdict_by_mask(low).collect()} == {"a": "fail", "b": "pass", None: "fail"}
    assert cases.verdict_by_mask(low.limit(0)).isEmpty()


def test_planted_decoys(spark):
    """A decoy between the real models, one equal to the worst, one behind all, and cases without a score."""
    rows = [("m", "1", "x", 1.0), ("m", "1", "y", 3.0), ("m", "1", "d", 3.5), ("m", "1", "f", 3.0)]
    rows += [("m", "2", "x", 1.0), ("m", "2", "y", 3.0), ("m", "2", "d", 2.0)]
    rows += [("m", "3", "x", 1.0), ("m", "3", "y", None), ("m", "3", "d", 9.0), ("m", "3", "f", 9.0)]
    out = cases.decoys_worse(spark.createDataFrame(rows, "mask string, case string, model string, score double"), ["x", "y"], ["d", "f"])
    got = {(r["case"], r["decoy"]): r["worse"] for r in out.collect()}
    assert got == {("1", "d"): True, ("1", "f"): False, ("2", "d"): False, ("2", "f"): None, ("3", "d"): None, ("3", "f"): None}
    low = cases.decoys_worse(spark.createDataFrame([("m", "1", "x", 0.9), ("m", "1", "d", 0.5)], "mask string, case string, model string, score double"), ["x"], ["d"], higher_is_worse=False)
    assert low.first()["worse"] is True


def test_targets_and_cut_points(tmp_path):
    aim = masking.Target(5.0, 9.5, {"a|N1": 0.25, "b|N2": 0.75})
    targets.write_target(tmp_path / "t.json", aim)
    assert targets.read_target(tmp_path / "t.json") == aim
    for text in ("{}", "[1]", '{"n_cuts": [3, 3], "pi": {"a": 1}}', '{"n_cuts": [1, 2], "pi": {}}', '{"n_cuts": [1, 2], "pi": {"a": 0.5}}', '{"n_cuts": [1, 2], "pi": {"a": 1.5, "b": -0.5}}', '{"n_cuts": [1], "pi": {"a": 1}}', "no json"):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError, match="bad.json"):
            targets.read_target(tmp_path / "bad.json")
    report = tmp_path / "report.txt"
    report.write_text("Table 1\nN1 ≤ 12.0 < N2 ≤ 3.4e1 < N3\n", encoding="utf-8")
    assert targets.read_cuts(report) == (12.0, 34.0)
    report.write_text("nothing", encoding="utf-8")
    with pytest.raises(ValueError, match="0 times"):
        targets.read_cuts(report)


def test_target_out_of_reach_is_listed(spark):
    panel = spark.createDataFrame([(1, 1, "x", "a", 0, 4.0, [1.0, None]), (2, 2, "y", "a", 0, 20.0, [1.0, 2.0])], PANEL)
    aim = masking.Target(5.0, 9.0, {"a|N1": 0.5, "a|N3": 0.25, "gone|N2": 0.25})
    got = {r.stratum: r for r in masking.reachability(panel, 0.9, aim).collect()}
    assert (got["gone|N2"].reachable, got["gone|N2"].cells) == (False, 0) and abs(got["gone|N2"].lacking - 0.25 * 2.7) < 1e-12
    assert got["a|N1"].reachable and abs(got["a|N1"].lacking - 0.35) < 1e-12 and got["a|N3"].lacking == 0
    record = masking.weight_record(panel, aim).first().asDict()
    assert record == {"candidate_series": 3, "zero_weight_series": 0, "candidate_cells": 3, "unreachable_strata": 1, "unreachable_mass": 0.25}
    assert masking.whole_feature(panel, 0.3, 1, masking.matched_weights(panel, aim)).where("taken").count() > 0


def test_masks_of_seventy_targets(spark):
    """Each row keeps a visible target, whatever their number; the log-ratio patterns refuse so many."""
    rows = [(i, i % 3, str(i % 3), "a", i, 100.0, [1.0 if (i + j) % 5 else None for j in range(70)]) for i in range(30)]
    panel = spark.createDataFrame(rows, PANEL)
    series = masking.whole_feature(panel, 0.99, 3)
    assert series.count() == 210
    taken = series.where("accepted").groupBy("e").agg(F.collect_set("t").alias("gone"))
    left = panel.join(taken, "e", "left").select(F.size(F.filter(F.transform("c", lambda v, i: v.isNotNull() & ~F.array_contains("gone", i)), lambda x: x)).alias("k"))
    assert left.where("k = 0 OR k IS NULL").isEmpty()
    assert series.where("t > 63 AND taken").count() > 0
    with pytest.raises(logratio.FitError, match="31"):
        logratio.pattern_statistics(panel.withColumn("y", F.col("c")), 70)
