from tallyloom.operators import diagnosis

KEYS = "mask string, {}t int, grp string, days long, n double, {} double"


def test_levels_by_hand(spark):
    """Two targets, two masks: gaps, their means, small strata without one, a planted impossible cell."""
    seen = [(m, t, g, d, 10.0, c) for m in ("m1", "m2") for t in (0, 1) for g in "ab" for d, c in ((5, 0.0), (6, 3.0), (9, 2.0), (10, 0.0))]
    filled = [("m1", "x", 0, "a", 6, 10.0, 0.0)] * 3 + [("m1", "x", 0, "b", 7, 10.0, 4.0), ("m1", "x", 1, "a", 30, 10.0, 5.0), ("m2", "x", 1, "a", 8, 10.0, 0.0)]
    cut = spark.createDataFrame([(5.0, 20.0)], "q1 double, q2 double")
    out = diagnosis.diagnose(spark.createDataFrame(filled, KEYS.format("model string, ", "count")), spark.createDataFrame(seen, KEYS.format("", "c")), cut, least=3)
    got = {(r.level, r.mask, r.kind, r.stratum, r.t): r for r in out.collect()}
    first = got["target", "m1", "all", "all", 0]
    assert (first.cells, first.equal, first.d3_cells) == (4, 0.75 - 0.5, 0)
    second = got["target", "m1", "all", "all", 1]
    assert (second.equal, second.d3_cells, second.d3_mass) == (-0.5, 1, 0.5)
    both = got["mask", "m1", "all", "all", None]
    assert (both.equal, both.weighted, both.targets, both.cells) == (-0.125, (0.25 * 4 - 0.5) / 5, 2, 5)
    assert got["target", "m1", "group", "a", 0].equal == 0.5 and got["target", "m1", "group", "b", 0].equal is None
    assert got["mask", "m1", "group", "b", None].d3_cells is None and got["mask", "m1", "group", "a", None].d3_cells == 1
    assert got["target", "m1", "size", "N2", 0].equal == 0.25
    model = got["model", None, "all", "all", None]
    assert (model.cells, model.targets) == (6, 3) and abs(model.equal - (0.25 - 0.5 + 0.5) / 3) < 1e-12
    assert diagnosis.diagnose(spark.createDataFrame([], KEYS.format("model string, ", "count")), spark.createDataFrame(seen, KEYS.format("", "c")), cut).count() == 0
