"""Stored states and masks: round trips and what is refused."""

import pytest
from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom.operators import masking, staged
from tallyloom.sources import states
from tallyloom.sources.tables import table_digest


def refused(code, panel, path, rate=0.15, seed=3):
    with pytest.raises(states.StateError) as said:
        states.restore(panel, rate, seed, str(path))
    assert said.value.code == code


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    panel = spark.createDataFrame(pn.orders_panel(spark, sf).where("e < 6").collect(), pn.orders_panel(spark, sf).schema).cache()
    path = tmp_path_factory.mktemp("state") / "s"
    states.export(panel, 0.15, 3, str(path))
    return panel, path


def changed(spark, kept, path, rows=lambda r: r, **facts):
    """A copy of the state with other rows or facts, its digest made anew."""
    _, source = kept
    new = rows(spark.read.parquet(f"{source}/rows"))
    new.write.parquet(f"{path}/rows")
    back = spark.read.parquet(f"{path}/rows")
    given = spark.read.parquet(f"{source}/facts").first().asDict() | table_digest(back, back.columns).first().asDict() | facts
    spark.createDataFrame([tuple(given.values())], states.FACTS).write.parquet(f"{path}/facts")
    return path


def test_round_trip(spark, kept):
    panel, path = kept
    rows = states.restore(panel, 0.15, 3, str(path))
    first = {r.row_id: r.filled for r in staged.initial(panel).collect()}
    got = rows.collect()
    assert len(got) == panel.count() and all(r.inference == first[r.row_id] for r in got)
    want = {r.row_id: r.h for r in panel.select("row_id", masking.random_cell(0.15, 3, staged.TRAIN).alias("h")).collect()}
    assert all(r.q == want[r.row_id] for r in got) and any(any(r.q) for r in got)
    with pytest.raises(Exception, match="(?i)exists"):
        states.export(panel, 0.15, 3, str(path))


def test_other_recipe_and_other_panel(spark, kept, tmp_path):
    panel, path = kept
    refused("recipe", panel, path, seed=4)
    refused("recipe", panel, path, rate=0.2)
    refused("incomplete", panel, tmp_path / "nothing")
    refused("no_missing", panel.withColumn("c", F.transform("c", lambda v: F.coalesce(v, F.lit(0.0)))), path)
    refused("other_rows", panel.where("e < 5 OR days > 400"), path)
    last = panel.agg(F.max("row_id")).first()[0]
    more = panel.withColumn("n", F.when(F.col("row_id") == last, F.col("n") * 1000).otherwise(F.col("n")))
    with pytest.raises(states.StateError) as said:
        states.restore(more, 0.15, 3, str(path))
    assert said.value.code in ("delta", "labels", "observed_changed")


def test_changed_states(spark, kept, tmp_path):
    panel, _ = kept
    at = lambda c, new: lambda r: r.withColumn(c, F.transform(c, new))
    cases = {
        "digest": ({"xor": 1}, lambda r: r),
        "version": ({"version": 2}, lambda r: r),
        "delta": ({"delta_training": 0.5}, lambda r: r),
        "columns": ({}, lambda r: r.drop("labels")),
        "training_cells": ({}, at("q", lambda x: ~x)),
        "labels": ({}, at("labels", lambda v: v + 0.01)),
        "observed_changed": ({}, at("training", lambda v: v + 1.0)),
        "not_completed": ({}, None),
        "other_rows": ({}, lambda r: r.unionByName(r.limit(1))),
    }
    gap = panel.select("row_id", "c")
    broken = lambda r: r.join(gap, "row_id").withColumn("inference", F.zip_with("c", "inference", lambda v, f: F.when(v.isNotNull(), f))).drop("c")
    for code, (facts, rows) in cases.items():
        refused(code, panel, changed(spark, kept, tmp_path / code, rows or broken, **facts))


def test_nothing_misses(spark, tmp_path):
    panel = spark.createDataFrame([(1, 1, "a", "g", 0, 4.0, [1.0, 2.0])], "row_id long, e long, entity string, grp string, days long, n double, c array<double>")
    states.export(panel, 0.15, 3, str(tmp_path / "s"))
    assert states.restore(panel, 0.15, 3, str(tmp_path / "s")) is None
    refused("no_missing", panel.withColumn("c", F.transform("c", lambda v, i: F.when(i == 0, v))), tmp_path / "s")


def test_masks(spark, kept, tmp_path):
    panel, _ = kept
    hidden = panel.withColumn("h", masking.random_cell(0.3, 1))
    states.write_mask(hidden, str(tmp_path / "m"))
    back = states.read_mask(panel, str(tmp_path / "m"))
    assert back.exceptAll(hidden).isEmpty() and back.count() == hidden.count()
    for code, rows in {"not_observed": hidden.withColumn("h", F.transform("c", lambda v: v.isNull())), "other_rows": hidden.where("days > 100"), "columns": hidden.withColumn("h", F.lit(True))}.items():
        states.write_mask(rows, str(tmp_path / code))
        with pytest.raises(states.StateError) as said:
            states.read_mask(panel, str(tmp_path / code))
        assert said.value.code == code
