"""Masks: which observed cells of a panel are hidden, as a boolean array column in target order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import ANCHOR, HIDE, ORDER, uniform
from tallyloom.panel import cells, forced_zero

KINDS = ("none", "random_cell", "whole_feature", "whole_feature_matched")
#: Ranges into which a global order is cut, so that running sums never pass one task.
RANGES = 1024


@dataclass(frozen=True)
class Target:
    """The shares pi by stratum that a matched mask aims at, and the cuts of n that make the strata."""

    q1: float
    q2: float
    pi: dict[str, float]

    def __post_init__(self):
        if not self.q1 < self.q2:
            raise ValueError(f"cut points of a mask target must rise, not {self.q1} and {self.q2}")
        if not self.pi or not all(v >= 0 for v in self.pi.values()) or not abs(sum(self.pi.values()) - 1) <= 1e-9:
            raise ValueError("shares of a mask target must be 0 or more and sum to 1")


def validate_mask(kind: str, rate: float) -> None:
    """Raises ValueError unless the kind is known and 0 <= rate < 1."""
    if kind not in KINDS:
        raise ValueError(f"mask must be one of {KINDS}, not {kind!r}")
    if not 0 <= rate < 1:
        raise ValueError(f"mask rate must lie in [0, 1), not {rate!r}")


def random_cell(rate: float, seed: int | Column, purpose: int = HIDE) -> Column:
    """Each observed cell with probability rate; a row that would lose all gets one back. No shuffle.

    Draws for another purpose (TRAIN: the training mask of a model) share no stream with these.
    """
    validate_mask("random_cell", rate)
    draw = F.transform("c", lambda v, i: v.isNotNull() & (uniform(F.col("e"), F.col("days"), i, purpose + seed) < rate))
    order = F.transform("c", lambda v, i: F.when(v.isNotNull(), uniform(F.col("e"), F.col("days"), i, ANCHOR + (purpose - HIDE) // 2 + seed)))
    stays = F.exists(F.zip_with("c", draw, lambda v, h: v.isNotNull() & ~h), lambda x: x)
    anchor = F.array_position(order, F.array_min(F.filter(order, lambda x: x.isNotNull()))) - 1
    return F.when(stays, draw).otherwise(F.transform(draw, lambda h, i: h & (i != F.coalesce(anchor, F.lit(-1)))))


def before(rows: DataFrame, key: Column, size: str, out: str) -> DataFrame:
    """rows with the sum of `size` over all rows of smaller key (a number in [0, 1)), ties by (e, t).

    Running sums within ranges of the key plus the ranges' own running sum: two small windows.
    """
    ranged = rows.withColumn("_key", key).withColumn("_range", F.floor(key * RANGES))
    sums = ranged.groupBy("_range").agg(F.sum(size).alias("_sum"))
    starts = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_start"))
    within = Window.partitionBy("_range").orderBy("_key", "e", "t").rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(starts), "_range")
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(size).over(within), F.lit(0))).drop("_range", "_key", "_start")


def _accepted(series: DataFrame, patterns: DataFrame) -> DataFrame:
    """series (e, t, key, size) with accepted: not where hiding it leaves a row without a target.

    A row belongs to one entity, so only earlier series of the same entity matter; and rows matter
    only by which targets they show, arrays of booleans for any number of targets: the fold runs over
    an entity's few patterns.
    """
    ordered = series.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("key", "t", "size"))).alias("draws"))
    both = ordered.join(patterns.groupBy("e").agg(F.collect_set("shown").alias("shown")), "e")

    def step(taken: Column, draw: Column) -> Column:
        left = lambda p: F.exists(F.zip_with(p, taken, lambda has, gone: has & ~gone), lambda x: x)
        without = lambda p: F.transform(p, lambda has, i: has & (i != draw["t"]))
        stuck = F.exists("shown", lambda p: F.get(p, draw["t"]) & ~left(without(p)))
        return F.when(stuck, taken).otherwise(F.transform(taken, lambda gone, i: gone | (i == draw["t"])))

    nothing = F.transform(F.get("shown", F.lit(0)), lambda v: F.lit(False))
    taken = both.withColumn("taken", F.aggregate("draws", nothing, step))
    return taken.select("e", F.explode("draws").alias("d"), "taken").select("e", "d.t", "d.key", "d.size", F.get("taken", F.col("d.t")).alias("accepted"))


def whole_feature(panel: DataFrame, rate: float, seed: int, weights: DataFrame | None = None) -> DataFrame:
    """Series of the mask: e, t, size, accepted, taken (hidden), in drawing order by key.

    Whole (entity, target) series in random order until rate times the observed cells are hidden;
    series that would leave a row without a visible target are skipped. With weights (e, t, w) the
    order is by log(1 - u) / w, largest first, and w = 0 is never drawn.
    """
    validate_mask("whole_feature", rate)
    seen = cells(panel).where("c is not null")
    series = seen.groupBy("e", "t").agg(F.count(F.lit(1)).alias("size"))
    u = uniform(F.col("e"), F.lit(0), F.col("t"), ORDER + seed)
    if weights is None:
        series = series.withColumn("key", u)
    else:
        # -log(1 - u) / w is increasing in the drawing order; squeezed into [0, 1).
        raw = -F.log1p(-u) / F.col("w")
        series = series.join(weights.where("w > 0"), ["e", "t"]).withColumn("key", raw / (1 + raw)).drop("w")
    patterns = panel.select("e", observed().alias("shown")).where(F.exists("shown", lambda x: x)).distinct()
    drawn = _accepted(series, patterns)
    goal = seen.agg((F.count(F.lit(1)) * rate).alias("goal"))
    sized = before(drawn.withColumn("counts", F.when(F.col("accepted"), F.col("size")).otherwise(0)), F.col("key"), "counts", "hidden_before")
    return sized.join(F.broadcast(goal)).select("e", "t", "key", "size", "accepted", (F.col("accepted") & (F.col("hidden_before") < F.col("goal"))).alias("taken"), (F.col("hidden_before") < F.col("goal")).alias("reached"))


def cuts(panel: DataFrame) -> DataFrame:
    """One row q1, q2: thirds of n over rows with a model-decided missing cell (linear quantiles)."""
    model = F.exists(F.zip_with("c", forced_zero(), lambda v, z: v.isNull() & ~z), lambda x: x)
    return panel.where(model).agg(F.percentile("n", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"))


def stratum() -> Column:
    """grp|N1, N2 or N3 by n against q1 and q2."""
    return F.concat_ws("|", "grp", F.when(F.col("n") <= F.col("q1"), "N1").when(F.col("n") <= F.col("q2"), "N2").otherwise("N3"))


def shares(panel: DataFrame, wanted: Column) -> DataFrame:
    """stratum, share of the cells that the boolean array marks; panel has q1, q2."""
    per = panel.select(stratum().alias("stratum"), F.size(F.filter(wanted, lambda x: x)).alias("n")).where("n > 0").groupBy("stratum").agg(F.sum("n").alias("n"))
    return per.select("stratum", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def observed() -> Column:
    return F.transform("c", lambda v: v.isNotNull())


def model_decided() -> Column:
    return F.zip_with("c", forced_zero(), lambda v, z: v.isNull() & ~z)


def aimed(panel: DataFrame, target: Target | None) -> tuple[DataFrame, DataFrame]:
    """The panel with q1 and q2, and stratum, pi: of the target, or of the panel's own model-decided cells."""
    if target is None:
        cut = panel.join(F.broadcast(cuts(panel)))
        return cut, shares(cut, model_decided()).withColumnRenamed("share", "pi")
    cut = panel.withColumn("q1", F.lit(float(target.q1))).withColumn("q2", F.lit(float(target.q2)))
    return cut, panel.sparkSession.createDataFrame([(k, float(v)) for k, v in sorted(target.pi.items())], "stratum string, pi double")


def matched_weights(panel: DataFrame, target: Target | None = None) -> DataFrame:
    """e, t, w: how well a series stands for the strata of the target.

    w = sum over strata of n(series, stratum) * pi(stratum) / p(stratum): pi the target shares (without
    a target those of the model-decided missing cells), p the shares of observed cells. Strata that
    no observed cell has can't be reached; reachability() lists them.
    """
    cut, aim = aimed(panel, target)
    ratio = shares(cut, observed()).withColumnRenamed("share", "p").join(aim, "stratum", "left").select("stratum", (F.coalesce("pi", F.lit(0.0)) / F.col("p")).alias("ratio"))
    per = cells(cut.withColumn("s", F.transform("c", lambda v: stratum())), "s").where("c is not null").groupBy("e", "t", F.col("s").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(ratio), "stratum").groupBy("e", "t").agg(F.sum(F.col("n") * F.col("ratio")).alias("w"))


def reachability(panel: DataFrame, rate: float, target: Target | None = None) -> DataFrame:
    """stratum, pi, cells, wanted, lacking, reachable for each stratum of the target, before anything is drawn.

    cells: observed cells there; wanted: pi of the cells that a mask of that rate hides; lacking: what
    of them the stratum can't give; reachable: it has any observed cell.
    """
    validate_mask("whole_feature_matched", rate)
    cut, aim = aimed(panel, target)
    per = cut.select(stratum().alias("stratum"), F.size(F.filter(observed(), lambda x: x)).cast("long").alias("n")).groupBy("stratum").agg(F.sum("n").alias("cells"))
    goal = per.agg((F.coalesce(F.sum("cells"), F.lit(0)) * rate).alias("goal"))
    wanted = F.col("pi") * F.col("goal")
    every = aim.join(per, "stratum", "left").join(F.broadcast(goal)).withColumn("cells", F.coalesce("cells", F.lit(0).cast("long")))
    return every.select("stratum", "pi", "cells", wanted.alias("wanted"), F.greatest(wanted - F.col("cells"), F.lit(0.0)).alias("lacking"), (F.col("cells") > 0).alias("reachable"))


def weight_record(panel: DataFrame, target: Target | None = None) -> DataFrame:
    """One row: candidate series and cells, series of weight 0, strata out of reach and their mass."""
    series = matched_weights(panel, target).agg(F.count(F.lit(1)).alias("candidate_series"), F.count_if(F.col("w") == 0).alias("zero_weight_series"))
    strata = reachability(panel, 0.0, target).agg(F.count_if(~F.col("reachable")).alias("unreachable_strata"), F.coalesce(F.sum(F.when(~F.col("reachable"), F.col("pi"))), F.lit(0.0)).alias("unreachable_mass"))
    seen = panel.agg(F.coalesce(F.sum(F.size(F.filter(observed(), lambda x: x))), F.lit(0)).cast("long").alias("candidate_cells"))
    return series.join(F.broadcast(seen)).join(F.broadcast(strata))


def total_variation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: half the sum of absolute share differences over the union of strata."""
    both = a.withColumnRenamed("share", "x").join(b.withColumnRenamed("share", "y"), "stratum", "full")
    return both.agg((F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))) * 0.5).alias("tv"))


def statistics(panel: DataFrame, hidden: Column) -> DataFrame:
    """One row: observed and hidden cells, actual rate, rows affected, complete rows before and after."""
    marked = panel.withColumn("h", hidden)
    count = lambda x: F.size(F.filter(x, lambda v: v))
    return marked.agg(
        F.sum(count(observed())).cast("long").alias("observed_cells"),
        F.sum(count(F.col("h"))).cast("long").alias("hidden_cells"),
        (F.sum(count(F.col("h"))) / F.sum(count(observed()))).alias("actual_rate"),
        F.count_if(F.exists("h", lambda x: x)).alias("rows_affected"),
        F.count_if(F.forall("c", lambda v: v.isNotNull())).alias("complete_before"),
        F.count_if(F.forall(F.zip_with("c", "h", lambda v, h: v.isNotNull() & ~h), lambda x: x)).alias("complete_after"),
    )
