"""Support diagnostics: do filled cells look like observed ones near them?

E: filled cells that a model decided. V: observed cells. A cell of E is supported by the V cells of
its target and group within `days` of it in other entities if there are enough of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZERO_BELOW = 0.5


def support(asked: DataFrame, observed: DataFrame, days: int = 62, least_cells: int = 10, least_entities: int = 2) -> DataFrame:
    """asked (row_id, t, e, grp, days) with refs, entities, supported.

    Counted by windows on cells folded to (target, group, entity, day), not by pairing cells: the
    entities near a day are the entities whose last or next observed day lies within the band, so
    their number is a sum of starts and ends of merged bands.
    """
    key = ["t", "grp"]
    daily = observed.groupBy(*key, "e", "days").agg(F.count(F.lit(1)).alias("k"))
    # Bands around an entity's observed days, merged where they meet: at most one band of it holds a day.
    own = Window.partitionBy(*key, "e").orderBy("days")
    starts = daily.withColumn("new", F.coalesce(F.col("days") - F.lag("days").over(own) > 2 * days, F.lit(True)).cast("int")).withColumn("band", F.sum("new").over(own))
    bands = starts.groupBy(*key, "e", "band").agg((F.min("days") - days).alias("first"), (F.max("days") + days + 1).alias("last"))
    edges = bands.select(*key, F.col("first").alias("days"), F.lit(1).alias("step")).union(bands.select(*key, F.col("last").alias("days"), F.lit(-1).alias("step")))
    total = daily.groupBy(*key, "days").agg(F.sum("k").alias("k"))
    points = asked.select(*key, "days").distinct()
    marks = (
        total.select(*key, "days", "k", F.lit(0).alias("step"), F.lit(False).alias("asked"))
        .unionByName(edges.select(*key, "days", F.lit(0).cast("long").alias("k"), "step", F.lit(False).alias("asked")))
        .unionByName(points.select(*key, "days", F.lit(0).cast("long").alias("k"), F.lit(0).alias("step"), F.lit(True).alias("asked")))
        .groupBy(*key, "days").agg(F.sum("k").alias("k"), F.sum("step").alias("step"), F.bool_or("asked").alias("asked"))
    )
    order = Window.partitionBy(*key).orderBy("days")
    near = marks.select(*key, "days", "asked", F.sum("k").over(order.rangeBetween(-days, days)).alias("all_refs"), F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("all_entities")).where("asked")
    mine = daily.select(*key, "e", "days", "k").unionByName(asked.select(*key, "e", "days", F.lit(0).cast("long").alias("k"))).groupBy(*key, "e", "days").agg(F.sum("k").alias("k"))
    mine = mine.select(*key, "e", "days", F.sum("k").over(Window.partitionBy(*key, "e").orderBy("days").rangeBetween(-days, days)).alias("own_refs"))
    out = asked.join(near, [*key, "days"]).join(mine, [*key, "e", "days"])
    refs, entities = F.col("all_refs") - F.col("own_refs"), F.col("all_entities") - (F.col("own_refs") > 0).cast("int")
    return out.select("row_id", "t", "e", "grp", "days", refs.alias("refs"), entities.cast("long").alias("entities"), ((refs >= least_cells) & (entities >= least_entities)).alias("supported"))


def pooled_zero_gap(filled: DataFrame, observed: DataFrame) -> DataFrame:
    """D1 by target: share of zeros (count < 0.5) among filled cells less that among observed ones."""
    a = filled.groupBy("t").agg(F.avg((F.col("count") < ZERO_BELOW).cast("double")).alias("filled_zero"), F.count(F.lit(1)).alias("cells"))
    b = observed.groupBy("t").agg(F.avg((F.col("c") < ZERO_BELOW).cast("double")).alias("observed_zero"))
    return a.join(b, "t").select("t", "cells", (F.col("filled_zero") - F.col("observed_zero")).alias("d1"))


def reference_weights(supported: DataFrame, observed: DataFrame, days: int = 62) -> DataFrame:
    """Observed cells with weight: the sum of 1 / refs over the supported cells that they support.

    Weights are windowed sums of 1 / refs by day, less those of the own entity.
    """
    share = (1.0 / F.col("refs")).alias("w")
    key = ["t", "grp"]
    asks = supported.where("supported").select(*key, "e", "days", share)

    def around(by: list[str], out: str) -> DataFrame:
        points = observed.select(*by, "days").distinct().withColumn("w", F.lit(0.0))
        daily = asks.select(*by, "days", "w").unionByName(points).groupBy(*by, "days").agg(F.sum("w").alias("w"))
        return daily.select(*by, "days", F.sum("w").over(Window.partitionBy(*by).orderBy("days").rangeBetween(-days, days)).alias(out))

    out = observed.join(around(key, "all_w"), [*key, "days"]).join(around([*key, "e"], "own_w"), [*key, "e", "days"])
    return out.withColumn("weight", F.greatest(F.col("all_w") - F.col("own_w"), F.lit(0.0))).drop("all_w", "own_w")


def local_zero_gap(filled: DataFrame, supported: DataFrame, observed: DataFrame, days: int = 62) -> DataFrame:
    """D1 by target on supported cells, the observed side weighted by how much it supports."""
    a = filled.join(supported.where("supported").select("row_id", "t"), ["row_id", "t"]).groupBy("t").agg(F.avg((F.col("count") < ZERO_BELOW).cast("double")).alias("x"), F.count(F.lit(1)).alias("cells"))
    refs = reference_weights(supported, observed, days)
    b = refs.groupBy("t").agg((F.sum(F.col("weight") * (F.col("c") < ZERO_BELOW).cast("double")) / F.sum("weight")).alias("y"))
    return a.join(b, "t").select("t", "cells", (F.col("x") - F.col("y")).alias("d1"))


def span(observed: DataFrame) -> DataFrame:
    """t, first_day, last_day of positive counts."""
    positive = F.when(F.col("c") > 0, F.col("days"))
    return observed.groupBy("t").agg(F.min(positive).alias("first_day"), F.max(positive).alias("last_day"))


def outside_support(filled: DataFrame, observed: DataFrame) -> DataFrame:
    """D3 by target: filled cells with a count outside the days of positive counts, and their share of mass."""
    joined = filled.join(F.broadcast(span(observed)), "t")
    flag = (F.col("count") >= ZERO_BELOW) & ((F.col("days") < F.col("first_day")) | (F.col("days") > F.col("last_day")))
    return joined.groupBy("t").agg(F.count_if(flag).alias("flagged"), F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum(F.when(flag, F.col("count") / F.col("n"))), F.lit(0.0)).alias("mass"))


def reference_shift(pooled: DataFrame, local: DataFrame, least: float = 0.10) -> DataFrame:
    """t, shifted: pooled and local D1 differ in sign or by at least `least`."""
    a, b = F.col("pooled"), F.col("local")
    both = pooled.select("t", F.col("d1").alias("pooled")).join(local.select("t", F.col("d1").alias("local")), "t")
    return both.select("t", "pooled", "local", ((F.signum(a) * F.signum(b) < 0) | (F.abs(a - b) >= least)).alias("shifted"))


def over_targets(gaps: DataFrame) -> DataFrame:
    """One row: equal and cell-weighted mean of a gap that isn't null."""
    known = gaps.where("d1 is not null")
    return known.agg(F.avg("d1").alias("equal_mean"), (F.sum(F.col("d1") * F.col("cells")) / F.sum("cells")).alias("cell_mean"), F.count(F.lit(1)).alias("targets"))
