"""Zero gaps and impossible cells of filled tables at every level: target, stratum, mask, model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.support import ZERO_BELOW

LEAST_CELLS = 30


def strata() -> Column:
    """kind and stratum of a cell: all cells, its group, its class of n (q1, q2)."""
    size = F.when(F.col("n") <= F.col("q1"), "N1").when(F.col("n") <= F.col("q2"), "N2").otherwise("N3")
    kinds = (F.lit("all"), F.lit("all")), (F.lit("group"), F.col("grp")), (F.lit("size"), size)
    return F.explode(F.array(*(F.struct(k.alias("kind"), s.alias("stratum")) for k, s in kinds)))


def diagnose(filled: DataFrame, observed: DataFrame, cut: DataFrame, least: int = LEAST_CELLS) -> DataFrame:
    """level, mask, model, kind, stratum, t, cells, equal, weighted, targets, d3_cells, d3_mass.

    filled: mask, model, t, grp, days, n, count, the cells that a model decided; observed: mask, t, grp,
    days, n, c, the cells that it saw; cut: one row q1, q2. A target's gap is its share of zeros among the
    filled cells less that among the observed ones; in a stratum it is null under `least` filled
    cells. Level target has a row a target, there equal and weighted are the gap; level mask takes
    the mean over targets with a gap, and the mean weighted by cells; level model does over all
    masks. d3: filled counts outside the days of the target's positive observed counts, and their
    shares; null for strata under `least` cells. Cells are folded once by target and stratum, the
    levels are grouping sets over that fold.
    """
    zero = lambda c: F.avg((F.col(c) < ZERO_BELOW).cast("double"))
    keys = ["mask", "t", "kind", "stratum"]
    days = F.when(F.col("c") > 0, F.col("days"))
    span = observed.groupBy("mask", "t").agg(F.min(days).alias("first"), F.max(days).alias("last"))
    flag = F.coalesce((F.col("count") >= ZERO_BELOW) & ((F.col("days") < F.col("first")) | (F.col("days") > F.col("last"))), F.lit(False))
    flagged = filled.join(F.broadcast(span), ["mask", "t"]).join(F.broadcast(cut)).select("*", flag.alias("flag"), strata().alias("s")).select("*", "s.*")
    per = flagged.groupBy("model", *keys).agg(F.count(F.lit(1)).alias("cells"), zero("count").alias("x"), F.count_if("flag").alias("d3"), F.coalesce(F.sum(F.when(F.col("flag"), F.col("count") / F.col("n"))), F.lit(0.0)).alias("mass"))
    seen = observed.join(F.broadcast(cut)).select("*", strata().alias("s")).select("*", "s.*").groupBy(*keys).agg(zero("c").alias("y"))
    enough = lambda n: (F.col("kind") == "all") | (n >= least)
    gaps = per.join(seen, keys, "left").withColumn("d1", F.when(enough(F.col("cells")), F.col("x") - F.col("y")))
    shared = ["model", "kind", "stratum"]
    level = F.when(F.grouping("t") == 0, "target").when(F.grouping("mask") == 0, "mask").otherwise("model")
    known = F.sum(F.when(F.col("d1").isNotNull(), F.col("cells")))
    every = gaps.groupingSets([["mask", *shared, "t"], ["mask", *shared], shared], "mask", *shared, "t").agg(
        level.alias("level"), F.sum("cells").alias("all_cells"), F.avg("d1").alias("equal"), (F.sum(F.col("d1") * F.col("cells")) / known).alias("weighted"), F.count("d1").alias("targets"), F.sum("d3").alias("d3"), F.sum("mass").alias("mass")
    )
    shown = enough(F.col("all_cells"))
    return every.select("level", "mask", *shared, "t", F.col("all_cells").alias("cells"), "equal", "weighted", "targets", F.when(shown, F.col("d3")).alias("d3_cells"), F.when(shown, F.col("mass")).alias("d3_mass"))
