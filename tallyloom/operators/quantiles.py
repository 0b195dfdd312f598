"""Exact quantiles of many groups at once, by counting within ranges that a sketch places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.storage import saved

#: Ranges of one pass, and so many rows of a group that one task may put in order.
RANGES, FEW = 200, 200_000


def quantiles(rows: DataFrame, by: list[str], value: Column, q: float = 0.5, few: int | None = None, at: Column | None = None) -> DataFrame:
    """by, n, quantile: linear between the two order statistics; null values take no part.

    at: the wanted rank from 0, of by and n, instead of q; whole ranks give the order statistic itself.

    A pass sketches RANGES quantiles of what is left of each group, keeps the four ranges around the
    wanted rank and counts what lies below them; the sketch's error is a tenth of a range, so the
    rank is always within, and the counts are checked. Passes go on until no group has more than
    FEW rows left or none shrinks, as a value that fills its ranges doesn't; then equal values are
    folded and the few that differ are put in order.
    """
    few, key = FEW if few is None else few, by or ["_all"]
    left = rows.select(*(by or [F.lit(0).alias("_all")]), value.alias("v")).where("v IS NOT NULL")
    at = (F.col("n") - 1) * q if at is None else at.cast("double")
    ranks = saved(left.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.floor(at)).withColumn("past", at - F.floor(at)).withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.col("n")), "ranks")
    most = ranks.agg(F.max("inside")).first()[0] or 0
    while most > few:
        cut = left.groupBy(*key).agg(F.percentile_approx("v", F.array(*(F.lit(i / RANGES) for i in range(RANGES + 1))), 10 * RANGES).alias("cut"))
        first = F.floor((F.col("at") - F.col("below")) / F.col("inside") * RANGES)
        edge = lambda i: F.element_at("cut", (F.greatest(F.lit(0), F.least(F.lit(RANGES), first + i)) + 1).cast("int"))
        placed = saved(ranks.join(cut, key).select(*ranks.columns, edge(-1).alias("low"), edge(3).alias("high")), "ranges")
        marked = left.join(placed.select(*key, "low", "high"), key)
        counts = saved(marked.groupBy(*key).agg(F.count_if(F.col("v") < F.col("low")).alias("under"), F.count_if(F.col("v").between(F.col("low"), F.col("high"))).alias("within")), "counts")
        left = saved(marked.where("v BETWEEN low AND high").select(*key, "v"), "left")
        ranks = saved(placed.drop("low", "high").join(counts, key).withColumn("below", F.col("below") + F.col("under")).withColumn("inside", F.col("within")).drop("under", "within"), "ranks")
        if not ranks.where("at < below OR least(at + 1, n - 1) >= below + inside").isEmpty():
            raise ArithmeticError("a sketch placed a range beside its rank")
        before, most = most, ranks.agg(F.max("inside")).first()[0]
        if most == before:
            break
    same = left.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("same"))
    upto = F.sum("same").over(Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ordered = same.withColumn("upto", upto).join(ranks, key).withColumn("rank", F.col("at") - F.col("below"))
    found = ordered.groupBy(*key, "n", "past").agg(F.min(F.when(F.col("upto") > F.col("rank"), F.col("v"))).alias("lower"), F.min(F.when(F.col("upto") > F.col("rank") + 1, F.col("v"))).alias("upper"))
    return found.select(*by, "n", F.when(F.col("past") > 0, F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("past")).otherwise(F.col("lower")).alias("quantile"))
