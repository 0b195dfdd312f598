"""Per-entity sequences and older measures: carrying forward, interpolation, segments, log-ratio errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import compositions as co


def _orders() -> tuple[Window, Window]:
    base = Window.partitionBy("e", "t").orderBy("days")
    return base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(0, Window.unboundedFollowing)


def carried(cells: DataFrame, leading: bool = True, value: str = "c") -> DataFrame:
    """cells with carried: the last observed value of the entity's target, leading gaps from the next one."""
    past, future = _orders()
    last = F.last(value, ignorenulls=True).over(past)
    return cells.withColumn("carried", F.coalesce(last, F.first(value, ignorenulls=True).over(future)) if leading else last)


def interpolated(cells: DataFrame, value: str = "c") -> DataFrame:
    """cells with line: linear in days between observed values, the nearest one outside; never below 0."""
    past, future = _orders()
    point = F.when(F.col(value).isNotNull(), F.struct("days", F.col(value).alias("v")))
    marked = cells.withColumn("_p", F.last(point, ignorenulls=True).over(past)).withColumn("_q", F.first(point, ignorenulls=True).over(future))
    p, q = F.col("_p"), F.col("_q")
    between = p["v"] + (q["v"] - p["v"]) * (F.col("days") - p["days"]) / F.nullif(q["days"] - p["days"], F.lit(0))
    line = F.coalesce(F.col(value), between, p["v"], q["v"])
    return marked.withColumn("line", F.greatest(line, F.lit(0.0))).drop("_p", "_q")


def segments(rows: DataFrame, length: int, gap: int) -> DataFrame:
    """row_id, e, island, segment, place: runs without a gap over `gap` days, cut into `length` rows."""
    order = Window.partitionBy("e").orderBy("days")
    broken = rows.withColumn("new", F.coalesce((F.col("days") - F.lag("days").over(order) > gap).cast("int"), F.lit(1)))
    placed = broken.withColumn("island", F.sum("new").over(order)).withColumn("nth", F.row_number().over(Window.partitionBy("e", "island").orderBy("days")) - 1)
    return placed.select("row_id", "e", "island", F.floor(F.col("nth") / length).alias("segment"), (F.col("nth") % length).alias("place"))


def packed(panel: DataFrame, length: int) -> DataFrame:
    """e, segment, days, rows, parts: each entity's rows in time order, padded to `length` with row -1.

    Entities of more than `length` rows go on in segments 1, 2, ... of `length` rows; no row is left out.
    """
    numbered = panel.withColumn("segment", F.floor((F.row_number().over(Window.partitionBy("e").orderBy("days", "row_id")) - 1) / length))
    lists = numbered.groupBy("e", "segment").agg(F.sort_array(F.collect_list(F.struct("days", "row_id", "c"))).alias("s"))
    pad = lambda get, blank: F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= F.size("s"), get(F.element_at("s", i))).otherwise(blank))
    return lists.select("e", "segment", pad(lambda x: x["days"], F.lit(None).cast("long")).alias("days"), pad(lambda x: x["row_id"], F.lit(-1).cast("long")).alias("rows"), pad(lambda x: x["c"], F.lit(None).cast("array<double>")).alias("parts"))


def unpacked(packs: DataFrame) -> DataFrame:
    """row_id, days, c of every row that isn't padding."""
    return packs.select(F.explode(F.arrays_zip("days", "rows", "parts")).alias("x")).where("x.rows >= 0").select(F.col("x.rows").alias("row_id"), F.col("x.days").alias("days"), F.col("x.parts").alias("c"))


def clr_errors(rows: DataFrame, truth: Column, filled: Column) -> DataFrame:
    """rows with clr_mae and aitchison2 of two positive compositions."""
    diff = F.zip_with(co.clr(truth), co.clr(filled), lambda a, b: a - b)
    return rows.withColumn("clr_mae", co.total(F.transform(diff, F.abs)) / F.size(diff)).withColumn("aitchison2", co.total(F.transform(diff, lambda d: d * d)))


def covariance_gap(rows: DataFrame, truth: list[Column], filled: list[Column]) -> DataFrame:
    """One row: Frobenius norm of the difference of the two sample covariance matrices."""
    k = len(truth)
    terms = [F.pow(F.covar_samp(truth[i], truth[j]) - F.covar_samp(filled[i], filled[j]), F.lit(2.0)) for i in range(k) for j in range(k)]
    return rows.agg(F.sqrt(sum(terms[1:], terms[0])).alias("gap"))


def shannon(x: Column) -> Column:
    """Entropy of a closed composition; 0 ln 0 = 0."""
    return -co.total(F.transform(x, lambda v: F.when(v > 0, v * F.log(v)).otherwise(0.0)))


def prevalence_bins(cells: DataFrame) -> DataFrame:
    """t, prevalence, bin: targets in thirds by the share of observed cells that are positive."""
    share = cells.where("c is not null").groupBy("t").agg(F.avg((F.col("c") > 0).cast("double")).alias("prevalence"))
    rank = F.row_number().over(Window.orderBy("prevalence", "t")) - 1
    third = F.floor(rank * 3 / F.count(F.lit(1)).over(Window.partitionBy()))
    return share.select("t", "prevalence", F.element_at(F.array(F.lit("rare"), F.lit("middle"), F.lit("common")), (third + 1).cast("int")).alias("bin"))


def pattern_audit(panel: DataFrame) -> DataFrame:
    """e, patterns, always, sometimes: which targets an entity lacks in all rows, and in some."""
    gone = panel.select("e", F.transform("c", lambda v: v.isNull().cast("int")).alias("m"))
    d = 4
    per = gone.groupBy("e").agg(F.countDistinct("m").alias("patterns"), *(F.min(F.get("m", F.lit(j))).alias(f"lo{j}") for j in range(d)), *(F.max(F.get("m", F.lit(j))).alias(f"hi{j}") for j in range(d)))
    count = lambda tag: sum((F.col(f"{tag}{j}") for j in range(1, d)), F.col(f"{tag}0"))
    return per.select("e", "patterns", count("lo").alias("always"), (count("hi") - count("lo")).alias("sometimes"))


def detection_prepared(panel: DataFrame, threshold: float, pseudo: float) -> DataFrame:
    """row_id, x: counts under the threshold to 0, pseudo-count added, closed; null where incomplete."""
    cut = F.transform("c", lambda v: F.when(v < threshold, 0.0).otherwise(v))
    return panel.where(co.complete(F.col("c"))).select("row_id", co.closure(F.transform(cut, lambda v: v + pseudo)).alias("x"))


def masked_by_value(cells: DataFrame, quantile: float, u: Column, rate: float) -> DataFrame:
    """cells with gone: self-masking, values above the target's quantile are lost with probability rate."""
    limits = cells.where("c is not null").groupBy("t").agg(F.percentile("c", quantile).alias("limit"))
    return cells.join(F.broadcast(limits), "t").withColumn("gone", F.coalesce((F.col("c") > F.col("limit")) & (u < rate), F.lit(False)))
