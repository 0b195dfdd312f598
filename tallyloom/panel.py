"""Count panels: one row per entity and time, an array of counts, the row total n.

A panel has row_id, e (entity number), entity, grp, days, n DOUBLE, c ARRAY<DOUBLE> in the order of
its targets; a null count is missing, a 0 is observed. What the counts leave of n is the part Other.
Row-wise work stays on the array and never shuffles; cells() gives the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import compositions as co
from tallyloom.functions.hashing import NATIVE, uniform

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
EVENTS = ["click", "error", "purchase", "signup"]
FIRST_DAY = "1995-01-01"
MISSING_RATE = 0.2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation and month: targets are the first four priorities."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.datediff(month, F.lit(FIRST_DAY).cast("date")).cast("long").alias("days"), "o_orderpriority")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # Folded by customer's nation before names come in: the small tables join after the shuffle.
    counts = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy("c_nationkey", "days").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.count_if(F.col("o_orderpriority") == p).cast("double").alias(f"c{k}") for k, p in enumerate(PRIORITIES)))
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = counts.join(nation, counts["c_nationkey"] == nation["n_nationkey"])
    e = F.col("n_nationkey").cast("long")
    return named.select((e * 100_000 + F.col("days")).alias("row_id"), e.alias("e"), F.col("n_name").alias("entity"), F.col("r_name").alias("grp"), "days", "n", F.array(*(f"c{k}" for k in range(len(PRIORITIES)))).alias("c"))


def events_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and day: targets are four of the five kinds, groups user_id mod 5."""
    days = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    counts = read(spark, sf_dir, "events").select("user_id", days.alias("days"), "event_type").groupBy("user_id", "days").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.count_if(F.col("event_type") == k).cast("double").alias(f"c{i}") for i, k in enumerate(EVENTS)))
    e = F.col("user_id").cast("long")
    return counts.select((e * 100_000 + F.col("days")).alias("row_id"), e.alias("e"), e.cast("string").alias("entity"), F.pmod(e, F.lit(5)).cast("string").alias("grp"), "days", "n", F.array(*(f"c{k}" for k in range(len(EVENTS)))).alias("c"))


def hide(panel: DataFrame, hidden: Column) -> DataFrame:
    """The panel with counts nulled where the boolean array says so."""
    return panel.withColumn("c", F.zip_with("c", hidden, lambda v, h: F.when(~h, v)))


def native_missing(rate: float = MISSING_RATE, seed: int = 0) -> Column:
    """Boolean array: cells that the panel itself lacks, by the shared uniform."""
    return F.transform("c", lambda v, i: uniform(F.col("e"), F.col("days"), i, NATIVE + seed) < rate)


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hide(orders_full(spark, sf_dir), native_missing())


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hide(events_full(spark, sf_dir), native_missing())


def cells(panel: DataFrame, *more: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Long form: row_id, e, entity, grp, days, n, t (target number), c, elements of `more` arrays, and by."""
    parts = F.arrays_zip(F.col("c").alias("c"), *(F.col(m).alias(m) for m in more))
    own = ["row_id", "e", "entity", "grp", "days", "n", *by]
    return panel.select(*own, F.posexplode(parts).alias("t", "cell")).select(*own, "t", "cell.c", *(f"cell.{m}" for m in more))


def targets(panel: DataFrame) -> int:
    """The number of targets, from the first row; 0 for an empty panel."""
    first = panel.select(F.size("c").alias("d")).first()
    return first["d"] if first else 0


def known_sum() -> Column:
    return co.total(F.col("c"))


def residual() -> Column:
    """What the known counts leave of n."""
    return F.col("n") - known_sum()


def other() -> Column:
    """Share of the part Other: known only on complete rows; the difference is taken before dividing."""
    return F.when(co.complete(F.col("c")), residual() / F.col("n"))


def proportions() -> Column:
    """Shares of the targets and of Other, unknown ones null."""
    return F.concat(F.transform("c", lambda v: v / F.col("n")), F.array(other()))


def forced_zero() -> Column:
    """Boolean array: missing cells of rows whose known counts use up n exactly."""
    return F.transform("c", lambda v: v.isNull() & (residual() == 0))


def half_least_positive(panel: DataFrame, with_other: bool = True) -> DataFrame:
    """One row: delta, half the least positive share of the targets (and Other)."""
    parts = proportions() if with_other else F.transform("c", lambda v: v / F.col("n"))
    least = F.array_min(F.filter(parts, lambda p: p > 0))
    return panel.select(least.alias("p")).agg((F.min("p") / 2).alias("delta"))


def model_input(panel: DataFrame) -> DataFrame:
    """The panel with x: shares with exact zeros raised to delta (a single row, broadcast)."""
    delta = half_least_positive(panel)
    return panel.join(F.broadcast(delta)).withColumn("x", F.transform(proportions(), lambda p: F.when(p == 0, F.col("delta")).otherwise(p)))
