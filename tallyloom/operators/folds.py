"""Donors with medians to fall back on, and the choice of their number by nested folds of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import compositions as co
from tallyloom.operators import masking, metric, neighbours
from tallyloom.operators.quantiles import quantiles
from tallyloom.panel import model_input
from tallyloom.storage import saved

#: Candidates for the number of donors, and the one that is taken where no fold has a score.
KS, DEFAULT_K = (1, 3, 5, 8), 8


def long_shares(x: DataFrame, *own: str) -> DataFrame:
    return x.select(*own, F.posexplode("x").alias("t", "x"))


def medians(x: DataFrame, *by: str) -> DataFrame:
    """by, t, median of the positive shares of each part."""
    return quantiles(long_shares(x, *by).where("x > 0"), [*by, "t"], F.col("x")).select(*by, "t", F.col("quantile").alias("median"))


def with_medians(panel: DataFrame, k: int = 8, adjustment: str = "median", exclude_own: bool = False) -> DataFrame:
    """row_id, t, p, fallback of every missing part: the median of k donors' proposals, else the part's median.

    The part's median, 1 where it is never positive, stands in for rows that show nothing, for parts
    that no usable donor has, and for proposals that aren't positive.
    """
    x = model_input(panel).select("row_id", "x")
    missing = long_shares(x, "row_id").where("x IS NULL").select("row_id", "t")
    found = neighbours.hron(panel, k, adjustment, "index", exclude_own).select("row_id", "t", F.when(F.col("p") > 0, F.col("p")).alias("p"))
    filled = missing.join(found, ["row_id", "t"], "left").join(medians(x), "t", "left")
    return filled.select("row_id", "t", F.coalesce("p", "median", F.lit(1.0)).alias("p"), F.col("p").isNull().alias("fallback"))


def fold_scores(panel: DataFrame, ks: tuple[int, ...] = KS, rate: float = 0.2, seed: int = 0, donor_rows: int | None = None) -> DataFrame:
    """fold, entity, k, m2, rows, parts, fallbacks: how well k donors refill an entity within an outer fold.

    Outer folds are the groups, inner ones the entities. In an outer fold the group gives no rows; each
    other entity's complete rows lose cells by a random mask (and with them Other), and are refilled
    from the training rows of the other entities. m2 is the mean squared Aitchison distance between a
    row that lost cells and its refill. Distances don't depend on folds and are taken once: a part's list
    has its nearest donors from each group, of other entities, and a fold's donors are those of its groups.
    Where a list is empty the median of the part over the outer fold's training rows stands in.
    """
    most = max(ks)
    complete = co.complete(F.col("c"))
    gone = F.when(complete, masking.random_cell(rate, seed))
    x = saved(model_input(panel).select("row_id", "e", "entity", F.col("grp").alias("label"), "x", F.concat(gone, F.array(F.exists(gone, lambda h: h))).alias("gone")), "fold-shares")
    asked = x.where(F.exists("gone", lambda h: h)).select("row_id", "e", "entity", F.col("label").alias("home"), F.col("x").alias("truth"), "gone", F.zip_with("x", "gone", lambda v, h: F.when(~h, v)).alias("shown"))
    donors = metric.folded(x, True, most, "label")
    found = metric.closest(asked.select(F.col("row_id").alias("query"), F.col("shown").alias("x"), "e"), donors, "aitchison", most, "index", neighbours.parts_of(x), True, True, "median", donor_rows)
    each = found.withColumnRenamed("query", "row_id").withColumn("donor", F.explode("ids")).select("row_id", "t", "label", "donor", "d", "value")
    lists = saved(neighbours.merged(each, most, "index", ["row_id", "t", "label"]).drop("nth"), "fold-donors")
    # One row a group; a fold's training rows are those of the other groups.
    groups = F.array(*(F.lit(r.label) for r in x.select("label").distinct().orderBy("label").collect()))
    others = lambda *labels: F.explode(F.array_except(groups, F.array(*labels))).alias("fold")
    within = lists.join(asked.select("row_id", "home"), "row_id").select("row_id", "t", "donor", "d", "value", others("label", "home"))
    nth = neighbours.merged(within, most, "index", ["fold", "row_id", "t"])
    proposals = nth.groupBy("fold", "row_id", "t").agg(F.array(*(F.percentile(F.when(F.col("nth") <= k, F.col("value")), 0.5) for k in ks)).alias("p"))
    by_t = lambda rows, value: rows.agg(F.map_from_entries(F.collect_list(F.struct("t", value))).alias("by_" + value))
    middle = by_t(medians(x.select(others("label"), "x"), "fold").groupBy("fold"), "median")
    rows = asked.select("*", others("home")).join(by_t(proposals.groupBy("fold", "row_id"), "p"), ["fold", "row_id"], "left").join(middle, "fold", "left")
    spoken = F.coalesce(F.col("by_p"), F.create_map().cast("map<int,array<double>>"))
    spare = lambda t: F.coalesce(F.element_at("by_median", t), F.lit(1.0))
    filled = lambda i: F.transform("shown", lambda v, t: F.coalesce(v, F.get(F.element_at(spoken, t), F.lit(i)), spare(t)))
    lost = F.size(F.filter("gone", lambda h: h))
    empty = F.size(F.filter(F.transform("gone", lambda h, t: h & ~F.map_contains_key(spoken, t)), lambda h: h))
    scores = F.array(*(F.struct(F.lit(k).alias("k"), F.pow(co.aitchison(F.col("truth"), filled(i)), F.lit(2.0)).alias("m2")) for i, k in enumerate(ks)))
    scored = rows.select("fold", "entity", lost.alias("lost"), empty.alias("empty"), F.explode(scores).alias("s"))
    return scored.groupBy("fold", "entity", "s.k").agg(F.avg("s.m2").alias("m2"), F.count(F.lit(1)).alias("rows"), F.sum("lost").alias("parts"), F.sum("empty").alias("fallbacks"))


def choice(scores: DataFrame) -> DataFrame:
    """fold, k, m2, folds: the least mean over inner folds of fold_scores() for each outer fold, ties to the smaller k."""
    means = scores.groupBy("fold", "k").agg(F.avg("m2").alias("m2"), F.count("m2").alias("folds"))
    order = Window.partitionBy("fold").orderBy(F.round("m2", 12).asc_nulls_last(), "k")
    best = means.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return best.select("fold", F.when(F.col("folds") > 0, F.col("k")).otherwise(DEFAULT_K).alias("k"), "m2", "folds")
