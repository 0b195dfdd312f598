"""Scores of imputations: prediction table, masked errors, series, Other, Wasserstein, seeds.

The prediction table has one row per hidden cell, model, mask and seed. Errors of an empty group are
null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import compositions as co
from tallyloom.operators import imputers, masking, residual

#: Groups of hidden cells over which errors are taken.
GROUPS = ("all", "truth_zero", "truth_positive", "forced_zero", "model", "model_truth_zero")


def visible(panel: DataFrame, hidden: Column) -> DataFrame:
    """The panel with truth (its counts), h and c without the hidden cells: models see only c."""
    marked = panel.withColumn("truth", F.col("c")).withColumn("h", hidden)
    return marked.withColumn("c", F.zip_with("truth", "h", lambda v, h: F.when(~h, v)))


def hidden_cells(panel: DataFrame, mask: str, rate: float, seeds: list[int]) -> DataFrame:
    """panel by seed with the hidden cells marked, as visible() gives it; the seeds are rows of one plan."""
    every = panel.withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))
    if mask == "random_cell":
        return visible(every, masking.random_cell(rate, F.col("seed")))
    weights = masking.matched_weights(panel) if mask == "whole_feature_matched" else None
    taken = None
    for s in seeds:  # one small plan a seed: series, not cells
        one = masking.whole_feature(panel, rate, s, weights).where("taken").groupBy("e").agg(F.collect_set("t").alias("series")).withColumn("seed", F.lit(s).cast("long"))
        taken = one if taken is None else taken.unionByName(one)
    joined = every.join(taken, ["e", "seed"], "left")
    hidden = F.transform("c", lambda v, i: v.isNotNull() & F.coalesce(F.array_contains("series", i), F.lit(False)))
    return visible(joined, hidden).drop("series")


def predictions(panel: DataFrame, models: list[str], seeds: list[int], rate: float = 0.1, rule: str = "cap", mask: str = "random_cell", own: dict | None = None) -> DataFrame:
    """Prediction table of models under a mask; the seeds are rows of one plan a model.

    own: models (panel -> panel with p, or with filled) that take one panel at a time, by name.
    """
    shown = hidden_cells(panel, mask, rate, seeds)
    blind = shown.drop("truth", "h")  # the truth is absent, not just ignored
    answer = shown.select("row_id", "seed", "truth", "h").where(F.exists("h", lambda x: x))
    completed = lambda df: df if "filled" in df.columns else residual.fill(df, rule)
    out = None
    for name in models:
        if own and name in own:
            parts = [completed(own[name](blind.where(F.col("seed") == s).drop("seed"))).withColumn("seed", F.lit(s).cast("long")) for s in seeds]
        else:
            parts = [completed(imputers.MODELS[name](blind, by=("seed",)))]
        forced = F.transform("c", lambda v: v.isNull() & ((F.col("n") - co.total(F.col("c"))) == 0))
        for filled in parts:
            rows = filled.select("row_id", "seed", "e", "grp", "days", "n", "filled", forced.alias("z")).withColumn("model", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
    both = out.join(answer, ["row_id", "seed"])
    cell = F.posexplode(F.arrays_zip("h", "truth", "filled", "z")).alias("t", "x")
    return both.select("model", "row_id", "seed", "e", "grp", "days", "n", cell).where("x.h").select(
        "row_id", "e", "grp", "days", "n", "t", F.col("x.truth").alias("truth_count"), F.col("x.filled").alias("pred_count"), (F.col("x.truth") / F.col("n")).alias("truth_prop"), (F.col("x.filled") / F.col("n")).alias("pred_prop"),
        "model", F.lit(mask).alias("mask"), "seed", F.col("x.z").alias("forced_zero"), (~F.col("x.z")).alias("model_cell"), (F.col("x.truth") == 0).alias("truth_zero"),
    )


def in_group(group: str) -> Column:
    return {
        "all": F.lit(True),
        "truth_zero": F.col("truth_zero"),
        "truth_positive": ~F.col("truth_zero"),
        "forced_zero": F.col("forced_zero"),
        "model": F.col("model_cell"),
        "model_truth_zero": F.col("model_cell") & F.col("truth_zero"),
    }[group]


def masked_errors(rows: DataFrame, by: list[str]) -> DataFrame:
    """mae and mse of counts and shares by model, seed and group of cells, in one aggregation."""
    a, b = F.col("pred_count") - F.col("truth_count"), F.col("pred_prop") - F.col("truth_prop")
    parts = {"mae_count": F.abs(a), "mse_count": a * a, "mae_prop": F.abs(b), "mse_prop": b * b}
    sums = [F.avg(F.when(in_group(g), x)).alias(f"{m}__{g}") for g in GROUPS for m, x in parts.items()] + [F.count_if(in_group(g)).alias(f"cells__{g}") for g in GROUPS]
    wide = rows.groupBy(*by).agg(*sums)
    made = F.explode(F.array(*(F.struct(F.lit(g).alias("cell_group"), F.col(f"cells__{g}").alias("cells"), *(F.col(f"{m}__{g}").alias(m) for m in parts)) for g in GROUPS))).alias("x")
    return wide.select(*by, made).select(*by, "x.*")


def series_macro(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean over (entity, target) series of the series' mean absolute error of shares."""
    per = rows.groupBy(*by, "e", "t").agg(F.avg(F.abs(F.col("pred_prop") - F.col("truth_prop"))).alias("mae"))
    return per.groupBy(*by).agg(F.avg("mae").alias("series_macro_mae_prop"), F.count(F.lit(1)).alias("series"))


def implied_other(rows: DataFrame, by: list[str], whole: DataFrame) -> DataFrame:
    """Error of Other that a row's hidden cells imply: (sum of truths - sum of predictions) / n.

    whole: row_id of the rows that were complete before masking; only there the true Other is known.
    """
    per = rows.join(whole.select("row_id"), "row_id", "left_semi").groupBy(*by, "row_id", "e").agg(((F.sum("truth_count") - F.sum("pred_count")) / F.max("n")).alias("d"))
    return per.groupBy(*by).agg(F.avg(F.abs("d")).alias("other_mae"), F.avg("d").alias("other_bias"), F.count(F.lit(1)).alias("rows"), F.countDistinct("e").alias("entities"))


def wasserstein(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distance of two weighted samples by key: rows by, side (a or b), value, weight; null if one is empty.

    Equal values are folded first, so the window's rows are distinct values.
    """
    value = rows.groupBy(*by, "value").agg(F.coalesce(F.sum(F.when(F.col("side") == "a", F.col("weight"))), F.lit(0.0)).alias("wa"), F.coalesce(F.sum(F.when(F.col("side") == "b", F.col("weight"))), F.lit(0.0)).alias("wb"))
    order = Window.partitionBy(*by).orderBy("value")
    whole = Window.partitionBy(*by)
    share = lambda w: F.sum(w).over(order) / F.nullif(F.sum(w).over(whole), F.lit(0.0))
    step = F.abs(share("wa") - share("wb")) * (F.lead("value").over(order) - F.col("value"))
    empty = (F.sum("wa").over(whole) == 0) | (F.sum("wb").over(whole) == 0)
    return value.select(*by, step.alias("d"), empty.alias("empty")).groupBy(*by).agg(F.when(~F.bool_or("empty"), F.coalesce(F.sum("d"), F.lit(0.0))).alias("distance"))


def seed_summary(runs: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and sample deviation over seeds (null for one), runs that have the value and that don't."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("runs_ok"), F.count_if(F.col(value).isNull()).alias("runs_failed"))


def common_seeds(runs: DataFrame, models: int, value: str = "mae_prop") -> DataFrame:
    """runs of the seeds for which all models have the value: relational division by one count."""
    good = runs.where(F.col(value).isNotNull()).groupBy("seed").agg(F.countDistinct("model").alias("m")).where(F.col("m") == models).select("seed")
    return runs.join(good, "seed", "left_semi")


def ranking(runs: DataFrame, value: str = "mae_prop") -> DataFrame:
    """model, mean, place: by mean, null last, then name. The input is one row per model and seed."""
    mean = runs.groupBy("model").agg(F.avg(value).alias("mean"))
    return mean.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean").asc_nulls_last(), "model")).cast("long"))


def pairs(runs: DataFrame, value: str = "mae_prop") -> DataFrame:
    """Model pairs a < b over common seeds: mean and deviation of the difference, wins, ties, sign test."""
    a, b = runs.select("seed", F.col("model").alias("a"), F.col(value).alias("x")), runs.select("seed", F.col("model").alias("b"), F.col(value).alias("y"))
    joined = a.join(b, "seed").where((F.col("a") < F.col("b")) & F.col("x").isNotNull() & F.col("y").isNotNull())
    d = F.col("x") - F.col("y")
    out = joined.groupBy("a", "b").agg(F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"), F.count_if(d < 0).alias("wins"), F.count_if(d > 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    return out.withColumn("p", sign_test(F.col("wins"), F.col("losses")))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided p; null without a decision. Terms C(n, i) / 2^n by their recurrence."""
    n = (wins + losses).cast("double")
    low = F.least(wins, losses).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    tail = F.aggregate(F.when(low > 0, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>")), start, step)["sum"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def rank_flips(cells: DataFrame, series: DataFrame) -> DataFrame:
    """Model pairs that the cell-weighted and the series-macro means put in different order."""
    both = cells.groupBy("model").agg(F.avg("mae_prop").alias("x")).join(series.groupBy("model").agg(F.avg("series_macro_mae_prop").alias("y")), "model")
    a, b = both.select(F.col("model").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya")), both.select(F.col("model").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    joined = a.join(b, F.col("a") < F.col("b"))
    return joined.select("a", "b", (F.signum(F.col("xa") - F.col("xb")) != F.signum(F.col("ya") - F.col("yb"))).alias("flipped"))


def reliability(scheduled: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every scheduled (model, seed) with its status, 'missing' without an outcome, counted by model."""
    status = scheduled.join(outcomes, ["model", "seed"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return status.groupBy("model").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "missing").alias("missing"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("status") != "completed", F.col("seed")))), lambda x: x.cast("string"))).alias("not_completed"))


def stratum_errors(rows: DataFrame, cut: DataFrame, least: int = 30) -> DataFrame:
    """mae of shares of model-decided cells by model, seed and stratum, for groups and for classes of n; null below `least` cells.

    cut: one row q1, q2, the panel's tertiles (masking.cuts).
    """
    size = F.when(F.col("n") <= F.col("q1"), "N1").when(F.col("n") <= F.col("q2"), "N2").otherwise("N3")
    kinds = F.explode(F.array(F.struct(F.lit("group").alias("kind"), F.col("grp").alias("stratum")), F.struct(F.lit("size").alias("kind"), size.alias("stratum"))))
    labelled = rows.where("model_cell").join(F.broadcast(cut)).withColumn("kind", kinds)
    out = labelled.groupBy("model", "seed", "kind.kind", "kind.stratum").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.abs(F.col("pred_prop") - F.col("truth_prop"))).alias("mae"))
    return out.withColumn("mae", F.when(F.col("cells") >= least, F.col("mae")))
