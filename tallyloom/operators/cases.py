"""Case tables: do diagnostics that need no truth order models as their errors do?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIE = 1e-3


def pairwise(cases: DataFrame) -> DataFrame:
    """seed, a, b, verdict of model pairs: tie, match, mismatch or na.

    cases: seed, model, ord, error, diagnostic. A pair ties if the errors differ by less than 1e-3;
    it matches if the diagnostics differ in the same direction.
    """
    side = lambda s: cases.select("seed", *(F.col(c).alias(c + s) for c in ("model", "ord", "error", "diagnostic")))
    joined = side("_a").join(side("_b"), "seed").where("ord_a < ord_b")
    de, dd = F.col("error_a") - F.col("error_b"), F.col("diagnostic_a") - F.col("diagnostic_b")
    verdict = F.when(de.isNull() | dd.isNull(), "na").when(F.abs(de) < TIE, "tie").when((dd != 0) & (F.signum(dd) == F.signum(de)), "match").otherwise("mismatch")
    return joined.select("seed", F.col("model_a").alias("a"), F.col("model_b").alias("b"), verdict.alias("verdict"))


def agreement(pairs: DataFrame) -> DataFrame:
    """seed, rate of matches among pairs that are neither tie nor na (null without any)."""
    decided = F.col("verdict").isin("match", "mismatch")
    return pairs.groupBy("seed").agg(F.avg(F.when(decided, (F.col("verdict") == "match").cast("double"))).alias("rate"), F.count_if(decided).alias("decided"))


def regret(cases: DataFrame) -> DataFrame:
    """seed, chosen, regret: the error of the model with the least diagnostic less the least error."""
    known = cases.where("error is not null and diagnostic is not null")
    best = known.groupBy("seed").agg(F.min_by(F.struct("model", "error"), F.struct("diagnostic", "ord")).alias("pick"), F.min("error").alias("least"))
    return best.select("seed", F.col("pick.model").alias("chosen"), (F.col("pick.error") - F.col("least")).alias("regret"))


def verdict(rates: DataFrame, regrets: DataFrame, least_mean: float = 0.8, least_each: float = 0.5, least_cases: int = 4, most_regret: float = 0.005, good_cases: int = 9) -> DataFrame:
    """One row: cases, mean and least rate, verdict (pass, fail, insufficient below least_cases), cases of small regret, regret_ok."""
    a = rates.where("rate is not null").agg(F.count(F.lit(1)).alias("cases"), F.avg("rate").alias("mean_rate"), F.min("rate").alias("least_rate"))
    b = regrets.agg(F.count_if(F.col("regret") <= most_regret).alias("small_regret"), F.count(F.lit(1)).alias("regrets"))
    good = (F.col("mean_rate") >= least_mean) & (F.col("least_rate") >= least_each)
    said = F.when(F.col("cases") < least_cases, "insufficient").when(good, "pass").otherwise("fail")
    return a.join(F.broadcast(b)).withColumn("verdict", said).withColumn("regret_ok", F.col("small_regret") >= good_cases)


def verdict_by_mask(rates: DataFrame, least_mean: float = 0.8, least_each: float = 0.5, least_cases: int = 4) -> DataFrame:
    """mask, cases, mean_rate, least_rate, verdict: a row a mask, and one without a mask for all.

    rates: mask, rate, a row a case; null rates are no cases. A mask of fewer than least_cases cases is
    insufficient, and so is all if any mask is; all passes if every mask does.
    """
    per = rates.groupBy("mask").agg(F.count("rate").alias("cases"), F.avg("rate").alias("mean_rate"), F.min("rate").alias("least_rate"))
    good = (F.col("mean_rate") >= least_mean) & (F.col("least_rate") >= least_each)
    said = per.withColumn("verdict", F.when(F.col("cases") < least_cases, "insufficient").when(good, "pass").otherwise("fail"))
    worst = F.when(F.count_if(F.col("verdict") == "insufficient") > 0, "insufficient").when(F.count_if(F.col("verdict") == "fail") > 0, "fail").otherwise("pass")
    whole = said.agg(F.count(F.lit(1)).alias("masks"), F.sum("cases").alias("cases"), (F.sum(F.col("mean_rate") * F.col("cases")) / F.sum("cases")).alias("mean_rate"), F.min("least_rate").alias("least_rate"), worst.alias("verdict")).where("masks > 0")
    return said.unionByName(whole.withColumn("mask", F.lit(None).cast(said.schema["mask"].dataType)).drop("masks"))


def decoys_worse(scores: DataFrame, real: list[str], decoys: list[str], higher_is_worse: bool = True) -> DataFrame:
    """mask, case, decoy, worse: does the score put the decoy strictly behind every real model?

    scores: mask, case, model, score. worse is null where the decoy or any real model has no score.
    """
    sign = 1 if higher_is_worse else -1
    own = F.when(F.col("model").isin(real), F.col("score") * sign)
    # Of repeated rows the least bad one counts for a decoy, the worst one for a real model.
    fake = F.array(*(F.struct(F.lit(m).alias("decoy"), F.min(F.when(F.col("model") == m, F.col("score") * sign)).alias("score")) for m in decoys))
    per = scores.groupBy("mask", "case").agg(F.max(own).alias("worst"), F.countDistinct(F.when(own.isNotNull(), F.col("model"))).alias("known"), fake.alias("fake"))
    each = per.select("mask", "case", "worst", "known", F.explode("fake").alias("f"))
    return each.select("mask", "case", "f.decoy", F.when(F.col("known") == len(real), F.col("f.score") > F.col("worst")).alias("worse"))


def outside_span(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with positive (filled with a count) and flag: positive on a day outside the target's days of positive visible counts.

    spans: seed, t, first_day, last_day (null where a target has no positive count: every day is outside).
    """
    joined = rows.join(F.broadcast(spans), ["seed", "t"], "left").withColumn("positive", F.col("pred_count") >= 0.5)
    outside = F.col("first_day").isNull() | (F.col("days") < F.col("first_day")) | (F.col("days") > F.col("last_day"))
    return joined.withColumn("flag", F.col("positive") & outside)


def flag_precision(cells: DataFrame) -> DataFrame:
    """model, seed: cells filled as positive, flagged and not, the share of true zeros in both, and its gap."""
    zero = F.col("truth_zero").cast("double")
    out = cells.where("positive").groupBy("model", "seed").agg(F.count_if("flag").alias("flagged"), F.count_if(~F.col("flag")).alias("unflagged"), F.avg(F.when(F.col("flag"), zero)).alias("p_flagged"), F.avg(F.when(~F.col("flag"), zero)).alias("p_unflagged"))
    return out.withColumn("gap", F.col("p_flagged") - F.col("p_unflagged"))


def flag_verdict(gaps: DataFrame, least_gap: float = 0.2, good_cases: int = 9) -> DataFrame:
    """One row: cases with a gap, those of at least least_gap, verdict (insufficient below good_cases)."""
    out = gaps.agg(F.count("gap").alias("cases"), F.count_if(F.col("gap") >= least_gap).alias("good"))
    return out.withColumn("verdict", F.when(F.col("cases") < good_cases, "insufficient").when(F.col("good") >= good_cases, "pass").otherwise("fail"))


def zero_gap(rows: DataFrame, visible_rates: DataFrame) -> DataFrame:
    """model, seed, diagnostic: D1 of the model-decided cells without their truth, its size over targets weighted by cells.

    visible_rates: seed, t, zero, the share of zeros among the visible cells.
    """
    per = rows.where("model_cell").groupBy("model", "seed", "t").agg(F.count(F.lit(1)).alias("cells"), F.avg((F.col("pred_count") < 0.5).cast("double")).alias("filled"))
    gap = per.join(F.broadcast(visible_rates), ["seed", "t"]).withColumn("gap", F.abs(F.col("filled") - F.col("zero")))
    return gap.groupBy("model", "seed").agg((F.sum(F.col("gap") * F.col("cells")) / F.sum("cells")).alias("diagnostic"))


def hypothesis(pairs: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """One row: is model a better than b (mean difference below 0 and sign test at alpha), or not worse?"""
    row = pairs.where((F.col("a") == min(a, b)) & (F.col("b") == max(a, b)))
    sign = 1 if a < b else -1
    diff = sign * F.col("mean_diff")
    return row.select(F.lit(a).alias("model"), F.lit(b).alias("against"), diff.alias("mean_diff"), F.col("p"), F.coalesce((diff < 0) & (F.col("p") <= alpha), F.lit(False)).alias("better"), F.coalesce(~((diff > 0) & (F.col("p") <= alpha)), F.lit(False)).alias("not_worse"))
