"""Older baselines and checks: scaled means, feature order, fixed masks, logistic masks, plausibility.

Columns of a target are elements of the array c, so that row-wise work doesn't shuffle; what is
learned from a table is one row a target or one row in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import compositions as co
from tallyloom.operators.quantiles import quantiles


def column_means(panel: DataFrame, d: int) -> DataFrame:
    """One row: m, the means of the observed counts of each target."""
    return panel.agg(F.array(*(F.avg(F.get("c", F.lit(j))) for j in range(d))).alias("m"))


def scaled_means(panel: DataFrame, d: int) -> DataFrame:
    """The panel with filled: missing counts from the mean composition at the row's own scale.

    The scale is the median ratio of the row's positive counts to the composition, 1 without any.
    """
    means = column_means(panel, d).select(co.closure(F.col("m")).alias("mean"))
    both = F.arrays_zip(F.col("c").alias("c"), F.col("mean").alias("m"))
    ratios = F.transform(F.filter(both, lambda x: (x["c"] > 0) & (x["m"] > 0)), lambda x: x["c"] / x["m"])
    scale = F.coalesce(co.median_of(ratios), F.lit(1.0))
    return panel.join(F.broadcast(means)).withColumn("scale", scale).withColumn("filled", F.zip_with("c", "mean", lambda v, m: F.coalesce(v, m * F.col("scale")))).drop("mean")


def row_means(panel: DataFrame, d: int) -> DataFrame:
    """The panel with filled: missing counts are the mean of the row's positive ones, else of all means."""
    overall = column_means(panel, d).select((co.total(F.col("m")) / d).alias("overall"))
    positive = F.filter("c", lambda v: v > 0)
    own = F.when(F.size(positive) > 0, co.total(positive) / F.size(positive))
    return panel.join(F.broadcast(overall)).withColumn("own", F.coalesce(own, "overall")).withColumn("filled", F.transform("c", lambda v: F.coalesce(v, F.col("own")))).drop("own", "overall")


def feature_order(cells: DataFrame, value: str = "p") -> DataFrame:
    """t, score, place: targets by the geometric mean of their absolute Spearman correlations, own 1 included.

    cells: row_id, t and the value, none null. Average ranks come from counts of distinct values
    under a running sum, so ties are one row; a constant target counts as uncorrelated.
    """
    counts = cells.groupBy("t", value).agg(F.count(F.lit(1)).alias("same"))
    upto = Window.partitionBy("t").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn("rank", F.sum("same").over(upto) - (F.col("same") - 1) / 2.0)
    ranked = cells.join(ranks.select("t", value, "rank"), ["t", value]).select("row_id", "t", "rank")
    rows = ranked.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("t", "rank"))).alias("r"))
    pairs = rows.select(F.explode("r").alias("a"), "r").select("a", F.explode("r").alias("b"))
    rho = pairs.groupBy(F.col("a.t").alias("t"), F.col("b.t").alias("other")).agg(F.coalesce(F.nanvl(F.abs(F.corr("a.rank", "b.rank")), F.lit(0.0)), F.lit(0.0)).alias("rho"))
    mean = F.when(F.min("rho") > 0, F.exp(F.avg(F.ln(F.when(F.col("rho") > 0, F.col("rho")))))).otherwise(0.0)
    scores = rho.groupBy("t").agg(mean.alias("score"))
    return scores.select("t", "score", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "t")).alias("place"))


def reference_parts(cells: DataFrame, k: int, most: bool = False) -> DataFrame:
    """t, missing_rate of the k targets that lack the fewest cells (or the most), by number in ties."""
    rates = cells.groupBy("t").agg(F.avg(F.col("c").isNull().cast("double")).alias("missing_rate"))
    return rates.orderBy(F.col("missing_rate").desc() if most else F.col("missing_rate"), "t").limit(k)


def hidden_variants(panel: DataFrame, d: int, n: int = 3) -> DataFrame:
    """label, place, t: the n rarest, most middling and commonest targets on complete rows."""
    rows = panel.where(co.complete(F.col("c")))
    sums = co.total(F.col("c"))
    shares = rows.select(F.posexplode(F.transform("c", lambda v: F.struct((v > 0).cast("double").alias("on"), (v / F.nullif(sums, F.lit(0.0))).alias("share")))).alias("t", "x"))
    per = shares.groupBy("t").agg(F.avg("x.on").alias("prevalence"), F.coalesce(F.avg("x.share"), F.lit(0.0)).alias("abundance"))
    shown, mass = F.round("prevalence", 12), F.round("abundance", 12)
    orders = {"rare": [shown, mass, "t"], "middle": [F.abs(shown - 0.5), "t"], "common": [shown.desc(), mass.desc(), "t"]}
    numbered = per.select("t", *(F.row_number().over(Window.orderBy(*by)).alias(k) for k, by in orders.items()))
    placed = numbered.select("t", F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).alias("place")) for k in orders))).alias("o"))
    return placed.where(F.col("o.place") <= n).select("o.label", "o.place", "t")


def fixed_count(u: Column, k: int) -> Column:
    """Boolean array: the k cells of a row with the least draws (array u), whatever is observed."""
    drawn = F.transform(u, lambda x, i: F.struct(x.alias("u"), i.alias("i")))
    least = F.transform(F.slice(F.array_sort(drawn), 1, k), lambda x: x["i"])
    return F.transform(u, lambda x, i: F.array_contains(least, i))


def solve_intercept(scores: DataFrame, rate: float, passes: int = 7, ways: int = 32) -> float:
    """The b at which the mean of sigmoid(score + b) is `rate`; scores: score, not null.

    An empty table gives 0. Each pass weighs `ways` candidates in one aggregate over the table and keeps the interval
    between two neighbours, so that seven passes narrow 100 to below 1e-8.
    """
    scores = scores.select("score").persist()
    lo, hi = -50.0, 50.0
    for _ in range(passes):
        step = (hi - lo) / ways
        at = [lo + step * k for k in range(1, ways)]
        means = scores.agg(*(F.avg(1 / (1 + F.exp(-(F.col("score") + F.lit(b))))).alias(f"m{k}") for k, b in enumerate(at))).first()
        if means[0] is None:
            break
        below = sum(m < rate for m in means)
        lo, hi = lo + step * below, lo + step * (below + 1)
    scores.unpersist()
    return (lo + hi) / 2


def logistic_mask(panel: DataFrame, weights: list[float], masked: list[int], rate: float, u: Column, at_random: bool = True) -> DataFrame:
    """row_id, t of lost cells: the chance is a logistic function of the row's counts, `rate` on average.

    At random, only targets that aren't masked have weights (which the caller states by zeros
    elsewhere); otherwise a masked target may depend on itself. Scores are brought to unit variance.
    Rows that lack a count with a weight lose nothing. u: array of draws.
    """
    if not 0 < rate < 1:
        raise ValueError("rate must lie between 0 and 1")
    if at_random and any(weights[t] for t in masked):
        raise ValueError("a masked target has a weight")
    score = sum((F.lit(w) * F.get("c", F.lit(j)) for j, w in enumerate(weights) if w), F.lit(0.0))
    scored = panel.withColumn("score", score).where("score is not null")
    spread = scored.agg(F.stddev_pop("score").alias("s")).first()["s"] or 1.0
    scored = scored.withColumn("score", F.col("score") / F.lit(spread))
    b = solve_intercept(scored.select("score"), rate)
    chance = 1 / (1 + F.exp(-(F.col("score") + F.lit(b))))
    draws = F.transform(u, lambda x, i: F.struct(i.alias("t"), (x < chance).alias("gone")))
    return scored.select("row_id", F.explode(draws).alias("x")).where(F.col("x.gone") & F.col("x.t").isin(masked)).select("row_id", "x.t")


def anchored(c: Column, z: Column) -> Column:
    """Counts from predicted clr values z: softmax at the median log scale of the known positive counts.

    Known counts stay; a row without a positive one has scale 1.
    """
    p = co.softmax(z)
    logs = F.filter(F.zip_with(c, p, lambda v, q: F.when(v > 0, F.ln(v) - F.ln(q))), lambda x: x.isNotNull())
    scale = F.coalesce(co.median_of(logs), F.lit(0.0))
    return F.zip_with(c, p, lambda v, q: F.coalesce(v, F.exp(F.least(F.lit(700.0), F.ln(q) + scale))))


def scale_guard(rows: DataFrame, threshold: float = 1000.0) -> DataFrame:
    """One row: greatest and median ratio of filled sums to visible sums (or 1), rows over the threshold, rows without an anchor."""
    anchor = co.total(F.filter("c", lambda v: v.isNotNull()))
    ratios = rows.select(anchor.alias("anchor"), (co.total(F.col("filled")) / F.greatest(anchor, F.lit(1.0))).alias("ratio"))
    middle = quantiles(ratios, [], F.col("ratio")).select(F.col("quantile").alias("middle"))
    counts = ratios.agg(F.max("ratio").alias("most"), F.count_if(F.col("ratio") > threshold).alias("flagged"), F.count_if(F.col("anchor") == 0).alias("no_anchor"))
    return counts.join(F.broadcast(middle), F.lit(True), "left").select("most", "middle", "flagged", "no_anchor")


def implausible(rows: DataFrame, most: float = 10.0) -> DataFrame:
    """row_id, ratio of rows whose filled sum exceeds `most` times both the row total and the first filling's sum."""
    ratio = co.total(F.col("filled")) / F.greatest(F.col("n"), co.total(F.col("first")), F.lit(1.0))
    return rows.select("row_id", ratio.alias("ratio")).where(F.col("ratio") > most)


def pass_change(rows: DataFrame, before: str, after: str, missing: Column, d: int) -> DataFrame:
    """One row: covariance change of the clr images a part, mean change of missing parts, entropy, share of near zeros."""
    images = rows.select(co.clr(F.col(before)).alias("a"), co.clr(F.col(after)).alias("b"), missing.alias("m"), co.closure(F.col(after)).alias("p"))
    at = lambda side, i: F.get(side, F.lit(i))
    gaps = [F.pow(F.covar_samp(at("b", i), at("b", j)) - F.covar_samp(at("a", i), at("a", j)), F.lit(2.0)) for i in range(d) for j in range(d)]
    moved = co.total(F.transform(F.arrays_zip("a", "b", "m"), lambda x: F.when(x["m"], F.abs(x["b"] - x["a"])).otherwise(0.0)))
    gone = F.size(F.filter("m", lambda x: x))
    small = F.size(F.filter("p", lambda v: v < 1e-4))
    entropy = -co.total(F.transform("p", lambda v: v * F.ln(v)))
    return images.agg((F.sqrt(sum(gaps[1:], gaps[0])) / (d - 1)).alias("c1"), F.coalesce(F.sum(moved) / F.nullif(F.sum(gone), F.lit(0)), F.lit(0.0)).alias("c2"), F.avg(entropy).alias("entropy"), F.avg(small / F.lit(float(d))).alias("near_zero"))


def gates(scores: DataFrame, least_gain: float) -> DataFrame:
    """config, cells, rank_stat, qualified: does each config gain on its own start everywhere?

    scores: config, scenario, seed, m2, mae, start_m2, start_mae. A cell passes if m2 falls by more
    than the fraction least_gain and mae doesn't rise; a config qualifies if all its cells pass.
    rank_stat is the mean over scenarios of the mean over seeds, null if any m2 is.
    """
    gain = 1 - F.col("m2") / F.nullif(F.col("start_m2"), F.lit(0.0))
    passed = F.coalesce((gain > least_gain) & (F.col("mae") <= F.col("start_mae")), F.lit(False))
    per = scores.groupBy("config", "scenario").agg(F.count(F.lit(1)).alias("k"), F.count_if(passed).alias("good"), F.when(F.count("m2") == F.count(F.lit(1)), F.avg("m2")).alias("m2"))
    stat = F.when(F.count("m2") == F.count(F.lit(1)), F.avg("m2"))
    return per.groupBy("config").agg(F.sum("k").alias("cells"), stat.alias("rank_stat"), (F.sum("k") == F.sum("good")).alias("qualified"))


def finalists(gated: DataFrame, n: int = 3) -> DataFrame:
    """config, place of the n qualified configs with the least rank_stat."""
    order = Window.orderBy(F.round("rank_stat", 12), "config")
    return gated.where("qualified and rank_stat is not null").orderBy("rank_stat", "config").limit(n).select("config", F.row_number().over(order).alias("place"))


def point_errors(rows: DataFrame, truth: Column, filled: Column, hidden: Column) -> DataFrame:
    """One row: cells, mae and rmse over the hidden cells."""
    diff = F.when(hidden, filled - truth)
    return rows.agg(F.count(diff).alias("cells"), F.avg(F.abs(diff)).alias("mae"), F.sqrt(F.avg(diff * diff)).alias("rmse"))
