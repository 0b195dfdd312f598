"""Imputers: each adds p, the proposed share of every target, to a panel of visible counts.

They see nothing but the visible panel: hidden truths are nulls before they get here. `by` names
columns (a seed, say) whose values are panels of their own: all of them are imputed in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import POOL, uniform
from tallyloom.panel import cells, targets

#: Rows of a pool that one window numbers.
POOL_RANGE = 1 << 16


def zero_fill(panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return panel.withColumn("p", F.transform("c", lambda v: F.lit(0.0)))


def target_means(panel: DataFrame, d: int, by: tuple[str, ...] = ()) -> DataFrame:
    """p, the unweighted mean of c / n by target (null for a target never seen): one row a panel."""
    return panel.groupBy(*by).agg(F.array(*(F.avg(F.get("c", F.lit(k)) / F.col("n")) for k in range(d))).cast("array<double>").alias("p"))


def mean_fill(panel: DataFrame, d: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """d: the number of targets, looked up if None. A target that was never observed is an error when the plan runs."""
    unseen = lambda i: F.raise_error(F.concat(F.lit("no observed value of target "), i.cast("string"))).cast("double")
    means = target_means(panel, targets(panel) if d is None else d, by)
    means = F.broadcast(means.withColumn("p", F.transform("p", lambda v, i: F.coalesce(v, unseen(i)))))
    return panel.join(means, list(by)) if by else panel.join(means)


def pool(seen: DataFrame) -> DataFrame:
    """seen with place: its number from 0 among the rows of its target by row_id.

    Numbered within ranges of row_id, the ranges placed by their counts: no task holds a target.
    """
    ranged = seen.withColumn("range", F.floor(F.col("row_id") / POOL_RANGE))
    counts = ranged.groupBy("t", "range").agg(F.count(F.lit(1)).alias("k"))
    starts = counts.select("t", "range", (F.sum("k").over(Window.partitionBy("t").orderBy("range")) - F.col("k")).alias("start"))
    number = F.row_number().over(Window.partitionBy("t", "range").orderBy("row_id")) - 1
    return ranged.withColumn("number", number).join(starts, ["t", "range"]).withColumn("place", F.col("start") + F.col("number")).drop("range", "number", "start")


def marginal_draws(panel: DataFrame, seed: int = 0) -> DataFrame:
    """row_id, t, p of every missing cell: one observed share of its target, drawn evenly."""
    long = cells(panel)
    seen = pool(long.where("c is not null").select("row_id", "t", (F.col("c") / F.col("n")).alias("p")))
    sizes = seen.groupBy("t").agg(F.count(F.lit(1)).alias("len"))
    u = uniform(F.col("e"), F.col("days"), F.col("t"), POOL + seed)
    asked = long.where("c is null").join(F.broadcast(sizes), "t").select("row_id", "t", F.least(F.floor(u * F.col("len")), F.col("len") - 1).alias("place"))
    return asked.join(seen.select("t", "place", "p"), ["t", "place"]).select("row_id", "t", "p")


def with_proposals(panel: DataFrame, proposed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The panel with p from rows row_id, t, p; null where nothing is proposed."""
    by_row = proposed.groupBy("row_id", *by).agg(F.map_from_entries(F.collect_list(F.struct("t", "p"))).alias("by_t"))
    joined = panel.join(by_row, ["row_id", *by], "left")
    return joined.withColumn("p", F.transform("c", lambda v, i: F.when(F.col("by_t").isNotNull(), F.element_at("by_t", i)))).drop("by_t")


def marginal_sampler(panel: DataFrame, seed: int = 0) -> DataFrame:
    """One panel only."""
    return with_proposals(panel, marginal_draws(panel, seed))


#: Sums of whole counts are exact in a double while the totals of a table stay below this.
MAX_TOTALS = 2.0**53


def half_widths(kind: str | None, window_days: int, max_widen: int) -> list:
    """Half-widths of the windows by kind of time: doubling days, neighbouring numbers, the same label, no bound."""
    if kind == "date":
        return [window_days << level for level in range(max_widen + 1)]
    if kind == "numeric":
        return [0] + [1 << level for level in range(max_widen)]
    if kind == "label":
        return [0]
    if kind is None:
        return [None]
    raise ValueError(f"unknown kind of time {kind!r}")


def same_day(panel: DataFrame, window_days: int = 28, min_obs: int = 20, max_widen: int = 2, exclude_own: bool = False, use_time: bool = True, use_group: bool = True, weighting: str = "n", by: tuple[str, ...] = (), kind: str = "date") -> DataFrame:
    """row_id, t, k, level, p of every missing cell: the mean share near its day in its group.

    Dates have windows of window_days * 2^level days on both sides, numbers 0, 1, 2, 4 and so on, labels
    only themselves; the first with min_obs observed cells decides, else (the level after the last) all
    cells of the target. Cells of the own entity may be left out. weighting n: sum of counts over sum
    of totals; equal: mean of the shares. Cells are folded by target, group and day before any window,
    so a window's rows are days, however many cells.

    The plan fails when it runs if the totals add up to over MAX_TOTALS, or if a cell's sums are no
    numbers or weigh nothing, as for a target without any usable cell: there is no silent 0.
    """
    if min(window_days, max_widen) < 0 or min_obs < 1 or weighting not in ("n", "equal"):
        raise ValueError("windows must not be negative, min_obs must be at least 1, weighting n or equal")
    long = cells(panel, by=by).withColumn("g", F.col("grp") if use_group else F.lit(""))
    num, den = (F.col("c"), F.when(F.col("c").isNotNull(), F.col("n"))) if weighting == "n" else (F.col("c") / F.col("n"), F.when(F.col("c").isNotNull(), 1.0))
    sums = [F.count("c").alias("k"), F.coalesce(F.sum(num), F.lit(0.0)).alias("a"), F.coalesce(F.sum(den), F.lit(0.0)).alias("b")]
    frames = half_widths(kind if use_time else None, window_days, max_widen)

    def near(key: list[str], tag: str) -> DataFrame:
        daily = long.groupBy(*key, "days").agg(*sums)
        order = Window.partitionBy(*key)
        picked = []
        for level, w in enumerate(frames):
            frame = order.orderBy("days").rangeBetween(-w, w) if w is not None else order
            picked += [F.sum(x).over(frame).alias(f"{tag}{x}{level}") for x in "kab"]
        return daily.select(*key, "days", *picked)

    asked = long.where("c is null").select("row_id", "e", "t", "g", "days", *by)
    found = asked.join(near([*by, "t", "g"], "w"), [*by, "t", "g", "days"])
    every = long.groupBy(*by, "t").agg(*sums, F.sum("n").alias("n")).select(*by, "t", F.col("n").alias("totals"), *(F.col(x).alias(f"w{x}_all") for x in "kab"))
    found = found.join(F.broadcast(every), [*by, "t"])
    if exclude_own:
        found = found.join(near([*by, "t", "g", "e"], "o"), [*by, "t", "g", "e", "days"])
        own = long.groupBy(*by, "t", "e").agg(*sums).select(*by, "t", "e", *(F.col(x).alias(f"o{x}_all") for x in "kab"))
        found = found.join(own, [*by, "t", "e"])
    value = lambda x, at: F.col(f"w{x}{at}") - (F.col(f"o{x}{at}") if exclude_own else 0)
    level: Column = F.lit(len(frames))
    k: Column = value("k", "_all")
    a: Column = value("a", "_all")
    b: Column = value("b", "_all")
    for at in reversed(range(len(frames))):
        enough = value("k", at) >= min_obs
        level = F.when(enough, at).otherwise(level)
        k = F.when(enough, value("k", at)).otherwise(k)
        a, b = F.when(enough, value("a", at)).otherwise(a), F.when(enough, value("b", at)).otherwise(b)
    finite = lambda x: F.abs(x) < float("inf")
    p = (
        F.when(~(F.col("totals") <= MAX_TOTALS), F.raise_error(F.lit("the row totals add up to more than 2^53")).cast("double"))
        .when(F.coalesce(finite(a) & finite(b) & (b > 0), F.lit(False)), F.least(F.greatest(a / b, F.lit(0.0)), F.lit(1.0)))
        .otherwise(F.raise_error(F.concat(F.lit("no usable cell for target "), F.col("t"), F.lit(" of row "), F.col("row_id"))).cast("double"))
    )
    return found.select(*by, "row_id", "t", k.alias("k"), level.cast("int").alias("level"), p.alias("p"))


def same_day_mean(panel: DataFrame, by: tuple[str, ...] = (), **options) -> DataFrame:
    return with_proposals(panel, same_day(panel, by=by, **options), by)


MODELS = {"zero_fill": zero_fill, "mean_fill": mean_fill, "marginal_sampler": marginal_sampler, "same_day_mean": same_day_mean}
