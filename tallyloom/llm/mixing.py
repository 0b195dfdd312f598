"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a word budget. Whole copies of the source are taken while they fit; what remains
of the budget is fitted exactly, not by drawing until it is spent: documents are counted by their
exact length, each length gives its share of the remainder rounded down, the largest lengths that
still fit are topped up, and a bounded-knapsack dynamic program over the counts, which may take back
some of the shares and look on both sides of the budget, ends as near to it as any subset of the
documents can. A seeded hash then says which documents of a length are meant, so reruns agree.
Lengths and counts are all that the fit sees; texts are read once, for their sizes.

A length that a third of all rows share is ranked without gathering it: rows of a (source, length)
pair are cut into about sqrt(n) hash ranges, the ranges are counted, and only the range in which
the wanted number falls is ranked row by row.

Defined cases: null text has size 0 and, like an empty one, is never taken (taken = 0). Sources
are ordered by code point, the null source last. A source of no words has target 0. Repeated doc_id
rows rank by size and id only and so are each a document of their own, told apart by nothing: if
the cut falls between such rows, either may go. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import durable, unused, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often.
MAX_REPEATS = 3
#: Words that the dynamic program takes back at first; eight times more while the sum isn't the nearest possible.
DP_WORDS = 32_768
SEED = 7


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text) of every row."""
    return docs.select("doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"))


def source_targets(by_source: DataFrame, cycle: int = 3, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> with target.

    Weights 1..cycle repeat over the sources in code-point order, null last. Together the targets
    are the sum of all sizes. A target stops at max_repeats times its source; the excess is shared
    again by weight. That is one water level t with sum(min(w*t, cap)) = total: sources are
    ordered by cap/w, and running sums give the first prefix of full sources after which the rest
    stays under its caps. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    ranked = by_source.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double")).withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("all_words", F.sum("source_size").over(total).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The level of the first source that is not filled to its cap holds for all that follow.
    stops = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    at = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("x"), F.col("level").alias("level")))).over(total)["level"]
    return stops.select("source", "source_size", F.when(at.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), at * F.col("weight"))).alias("target"))


def fit_counts(lengths: list[int], counts: list[int], budget: int, window: int = DP_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come nearest to budget.

    0 <= result[i] <= counts[i]; of two sums as near the smaller. Proportional shares first, then the
    largest lengths that fit until less than `window` words are open. A bounded knapsack then takes
    back documents of `window` words, shortest first, and fills the gap anew. It ends when the sum is
    the nearest multiple of the lengths' common divisor, or when so many documents were free to go
    that more can't help: changes that lead from one sum to another can be ordered so that what they
    add up to stays within a longest document of the way, and changes between two equal sums cancel.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total or budget <= 0:
        return list(counts) if budget > 0 else [0] * len(lengths)
    used = [i for i, (n, c) in enumerate(zip(lengths, counts, strict=True)) if n > 0 and c > 0]
    unit = math.gcd(*(lengths[i] for i in used))
    take = [c * budget // total if n > 0 else 0 for n, c in zip(lengths, counts, strict=True)]
    gap = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(used, key=lambda i: -lengths[i])
    for i in order:
        if gap < window:
            break
        more = min(counts[i] - take[i], (gap - window) // lengths[i] + 1, gap // lengths[i])
        if more > 0:
            take[i] += more
            gap -= more * lengths[i]
    enough = gap + 2 * lengths[order[0]] + 2  # documents of a length that a best change takes or gives at most
    nearest = min(budget % unit, -budget % unit)
    while True:
        base, freed = list(take), 0
        for i in reversed(order):
            back = min(take[i], enough, (window - freed) // lengths[i])
            base[i] -= back
            freed += back * lengths[i]
        last = all(base[i] == max(0, take[i] - enough) for i in order)
        result, reached = _knapsack(lengths, [min(counts[i] - base[i], take[i] - base[i] + enough) for i in range(len(lengths))], gap + freed, order)
        if last or abs(reached - gap - freed) <= nearest:
            return [b + r for b, r in zip(base, result, strict=True)]
        window *= 8


def _knapsack(lengths: list[int], counts: list[int], gap: int, order: list[int]) -> tuple[list[int], int]:
    """Documents of each length whose words come nearest to gap, and their words."""
    # Word sums are the bits of an integer; counts split into powers of two.
    mask, reach, steps = (1 << gap + lengths[order[0]] + 1) - 1, 1, []
    for i in order:
        left, piece = min(counts[i], gap // lengths[i] + 1), 1
        while left > 0 and not reach >> gap & 1:
            piece = min(piece, left)
            grown = reach | reach << piece * lengths[i] & mask
            if grown != reach:
                steps.append((i, piece, reach))
                reach = grown
            left -= piece
            piece *= 2
    below = (reach & (1 << gap + 1) - 1).bit_length() - 1
    above = reach >> gap
    over = (above & -above).bit_length() - 1 if above else gap + 1
    at = words = below if gap - below <= over else gap + over
    out = [0] * len(lengths)
    for i, piece, earlier in reversed(steps):
        if not earlier >> at & 1:
            out[i] += piece
            at -= piece * lengths[i]
    return out, words


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    copies = int(target // size) if size else 0
    group["copies"] = copies
    group["extra"] = fit_counts(group["size"].astype(int).tolist(), group["n"].astype(int).tolist(), round(target - copies * size))
    return group[["source", "size", "n", "source_size", "target", "copies", "extra"]]


def mix(docs: DataFrame, cycle: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) of every row."""
    sizes = durable(sized(docs), "mix-sizes")
    by_length = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cycle)
    counted = by_length.alias("l").join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("l.source", "l.size", "l.n", "t.source_size", "t.target")
    plan = durable(counted.groupBy("source").applyInPandas(_fit, "source string, size long, n long, source_size long, target double, copies long, extra long"), "mix-plan")

    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 40)) / float(1 << 40)
    left, right = sizes.alias("s"), plan.alias("p")
    rows = left.join(right, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size"))).select("s.doc_id", "s.source", "s.size", "p.n", "p.source_size", "p.target", "p.copies", "p.extra")
    # Only lengths of which some but not all documents are taken need a ranking.
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    rows = rows.withColumn("u", share).withColumn("range", F.when(cut, F.floor(F.col("u") * F.ceil(F.sqrt("n")))))
    counts = rows.where("range is not null").groupBy("source", "size", "range", "extra").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("source", "size").orderBy("range")
    marked = counts.withColumn("before", F.sum("rows").over(upto) - F.col("rows")).where(F.col("before") < F.col("extra"))
    marked = marked.select("source", "size", "range", (F.col("extra") - F.col("before")).alias("want"), (F.col("extra") - F.col("before") >= F.col("rows")).alias("whole"))
    r, m = rows.alias("r"), marked.alias("m")
    joined = r.join(m, F.col("r.source").eqNullSafe(F.col("m.source")) & (F.col("r.size") == F.col("m.size")) & (F.col("r.range") == F.col("m.range")), "left").select("r.*", "m.want", "m.whole")
    easy = joined.where(F.col("range").isNull() | F.col("want").isNull() | F.col("whole")).withColumn("picked", F.when(F.col("range").isNull(), F.col("extra") > 0).otherwise(F.coalesce(F.col("whole"), F.lit(False))))
    edge = joined.where("range is not null and want is not null and not whole")
    edge = edge.withColumn("picked", F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("u", "doc_id")) <= F.col("want"))
    return easy.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("copies") + F.col("picked").cast("long"))).alias("taken"))


def mixed(docs: DataFrame, cycle: int = 3, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Rows that agree in doc_id, source and size are taken equally often: as often as any of them.
    """
    taken = mix(docs, cycle, seed).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("times"))
    size, time = unused(docs, "_size"), unused(docs, "_time")
    rows = docs.withColumn(size, F.regexp_count(whole_text(), F.lit(WORD)).cast("long")).alias("d")
    t = taken.alias("t")
    joined = rows.join(t, F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col(f"d.{size}") == F.col("t.size")))
    return joined.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("t.times"))).alias(time)).drop(time)
