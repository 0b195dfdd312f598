"""Hard-negative mining as blocked dense matrix products, exact in float64.

Anchors are packed into blocks of at most BLOCK_BYTES as counted, one block in a broadcast at a time.
Against it every task multiplies its candidates in blocks of rows: whole numbers in float64, exact
while no sum can reach 2^53, which is checked by norms; rows past that are multiplied in Python's
integers. The first pass keeps the best positives of each anchor; blocks, tasks and Spark merge them,
since the best of bests are the best. The second pass multiplies again and keeps, for each anchor and
positive, the first negatives whose score lies in the positive's window. No pass shuffles vectors.

Defined results: rows without vec_id, label, vector, or with a null or non-finite component take no
part. Vectors are compared with vectors of their own length only; an empty one has score 0 with empty
ones. Rows that share a vec_id count as often as they occur, but are never each other's positive, and
of rows that share an anchor's vec_id the one with the least label and vector is the anchor. Equal scores go by
vec_id. Scores past 64 bits are given, and ordered, as the nearest long. Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import durable, release

#: Vectors of one block of anchors as float64.
BLOCK_BYTES = 16 << 20
#: Scores that a task holds at once.
BLOCK_SCORES = 1 << 21
LONG = np.iinfo(np.int64)


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def matrices(ids: np.ndarray, labels: np.ndarray, lists: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and floored vectors of a batch, a matrix for each length of vectors."""
    size, values = lists.value_lengths().to_numpy(zero_copy_only=False), np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
    starts = np.cumsum(size) - size
    for length in np.unique(size):
        mine = np.flatnonzero(size == length)
        yield ids[mine], labels[mine], values[starts[mine][:, None] + np.arange(length)]


class Anchors:
    """One block of anchors, a matrix for each length."""

    def __init__(self, table: pa.Table, scale: float) -> None:
        self.by_length = {}
        table = table.combine_chunks()
        lists = table.column("embedding").combine_chunks()
        for ids, labels, rows in matrices(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), lists, scale):
            self.by_length[rows.shape[1]] = (ids, labels, rows)
        self.size = table.num_rows


def scores(candidates: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products as int64, a row for each candidate."""
    reach = np.abs(anchors).sum(axis=1).max(initial=0) * np.abs(candidates).max(axis=1, initial=0)
    out = np.empty((len(candidates), len(anchors)), dtype=np.int64)
    exact = reach < 2.0**53
    out[exact] = candidates[exact] @ anchors.T
    for row in np.flatnonzero(~exact):
        numbers = [int(x) for x in candidates[row]]
        out[row] = [min(max(sum(x * int(y) for x, y in zip(numbers, other)), LONG.min + 1), LONG.max) for other in anchors]
    return out


class Best:
    """The k best (score, id) of each of many groups, in the order score down, id up."""

    def __init__(self, groups: int, k: int) -> None:
        self.k, self.least = k, np.full(groups, LONG.min, dtype=np.int64)
        self.group = self.score = self.ident = np.empty(0, dtype=np.int64)

    def offer(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ident = (np.concatenate(p) for p in ((self.group, group), (self.score, score), (self.ident, ident)))
        order = np.lexsort((ident, -score, group))
        group, score, ident = group[order], score[order], ident[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        full = nth == self.k - 1
        self.least[group[full]] = score[full]
        kept = nth < self.k
        self.group, self.score, self.ident = group[kept], score[kept], ident[kept]


def blocks(batches: Iterator[pa.RecordBatch], anchors: Anchors, scale: float) -> Iterator[tuple]:
    """length, candidate ids and labels, scores: what a task multiplies, in blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, max(64, BLOCK_SCORES // max(1, anchors.size))):
            part = batch.slice(at, max(64, BLOCK_SCORES // max(1, anchors.size)))
            for ids, labels, rows in matrices(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2), scale):
                if rows.shape[1] in anchors.by_length:
                    yield rows.shape[1], ids, labels, scores(rows, anchors.by_length[rows.shape[1]][2])


def positives(rows: DataFrame, block, k: int, scale: float) -> DataFrame:
    """anchor_id, nth, positive_id, positive_score: the k best other rows of the anchor's label."""

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {length: Best(len(ids), k) for length, (ids, _, _) in block.value.by_length.items()}
        for length, ids, labels, found in blocks(batches, block.value, scale):
            own, label, _ = block.value.by_length[length]
            fits = (labels[:, None] == label) & (ids[:, None] != own) & (found >= best[length].least)
            row, anchor = np.nonzero(fits)
            best[length].offer(anchor, found[row, anchor], ids[row])
        for length, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(block.value.by_length[length][0][b.group]), pa.array(b.ident), pa.array(b.score)], ["anchor_id", "positive_id", "positive_score"])

    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    each = rows.mapInArrow(best_of_task, "anchor_id long, positive_id long, positive_score long")
    return each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def negatives(rows: DataFrame, block, chosen, k: int, window: tuple[int, int], scale: float) -> DataFrame:
    """anchor_id, nth, rank, negative_id, negative_score: the k first rows of other labels in each positive's window."""

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, low, high, most = {}, {}, {}, 1 + max((nth for _, nth in chosen.value), default=0)
        for length, (ids, _, _) in block.value.by_length.items():
            best[length] = Best(len(ids) * most, k)
            low[length], high[length] = np.full((most, len(ids)), 1, dtype=np.int64), np.zeros((most, len(ids)), dtype=np.int64)
            for at, anchor in enumerate(ids.tolist()):
                for nth in range(most):
                    score = chosen.value.get((anchor, nth))
                    if score is not None:
                        low[length][nth, at], high[length][nth, at] = max(-(-window[0] * score // 100), LONG.min + 1), min(window[1] * score // 100, LONG.max)
        for length, ids, labels, found in blocks(batches, block.value, scale):
            size, other = len(block.value.by_length[length][0]), labels[:, None] != block.value.by_length[length][1]
            for nth in range(most):
                least = np.maximum(low[length][nth], best[length].least[nth * size : (nth + 1) * size])
                row, anchor = np.nonzero(other & (found >= least) & (found <= high[length][nth]))
                best[length].offer(anchor + nth * size, found[row, anchor], ids[row])
        for length, b in best.items():
            own = block.value.by_length[length][0]
            nth, anchor = np.divmod(b.group, max(1, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[anchor]), pa.array(nth.astype(np.int32)), pa.array(b.ident), pa.array(b.score)], ["anchor_id", "nth", "negative_id", "negative_score"])

    order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    each = rows.mapInArrow(best_of_task, "anchor_id long, nth int, negative_id long, negative_score long")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, n_positives: int = 5, n_negatives: int = 10, window: tuple[int, int] = (30, 90), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, label and embedding; anchor says which rows are anchors (vec_id divisible by
    100). A negative's score lies within window percent of its positive's.
    """
    spark, rows = vectors.sparkSession, whole(vectors)
    chosen_rows = rows.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor)
    own = chosen_rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")
    own = durable(own, "anchors")
    size = own.select(F.sum(8 * F.size("embedding") + 64)).first()[0] or 0
    n_blocks = max(1, -(-2 * size // BLOCK_BYTES))
    # On a hash, half full on average.
    numbered = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    every = None
    for number in range(n_blocks):
        block = spark.sparkContext.broadcast(Anchors(numbered.where(F.col("block") == number).drop("block").toArrow(), scale))
        near = durable(positives(rows, block, n_positives, scale), "positives")
        # At most n_positives rows for each anchor of the block.
        chosen = spark.sparkContext.broadcast({(r.anchor_id, r.nth): r.positive_score for r in near.select("anchor_id", "nth", "positive_score").collect()})
        found = negatives(rows, block, chosen, n_negatives, window, scale)
        done = durable(found.join(near, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        release(near)
        every = done if every is None else every.union(done)
    release(own)
    return every
