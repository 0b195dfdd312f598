"""Nearest compositions in a metric, with blocks that are skipped by the triangle inequality.

Two metrics on the parts that a query shows: Aitchison's (Euclidean between clr images) and the root of
the Jensen-Shannon divergence of the closed parts. Equal compositions are folded into one, with the
number of copies, on both sides. Donors are dealt into blocks around pivots: a donor belongs to the
pivot nearest on its known parts, a full pivot's donors are cut into rings of distance. For each
pattern of shown parts and each block one pass notes the least and greatest distance to every pivot
and how many donors have each part. From that table a query has, for each block, a lower bound of all
its distances there, and an upper bound of its k-th distance over all blocks; blocks whose lower bound is
above it are never visited. The rest is joined by block, and both sides of a task are bounded.

The table has a row a block and pattern. It is shipped to the tasks while it has at most TABLE_BYTES; a
query whose pattern was left out of it (more than PATTERNS of them) visits every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.shipping import ship

#: Donors of a block, queries of a task, pivots, numbers that a task holds at once.
DONOR_ROWS, QUERY_ROWS, PIVOTS, CELLS = 50_000, 50_000, 64, 1 << 21
#: Patterns of the table of bounds, and its bytes.
PATTERNS, TABLE_BYTES = 1024, 64 << 20
#: Relative tolerance within which distances tie, and the room left for rounding when blocks are skipped.
TIE, ROOM = 1e-12, 1e-9


def stack(rows: pd.Series) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(rows), -1)


def image(x: np.ndarray, kind: str) -> np.ndarray:
    """What distances are taken of: clr images, or closed parts."""
    if kind == "aitchison":
        logs = np.log(x)
        return logs - logs.mean(axis=1, keepdims=True)
    return x / x.sum(axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """The measure by which donors are ranked, a row for each of a: Aitchison's distance, or the divergence itself."""
    if kind == "aitchison":
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    x, y = a[:, None, :], b[None, :, :]
    m = (x + y) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(x > 0, x * np.log(x / m), 0.0) + np.where(y > 0, y * np.log(y / m), 0.0)
    return np.maximum(parts.sum(axis=2), 0.0)


def metric(d: np.ndarray, kind: str) -> np.ndarray:
    """The measure as a metric, for which the triangle inequality holds."""
    return d if kind == "aitchison" else np.sqrt(d)


def usable(x: np.ndarray, shown: np.ndarray, kind: str) -> np.ndarray:
    """Rows that have all shown parts, and mass there."""
    has = ~np.isnan(x[:, shown]).any(axis=1)
    return has & (np.nansum(x[:, shown], axis=1) > 0) if kind != "aitchison" else has


def patterns_of(x: np.ndarray) -> np.ndarray:
    return ~np.isnan(x)


def text(shown: np.ndarray) -> str:
    return "".join("1" if s else "0" for s in shown)


def folded(rows: DataFrame, apart: bool, k: int, label: str | None = None) -> DataFrame:
    """Equal compositions as one: donor (least id), x, e, label, copies, ids (the k least ids).

    With apart only those of one entity are folded, and never those of different labels. Members of a group are counted before they are
    shuffled, and its ids are cut to k at once, so that a common composition is a row like any other.
    """
    keys = ["x", *["e"] * apart, *[label] * (label is not None)]
    # The k least of each of many partial groups first: a hot composition never gathers all its ids.
    part = rows.groupBy(*keys, F.pmod(F.xxhash64("row_id"), F.lit(512)).alias("_part"))
    few = part.agg(F.slice(F.sort_array(F.collect_list("row_id")), 1, k).alias("ids"), F.count(F.lit(1)).alias("copies"))
    whole = few.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"), F.sum("copies").alias("copies"))
    return whole.select(F.col("ids")[0].alias("donor"), "x", (F.col("e") if apart else F.lit(None).cast("long")).alias("e"), (F.col(label) if label else F.lit("")).alias("label"), "copies", "ids")


class Index:
    """Donors (donor, x, e, label, copies, ids) in blocks, with the bounds of each block."""

    def __init__(self, donors: DataFrame, queries: DataFrame, kind: str, parts: int, donor_rows: int) -> None:
        self.kind, self.parts = kind, parts
        n = donors.count()
        self.pivots = np.full((1, parts), 1.0 / parts)
        if n > donor_rows:
            # Whole compositions by the hash of their number; the balanced one stands in where there are none.
            whole = donors.where(F.forall("x", lambda v: v.isNotNull() & (v > 0))).orderBy(F.xxhash64("donor")).limit(min(PIVOTS, -(-n // donor_rows))).select("x").collect()
            self.pivots = np.vstack([self.pivots, *(np.array([r.x]) for r in whole)])
        self.donors = self._dealt(donors, n, donor_rows)
        self.bounds: dict[str, tuple] = {}
        self.blocks = [0]
        if n > donor_rows:
            self._note_bounds(queries)

    def _dealt(self, donors: DataFrame, n: int, donor_rows: int) -> DataFrame:
        if n <= donor_rows:
            return donors.withColumn("block", F.lit(0))
        pivots, kind = self.pivots, self.kind

        def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = stack(frame["x"])
                cell, away = np.zeros(len(x), dtype=int), np.zeros(len(x))
                for shown in np.unique(patterns_of(x), axis=0):
                    rows = np.flatnonzero((patterns_of(x) == shown).all(axis=1) & usable(x, shown, kind)) if shown.any() else []
                    for at in range(0, len(rows), max(1, CELLS // (len(pivots) * len(shown)))):
                        some = rows[at : at + max(1, CELLS // (len(pivots) * len(shown)))]
                        d = distances(image(x[some][:, shown], kind), image(pivots[:, shown], kind), kind)
                        cell[some], away[some] = d.argmin(axis=1), d.min(axis=1)
                yield frame.assign(cell=cell.astype(np.int32), away=away)

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in donors.schema)
        near = donors.mapInPandas(nearest, fields + ", cell int, away double")
        # Rings of about donor_rows: bounds of distance from a sketch, which only decides who shares a block.
        most = -(-n // donor_rows)
        shares = F.array(*(F.lit(i / most) for i in range(1, most))) if most > 1 else None
        cells = near.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("away", shares, 1000).alias("cut"))
        rings = F.least(F.lit(most), F.ceil(F.col("rows") / donor_rows))
        ring = F.size(F.filter(F.sequence(F.lit(1), rings - 1), lambda i: F.col("away") > F.element_at("cut", F.least(F.lit(most - 1), F.greatest(F.lit(1), F.floor(i * most / rings).cast("int"))))))
        placed = near.join(F.broadcast(cells), "cell").withColumn("block", (F.col("cell") * most + F.when(rings > 1, ring).otherwise(0)).cast("int"))
        return placed.drop("cell", "away", "rows", "cut")

    def _note_bounds(self, queries: DataFrame) -> None:
        kind, pivots = self.kind, self.pivots
        shown = F.transform("x", lambda v: F.when(v.isNull(), "0").otherwise("1"))
        kept = [np.array([c == "1" for c in r.p]) for r in queries.groupBy(F.array_join(shown, "").alias("p")).count().orderBy(F.desc("count"), "p").limit(PATTERNS).collect()]

        def note(frame: pd.DataFrame) -> pd.DataFrame:
            out, x, e, copies = [], stack(frame["x"]), frame["e"].to_numpy(), frame["copies"].to_numpy()
            labels = frame["label"].to_numpy().astype(str)
            for pattern in kept:
                rows = np.flatnonzero(usable(x, pattern, kind)) if pattern.any() else []
                if not len(rows):
                    continue
                low, high = np.full(len(pivots), np.inf), np.zeros(len(pivots))
                to = image(pivots[:, pattern], kind)
                for at in range(0, len(rows), max(1, CELLS // (len(pivots) * len(pattern)))):
                    d = metric(distances(image(x[rows[at : at + max(1, CELLS // (len(pivots) * len(pattern)))]][:, pattern], kind), to, kind), kind)
                    low, high = np.minimum(low, d.min(axis=0)), np.maximum(high, d.max(axis=0))
                counts = {}
                for label in np.unique(labels[rows]):
                    mine = rows[labels[rows] == label]
                    has = ~np.isnan(x[mine])
                    count = (has * copies[mine, None]).sum(axis=0)
                    if not pd.isnull(e).any():
                        # Whichever entity may not give donors, so many are left at least.
                        _, who = np.unique(e[mine], return_inverse=True)
                        count = count - np.array([np.bincount(who, has[:, j] * copies[mine]).max() for j in range(x.shape[1])]).astype(count.dtype)
                    counts[label] = count.astype(np.int64)
                out.append((int(frame["block"].iloc[0]), text(pattern), low, high, list(counts), list(counts.values())))
            return pd.DataFrame(out, columns=["block", "pattern", "low", "high", "labels", "parts"])

        noted = self.donors.groupBy("block").applyInPandas(note, "block int, pattern string, low array<double>, high array<double>, labels array<string>, parts array<array<long>>")
        self.blocks = sorted(r.block for r in self.donors.select("block").distinct().collect())
        if len(self.blocks) * len(kept) * (16 * len(pivots) + 8 * self.parts) > TABLE_BYTES:
            return
        for r in noted.collect():
            self.bounds.setdefault(r.pattern, []).append(r)
        for pattern, rows in self.bounds.items():
            counts = {label: np.zeros((len(rows), self.parts), dtype=np.int64) for r in rows for label in r.labels}
            for i, r in enumerate(rows):
                for label, count in zip(r.labels, r.parts):
                    counts[label][i] = count
            self.bounds[pattern] = (np.array([r.block for r in rows]), np.array([r.low for r in rows]), np.array([r.high for r in rows]), list(counts.values()))
        self.kept = {text(p) for p in kept}

    def routed(self, queries: DataFrame, k: int, each_part: bool) -> DataFrame:
        """queries (query, x, e) with block: the blocks that can hold one of the k nearest.

        With each_part these are the k nearest that have a part, for any part that the query lacks; in
        either case the k nearest of each label.
        """
        if not self.bounds:
            return queries.withColumn("block", F.explode(F.array(*map(F.lit, self.blocks))))
        pivots, kind, bounds, kept, blocks = self.pivots, self.kind, self.bounds, self.kept, self.blocks

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = stack(frame["x"])
                row, where = [np.empty(0, int)], [np.empty(0, int)]
                for shown in np.unique(patterns_of(x), axis=0):
                    mine = np.flatnonzero((patterns_of(x) == shown).all(axis=1))
                    if text(shown) not in kept:
                        row.append(np.repeat(mine, len(blocks))), where.append(np.tile(blocks, len(mine)))
                        continue
                    if text(shown) not in bounds or not shown.any():
                        continue
                    mine = mine[usable(x[mine], shown, kind)]
                    ids, low, high, counts = bounds[text(shown)]
                    step = max(1, CELLS // low.size)
                    for at in range(0, len(mine), step):
                        some = mine[at : at + step]
                        d = metric(distances(image(x[some][:, shown], kind), image(pivots[:, shown], kind), kind), kind)
                        least = np.maximum(np.maximum(d[:, None, :] - high, low - d[:, None, :]).max(axis=2), 0.0)
                        most = (d[:, None, :] + high).min(axis=2)
                        order = np.argsort(most, axis=1, kind="stable")
                        limit = np.zeros(len(some))
                        # Over any part that is asked for: from the blocks nearest at most, until k donors are sure.
                        for count, part in [(c, p) for c in counts for p in (np.flatnonzero(~shown) if each_part else [-1])]:
                            sure = np.cumsum((count[:, part] if each_part else count.min(axis=1))[order], axis=1)
                            reached = np.argmax(sure >= k, axis=1)
                            kth = np.where(sure[:, -1] >= k, np.take_along_axis(most, np.take_along_axis(order, reached[:, None], 1), 1)[:, 0], np.inf)
                            limit = np.maximum(limit, kth)
                        r, b = np.nonzero(least <= limit[:, None] * (1 + ROOM) + ROOM)
                        row.append(some[r]), where.append(ids[b])
                out = frame.iloc[np.concatenate(row)].copy()
                out["block"] = np.concatenate(where).astype(np.int32)
                yield out

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        return queries.mapInPandas(route, fields + ", block int")


def closest(queries: DataFrame, donors: DataFrame, kind: str, k: int, ties: str, parts: int, each_part: bool, exclude: bool = False, adjust: str | None = None, donor_rows: int | None = None, index: list | None = None) -> DataFrame:
    """query, t, label, donor, d, copies, ids, x, value: of each query the nearest folded donors of each label in each visited block.

    queries: query, x, e; donors: as folded() gives them. With each_part a list for every part t that the
    query lacks, of donors that have it; else one list (t = -1). With ties "group" all that tie with the k-th
    stay, else the k first by (distance to 12 digits, donor). With exclude no donor of the query's e.
    With adjust ("median" or "sum") value is the donor's part t at the query's scale on the shown parts, else
    null. An empty list passed as index is given the index, for what it skips.
    """
    ship(queries.sparkSession)
    # Fresh names: both sides may come from one panel.
    queries, donors = (side.select(*(F.col(c).alias(c) for c in side.columns)) for side in (queries, donors))
    made = Index(donors, queries, kind, parts, donor_rows or DONOR_ROWS)
    if index is not None:
        index.append(made)
    routed = made.routed(queries, k, each_part)
    if made.bounds:
        visits = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("tasks"))
        routed, held = routed.join(F.broadcast(visits), "block"), made.donors.join(F.broadcast(visits), "block")
    else:
        tasks = max(1, -(-queries.count() // QUERY_ROWS))
        routed, held = routed.withColumn("tasks", F.lit(tasks)), made.donors.withColumn("tasks", F.lit(tasks))
    spread = routed.withColumn("task", F.pmod(F.xxhash64("query"), F.col("tasks")).cast("int")).drop("tasks")
    held = held.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")

    def work(key, asked: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        found = {name: [] for name in ("query", "t", "row", "d", "value")}
        middle = np.median if adjust == "median" else np.sum
        if len(asked) and len(have):
            y, ids, home = stack(have["x"]), have["donor"].to_numpy(), have["e"].to_numpy()
            x, names, own = stack(asked["x"]), asked["query"].to_numpy(), asked["e"].to_numpy()
            seen, labels = ~np.isnan(y), have["label"].to_numpy()
            kinds = [(label, labels == label) for label in np.unique(labels)]
            for shown in np.unique(patterns_of(x), axis=0):
                rows = np.flatnonzero((patterns_of(x) == shown).all(axis=1) & usable(x, shown, kind)) if shown.any() else []
                fit = np.flatnonzero(usable(y, shown, kind))
                if not len(rows) or not len(fit):
                    continue
                to, step = image(y[fit][:, shown], kind), max(1, CELLS // (len(fit) * int(shown.sum())))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    d = distances(image(x[some][:, shown], kind), to, kind)
                    for t, label in [(t, label) for t in (np.flatnonzero(~shown) if each_part else [-1]) for label in kinds]:
                        mine = d if t < 0 else np.where(seen[fit, t], d, np.inf)
                        if len(kinds) > 1:
                            mine = np.where(label[1][fit], mine, np.inf)
                        if exclude:
                            mine = np.where(home[fit] == own[some][:, None], np.inf, mine)
                        limit = np.partition(mine, k - 1, axis=1)[:, k - 1] if len(fit) > k else np.full(len(some), np.inf)
                        room = np.where(np.isfinite(limit), limit + 2 * TIE * np.maximum(1.0, np.abs(np.where(np.isfinite(limit), limit, 0.0))), np.inf)
                        r, c = np.nonzero((mine <= room[:, None]) & np.isfinite(mine))
                        away = mine[r, c]
                        if ties != "group":
                            order = np.lexsort((ids[fit[c]], np.round(away, 12), r))
                            r, c, away = r[order], c[order], away[order]
                            starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.empty(0, int)
                            nth = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
                            r, c, away = r[nth < k], c[nth < k], away[nth < k]
                        value = np.full(len(r), np.nan)
                        if adjust:
                            value = y[fit[c], t] / middle(y[fit][:, shown], axis=1)[c] * middle(x[some][:, shown], axis=1)[r]
                        found["value"].append(value), found["query"].append(names[some[r]]), found["t"].append(np.full(len(r), t)), found["row"].append(fit[c]), found["d"].append(away)
        joined = {name: np.concatenate(parts) if parts else np.empty(0) for name, parts in found.items()}
        chosen = have.iloc[joined["row"].astype(int)]
        return pd.DataFrame({"query": joined["query"].astype(np.int64), "t": joined["t"].astype(np.int32), "label": chosen["label"].to_numpy(), "donor": chosen["donor"].to_numpy(), "d": joined["d"], "copies": chosen["copies"].to_numpy(), "ids": chosen["ids"].to_numpy(), "x": chosen["x"].to_numpy(), "value": joined["value"].astype(float)})

    return spread.groupBy("block", "task").cogroup(held.groupBy("block", "task")).applyInPandas(work, "query long, t int, label string, donor long, d double, copies long, ids array<long>, x array<double>, value double")
