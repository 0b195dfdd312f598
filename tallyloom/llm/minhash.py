"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is its set of word shingles, a shingle one 64-bit hash; the sketch is the SKETCH smallest
of them. The steps:

1. Documents with equal sets become one node (the smallest doc_id), however many there are.
2. Inverted lists over the HEAD smallest retained values of each node. A pair at the threshold
   shares at least `overlap()` of them, so it suffices to list a node under its rarest
   HEAD - overlap + 1 values (prefix filter): common boilerplate never becomes a list key unless
   half the sketch is boilerplate. Values that one node alone has make no list.
3. Lists are compared in tasks of bounded size. A long list is cut into blocks that share a few
   representatives; what these leave unconnected meets in a second wave (module lists). Sets no
   larger than a sketch are compared whole. Larger sets pass the union-sketch estimate (shared
   values over all values up to the smaller sketch's end) with a margin of five standard deviations
   below the threshold. Links leave a task as a spanning forest, not as all pairs; only estimates
   within the margin of the threshold leave as pairs, and only between trees.
4. What passed is compared on full sets: the exact Jaccard test decides.
5. Components by minimum label.

Links between different sets are found up to the sketch's chance of error (below 1e-5 a pair at the
threshold, less above it); nothing is capped. A group of near copies is compared within blocks and
with its representatives; members that are linked with neither meet all others of their lists.

Defined cases: null text counts as empty; a document without words has an empty set, is linked with
nothing and is its own component. With fewer words than a shingle the whole sequence is the one
shingle. A null doc_id can't be reached: its component is null and it is kept. Rows that share
doc_id and text share their result; where different texts carry one doc_id each row has the
component of its own text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import durable, release, rows_of, slices, whole_text
from tallyloom.llm.components import components
from tallyloom.llm.lists import first_wave, second_wave, with_blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SKETCH = 256
HEAD = 16
#: Members of a list in a block; longer lists have several.
BLOCK = 256
#: The same in the second wave, where members meet several blocks.
LATE_BLOCK = 1024
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000
DEVIATIONS = 5.0


class WordHashes(dict):
    """word -> 64-bit hash of the word with A-Z lowered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        low = word.lower() if word.isascii() else re.sub("[A-Z]+", lambda m: m.group().lower(), word)
        value = self[word] = xxhash.xxh3_64_intdigest(low)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (fixed public constants of the SplitMix generator)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_hashes(words: list[str], size: int, memo: WordHashes) -> np.ndarray:
    """Hash of the shingle at each place; of the whole sequence where it is shorter; int64."""
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return shingles_of(h, min(size, len(words))).view(np.int64)


def shingles_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` successive word hashes at each place; uint64."""
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def shingle_set(text: str, size: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(WORD.findall(text), size, memo))


def overlap(n: int, percent: int) -> int:
    """Values that the heads of sets at the threshold share at least, the smaller set having n."""
    t = percent / 100
    if n >= HEAD:
        return max(1, math.floor(HEAD * t - 5.2 * math.sqrt(HEAD * t * (1 - t))))
    need = -(-percent * n // 100)
    # A partner may be larger than a head and lose some of what is shared.
    return max(1, need if n <= HEAD * t else need - (math.ceil(HEAD / t) - HEAD))


SKETCHED = "doc_id long, n long, sig binary, head array<long>, sketch binary, prefix int, text_md5 binary"


def sketches(docs: DataFrame, words: int, percent: int, keyed: bool = False) -> DataFrame:
    """Set size, signature of the set, head and bottom-k sketch (upper halves, int32) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            sets = [shingle_set(t, words, memo) for t in batch.column(1).to_pylist()]
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:HEAD] for s in sets], pa.list_(pa.int64())),
                    pa.array([(s[:SKETCH] >> 32).astype(np.int32).tobytes() for s in sets], pa.binary()),
                    pa.array([min(n, HEAD) - overlap(n, percent) + 1 if n else 0 for n in sizes], pa.int32()),
                    batch.column(2),
                ],
                [f.split()[0] for f in SKETCHED.split(", ")],
            )

    key = F.unhex(F.md5(whole_text())) if keyed else F.lit(None).cast("binary")
    return docs.select("doc_id", whole_text().alias("text"), key.alias("text_md5")).mapInArrow(work, SKETCHED)


class _Member:
    __slots__ = ("label", "n", "node", "prefix", "sketch")

    def __init__(self, node: int, n: int, label: int, prefix: np.ndarray, sketch: np.ndarray):
        self.node, self.n, self.label, self.prefix, self.sketch = node, n, label, prefix, sketch


def _first_common(a: _Member, b: _Member) -> int | None:
    """The rarest list that both are in: the one list in which the pair counts."""
    other = set(b.prefix.tolist())
    return next((v for v in a.prefix.tolist() if v in other), None)


def _shared(members: list[_Member]) -> np.ndarray:
    """How many sketch values each two members share."""
    values = np.concatenate([m.sketch for m in members])
    owner = np.repeat(np.arange(len(members)), [len(m.sketch) for m in members])
    _, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    often = counts > 1
    column = np.cumsum(often) - 1
    hit = often[at]
    rows, cols = owner[hit], column[at[hit]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((len(members), len(members)), np.int32)
    step = max(1, (1 << 22) // len(members))  # columns at once: bounds the dense piece
    total = int(often.sum())
    for first in range(0, total, step):
        lo, hi = np.searchsorted(cols, [first, first + step])
        piece = np.zeros((len(members), min(step, total - first)), np.float32)
        piece[rows[lo:hi], cols[lo:hi] - first] = 1
        out += (piece @ piece.T).astype(np.int32)
    return out


def _compare(value: int, members: list[_Member], percent: int) -> Iterator[tuple[int, int, bool]]:
    """Links (a, b, sure) among the members of a list that aren't connected yet.

    Links of whole sets and estimates clearly above the threshold leave as a spanning forest;
    estimates near it leave one by one, unless the forest connects their ends. A link that hangs on
    one shared value isn't sure, since two values may have equal upper halves.
    """
    if len(members) < 2:
        return
    n, label = (np.array([getattr(m, k) for m in members], np.int64) for k in ("n", "label"))
    whole = n <= SKETCH
    shared = _shared(members)
    linked, certain, fits, maybe, clear = (np.zeros(shared.shape, bool) for _ in range(5))
    for first in range(0, len(members), 128):  # some rows at once: bounds the temporary arrays
        rows = slice(first, first + 128)
        mine, both, apart = n[rows, None], whole[rows, None] & whole[None, :], label[rows, None] != label[None, :]
        linked[rows] = apart & both & (100 * shared[rows] >= percent * (mine + n[None, :] - shared[rows]))
        certain[rows] = linked[rows] & (100 * (shared[rows] - 1) >= percent * (mine + n[None, :] - shared[rows] + 1))
        fits[rows] = apart & ~both & (100 * np.minimum(mine, n[None, :]) >= percent * np.maximum(mine, n[None, :]))
    # Larger sets: shared values against all values up to where the shorter reach of the two ends.
    a, b = np.nonzero(np.triu(fits, 1))
    if len(a):
        t = percent / 100
        margin = DEVIATIONS * math.sqrt(t * (1 - t) / SKETCH)
        ends = np.array([m.sketch[-1] if not w else np.iinfo(np.int32).max for m, w in zip(members, whole, strict=True)])
        for i in np.unique(np.concatenate([a, b])):  # counts of the others' values up to the end of i
            mine = np.concatenate([b[a == i], a[b == i]])
            mine = mine[(ends[mine] > ends[i]) | (ends[mine] == ends[i]) & (mine > i)]
            upto = np.array([np.searchsorted(members[j].sketch, ends[i], side="right") for j in mine], np.int64)
            s = shared[i, mine]
            union = len(members[i].sketch) + upto - s
            for mark, least in ((maybe, t - margin), (clear, t + margin)):
                mark[i, mine] = mark[mine, i] = s >= least * union
    part = np.full(len(members), -1)
    close = linked | clear
    for i in range(len(members)):
        if part[i] >= 0:
            continue
        part[i], front = i, [i]
        while front:
            x = front.pop()
            new = np.flatnonzero(close[x] & (part < 0))
            part[new] = i
            front += new.tolist()
            for y in new.tolist():
                if members[x].node != members[y].node:
                    yield members[x].node, members[y].node, bool(certain[x, y])
    for i, j in zip(*np.nonzero(np.triu(maybe & (part[:, None] != part[None, :]), 1)), strict=True):
        x, y = (members[i], members[j]) if members[i].node < members[j].node else (members[j], members[i])
        if x.node != y.node and _first_common(x, y) == value:
            yield x.node, y.node, False


LINKS = "a long, b long, sure boolean"


def _list_links(lists: DataFrame, percent: int) -> DataFrame:
    """Links of every list; lists: rows value, lo, hi, node, n, label, prefix, sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []

        def flush() -> pa.RecordBatch:
            a, b, sure = zip(*out, strict=True) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], ["a", "b", "sure"])

        for batch in batches:
            value, lo, hi, node, n, label = (batch.column(k).to_pylist() for k in range(6))
            c = batch.column(6)
            prefix = np.split(c.flatten().to_numpy(zero_copy_only=False), np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(c) else []
            sketch = [np.frombuffer(x, np.int32) for x in batch.column(7).to_pylist()]
            for row in range(batch.num_rows):
                if (value[row], lo[row], hi[row]) != key:
                    if key:
                        out.extend(_compare(key[0], members, percent))
                    key, members = (value[row], lo[row], hi[row]), []
                members.append(_Member(node[row], n[row], label[row], prefix[row], sketch[row]))
            yield flush()
        if key:
            out.extend(_compare(key[0], members, percent))
        yield flush()

    ordered = lists.select("value", "lo", "hi", "node", "n", "label", "prefix", "sketch").repartition("value", "lo", "hi").sortWithinPartitions("value", "lo", "hi")
    return ordered.mapInArrow(work, LINKS)


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words, memo) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(work, "node long, shingles array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    pairs = durable(pairs, "near-unsure")
    nodes = durable(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "near-nodes")
    sets = durable(_full_sets(rows_of(docs.select("doc_id", "text"), nodes, "doc_id"), words), "near-sets")
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    joined = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return joined.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_links(sketched: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes: enough of them to connect all that are linked."""
    heads = nodes.select("node", "n", "head", "prefix")
    values = heads.select("node", "n", "prefix", F.explode("head").alias("value"))
    # Counts are written before they are joined: both sides are plain shuffles then, and a hot value can be split.
    often = durable(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-values")
    rare = values.join(often, "value").groupBy("node", "n", "prefix").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    # Values of one node alone are the rarest: they use up the prefix first.
    room = F.col("prefix") - (F.least("n", F.lit(HEAD)) - F.size("common")).cast("int")
    chosen = durable(rare.withColumn("room", room).where("room > 0").select("node", "n", F.slice("common", 1, F.col("room")).alias("common")), "near-prefix")
    entries = chosen.select("node", "n", F.transform("common", lambda c: c["value"]).alias("prefix"), F.explode("common").alias("c")).select("node", "n", "prefix", F.col("c.value").alias("value"))
    sizes = durable(entries.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "near-lists")
    entries = durable(with_blocks(entries, sizes, BLOCK), "near-entries")
    release(often, chosen, sizes)

    def linked(tasks: DataFrame) -> DataFrame:
        listed = durable(tasks.select(F.col("node").alias("doc_id")).distinct(), "near-listed")
        carried = rows_of(sketched, listed, "doc_id").select(F.col("doc_id").alias("node"), "n", "sketch")
        found = durable(_list_links(tasks.join(carried, ["node", "n"]), percent), "near-links")
        checked = durable(_verified(found.where("not sure").select("a", "b").distinct(), docs, words, percent), "near-checked")
        links = durable(found.where("sure").select("a", "b").union(checked).distinct(), "near-joined")
        release(listed, found, checked)
        return links

    links = linked(first_wave(entries).withColumn("label", F.col("node")))
    if not entries.where("blocks > 1").isEmpty():
        parts = components(links)
        late = second_wave(entries, parts, LATE_BLOCK)
        if late is not None:
            links = links.union(linked(durable(late, "near-late")))
        release(parts)
    release(entries)
    return links


def near_dedup(docs: DataFrame, words: int = 3, percent: int = 85, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; keyed: and text_md5 (null text as empty).

    Linked: percent or more of 100 * |A and B| / |A or B|, on sets of shingles of `words` words.
    """
    sketched = durable(sketches(docs, words, percent, keyed), "near-sketches")
    real = sketched.where("n > 0 and doc_id is not null")
    classes = real.groupBy("sig").agg(F.min("doc_id").alias("node"))
    nodes = real.alias("r").join(classes.alias("c"), (F.col("r.sig") == F.col("c.sig")) & (F.col("r.doc_id") == F.col("c.node"))).select("c.node", "r.n", "r.head", "r.prefix")
    parts = components(near_links(sketched, nodes, docs, words, percent))
    members = durable(sketched.select("doc_id", "n", "sig", "text_md5"), "near-members")
    classes = durable(classes, "near-classes")
    release(sketched)
    member = members.alias("m").join(classes.alias("c"), (F.col("m.sig") == F.col("c.sig")) & (F.col("m.n") > 0), "left").select("m.doc_id", "m.n", "m.text_md5", F.coalesce("c.node", "m.doc_id").alias("own"))
    placed = member.join(parts, member["own"] == parts["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "own"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["text_md5"] if keyed else []))
