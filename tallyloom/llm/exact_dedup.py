"""Exact deduplication over a cuckoo-filter index of live text digests.

Every text becomes its SHA-256 (JVM side). Digests then meet in cuckoo filters twice: each input
partition folds its own rows first, so that a group holding a third of all rows leaves a task as
one entry, and after a shuffle by digest each bucket partition merges the entries in digest order:
digests that can't come again are handed on and deleted from the filter, which so holds only live
ones. No text is shuffled. A filter hit (equal 16-bit fingerprint in one of two buckets) is only a
maybe; it counts after the full stored digest and text length in that bucket's content compare equal.
A filter that overflows its kicks doubles and is refilled from its stored keys.

An index kept as a table follows a corpus that gains and loses documents (update_index). An entry
counts its documents and names the largest doc_id and up to SPARE next ones, so that when the keeper
is deleted the next one stands ready; floor is the largest doc_id that may be among the unnamed ones,
and only ids from it on are named. When more keepers are deleted than that, the entry is marked
stale: it still counts right, and renamed() finds its keeper in the corpus.

Defined cases: null text counts as empty, so null and empty texts are one group. Null doc_id never
wins over another id; a group with only null ids keeps all its rows. Rows that repeat the winner's
doc_id and text all stay, they are the same document. An empty table gives no rows. Extra columns
of any name are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import whole_text

SLOTS = 4
#: Displacements tried before a filter doubles.
MAX_KICKS = 128
#: Entries that a task folds before it hands them on: bounds a worker's memory, not the result.
FOLD_ENTRIES = 200_000
#: Entries that a merging task holds before it hands on the finished ones.
LIVE_ENTRIES = 50_000
#: doc_ids that an entry has in reserve.
SPARE = 4
ENTRY = "digest binary, n_bytes long, keep_id long, group_size long, spare array<long>, stale boolean, floor long"


class CuckooIndex:
    """A cuckoo filter whose slots point at stored content (digest, length) with a payload.

    Payload: the largest doc_ids, the number of rows, and the largest doc_id that may be unnamed.
    """

    def __init__(self, buckets: int = 256):
        self.keys: list[tuple[bytes, int] | None] = []
        self.ids: list[list[int]] = []
        self.rows: list[int] = []
        self.floor: list[int | None] = []
        self.live = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.refs = array("q", bytes(8 * SLOTS * buckets))

    @staticmethod
    def _marks(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:8], "little"), int.from_bytes(key[8:10], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _slot(self, digest: bytes, n_bytes: int) -> int:
        """The slot whose stored content equals the key, or -1."""
        place, mark = self._marks(digest)
        first = place & self.mask
        for bucket in (first, self._other(first, mark)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[self.refs[slot]] == (digest, n_bytes):
                    return slot
        return -1

    def __contains__(self, key: tuple[bytes, int]) -> bool:
        return self._slot(*key) >= 0

    def insert(self, digest: bytes, n_bytes: int, doc_id: int | None, rows: int = 1, spare: Iterable[int] = (), stale: bool = False, floor: int | None = None) -> None:
        """Adds an entry to its digest's; stale is what the entry's ids and floor say already."""
        ids = [] if doc_id is None else [doc_id, *spare]
        slot = self._slot(digest, n_bytes)
        if slot >= 0:
            ref = self.refs[slot]
            self.rows[ref] += rows
            self._name(ref, self.ids[ref] + ids, floor)
            return
        self.keys.append((digest, n_bytes))
        self.ids.append([])
        self.rows.append(rows)
        self.floor.append(None)
        self._name(len(self.keys) - 1, ids, floor)
        self.live += 1
        if not self._place(len(self.keys) - 1):
            self._grow()

    def _name(self, ref: int, ids: list[int], floor: int | None) -> None:
        """Names the largest ids; those below what may be unnamed, and those beyond SPARE, are unnamed themselves."""
        floors = [f for f in (self.floor[ref], floor) if f is not None]
        ids = sorted(ids, reverse=True)
        if floors:
            ids = [i for i in ids if i >= max(floors)]
        floors += ids[SPARE + 1 :]
        self.ids[ref] = ids[: SPARE + 1]
        self.floor[ref] = max(floors) if floors and len(self.ids[ref]) < self.rows[ref] else None

    def delete(self, digest: bytes, n_bytes: int) -> bool:
        """Forgets a live digest; True if it was there."""
        slot = self._slot(digest, n_bytes)
        if slot < 0:
            return False
        self.keys[self.refs[slot]] = None
        self.prints[slot] = 0
        self.live -= 1
        return True

    def remove(self, digest: bytes, n_bytes: int, doc_id: int | None) -> bool:
        """Takes one document from a live digest, which goes with its last; True if that may have been one of its documents."""
        slot = self._slot(digest, n_bytes)
        if slot < 0:
            return False
        ref = self.refs[slot]
        ids, floor = self.ids[ref], self.floor[ref]
        if doc_id in ids:
            ids.remove(doc_id)
        elif len(ids) == self.rows[ref] or doc_id is not None and (floor is None or doc_id > floor):
            return False
        self.rows[ref] -= 1
        if not self.rows[ref]:
            return self.delete(digest, n_bytes)
        if len(ids) == self.rows[ref]:
            self.floor[ref] = None
        return True

    def _place(self, ref: int) -> bool:
        place, mark = self._marks(self.keys[ref][0])
        bucket = place & self.mask
        for kick in range(MAX_KICKS):
            for at in (bucket, self._other(bucket, mark)):
                for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.refs[slot] = mark, ref
                        return True
            bucket = self._other(bucket, mark)
            slot = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.refs[slot], ref = ref, self.refs[slot]
        return False

    def _grow(self) -> None:
        """Doubles until all live keys fit again; fingerprints come from the stored keys."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(ref) for ref, key in enumerate(self.keys) if key is not None):
                return

    def entries(self) -> Iterator[tuple[bytes, int, int | None, int]]:
        for (digest, n_bytes), ids, rows, _ in self._stored():
            yield digest, n_bytes, ids[0] if ids else None, rows

    def _stored(self) -> Iterator[tuple]:
        return (x for x in zip(self.keys, self.ids, self.rows, self.floor, strict=True) if x[0] is not None)

    def drain(self, keep: tuple[bytes, int] | None = None) -> pa.RecordBatch:
        """The entries as a batch, each deleted here; the entry of `keep` stays."""
        found = [x for x in self._stored() if x[0] != keep]
        for key, *_ in found:
            self.delete(*key)
        left = list(self._stored())
        self.keys, self.ids, self.rows, self.floor = (list(x) for x in zip(*left, strict=True)) if left else ([], [], [], [])
        self._clear(self.mask + 1)
        for ref in range(len(left)):
            self._place(ref)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()]
        cols = list(zip(*((k[0], k[1], ids[0] if ids else None, rows, ids[1:], not ids and floor is not None, floor) for k, ids, rows, floor in found), strict=True)) if found else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [f.split()[0] for f in ENTRY.split(", ")])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for row in _rows(batch):
            index.insert(*row)
        if index.live > FOLD_ENTRIES:
            yield index.drain()
    yield index.drain()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRY and step, ordered by digest and step: 0 and 2 insert an entry, 1 takes a document."""
    index = CuckooIndex()
    for batch in batches:
        for digest, n_bytes, doc_id, rows, spare, stale, floor, step in _rows(batch):
            if index.live > LIVE_ENTRIES:
                yield index.drain(keep=(digest, n_bytes))
            if step == 1:
                index.remove(digest, n_bytes, doc_id)
            else:
                index.insert(digest, n_bytes, doc_id, rows, spare, stale, floor)
    yield index.drain()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_bytes of every row."""
    return docs.select("doc_id", F.unhex(F.sha2(whole_text(), 256)).alias("digest"), F.octet_length(whole_text()).cast("long").alias("n_bytes"))


def _merged(entries: DataFrame) -> DataFrame:
    return entries.repartition("digest").sortWithinPartitions("digest", "n_bytes", "step").mapInArrow(_apply, ENTRY)


def build_index(docs: DataFrame) -> DataFrame:
    """One entry per distinct text: digest, n_bytes, keep_id, group_size, spare, stale, floor. Writable as a table."""
    rows = digests(docs).select("digest", "n_bytes", "doc_id", F.lit(1).cast("long").alias("n"))
    return _merged(rows.mapInArrow(_fold, ENTRY).withColumn("step", F.lit(0)))


def update_index(index: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The index after taking out the rows of `deleted` (doc_id, text) and then adding those of `inserted`.

    Each row of `deleted` takes one row with its doc_id and text; rows that the index can tell it
    never had are ignored.
    """
    names = [f.split()[0] for f in ENTRY.split(", ")]
    steps = index.select(*names, F.lit(0).alias("step"))
    if deleted is not None:
        gone = digests(deleted).select("digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.array().cast("array<long>").alias("spare"), F.lit(False).alias("stale"), F.lit(None).cast("long").alias("floor"), F.lit(1).alias("step"))
        steps = steps.unionByName(gone)
    if inserted is not None:
        steps = steps.unionByName(build_index(inserted).withColumn("step", F.lit(2)))
    return _merged(steps)


def renamed(index: DataFrame, docs: DataFrame) -> DataFrame:
    """The index with the keepers of stale entries looked up among docs, the corpus as it is now."""
    stale = index.where("stale").select("digest", "n_bytes")
    found = digests(docs).join(stale, ["digest", "n_bytes"]).groupBy("digest", "n_bytes").agg(F.max("doc_id").alias("largest"))
    both = index.join(found, ["digest", "n_bytes"], "left")
    return both.select("digest", "n_bytes", F.when(F.col("stale"), F.col("largest")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", F.when(F.col("stale"), F.array().cast("array<long>")).otherwise(F.col("spare")).alias("spare"), F.lit(False).alias("stale"), F.when(~F.col("stale"), F.col("floor")).when(F.col("group_size") > 1, F.col("largest")).alias("floor"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes for every row of docs."""
    index = build_index(docs).select("digest", "n_bytes", "keep_id", "group_size")
    return (
        digests(docs)
        .join(index, ["digest", "n_bytes"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes")
    )
