"""Byte-level BPE encoding and decoding with a two-tier lookup.

Text is cut by the vocabulary's pattern. Tier one: a minimal perfect hash over the vocabulary (hash
and displace, built once on the driver) resolves pre-tokens that are tokens themselves; it has
exactly one slot a token, and the slot's bytes are compared, so a stranger never passes. Tier two:
other pre-tokens are merged byte pair by byte pair, lowest rank first and leftmost among equals,
with a heap of candidate pairs over a doubly linked list of parts: n log n also for a pre-token of
megabytes. Pre-tokens resolved lately are remembered in two generations of bounded size.

The vocabulary (bounded by its file, about 1 MB) is broadcast; executors need no file. Special
tokens don't exist: their strings are ordinary text.

Defined cases: null text counts as empty: no tokens, decoded to no bytes. Texts are encoded whole.
Repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows. Lone
surrogates can't occur in Spark strings. Ids outside the vocabulary raise in decode().
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, whole_text

#: Pre-tokens that a generation of the memory holds.
REMEMBERED = 250_000
#: Keys per bucket of the perfect hash, on average.
BUCKET_KEYS = 3


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: slot = (h1 + d + d // n * h2) mod n, d by bucket."""

    def __init__(self, displacements: np.ndarray, slots: np.ndarray):
        self.displacements = displacements.tolist()
        self.slots = slots.tolist()  # index of the key in each slot
        self.n, self.buckets = len(self.slots), len(self.displacements)

    @staticmethod
    def arrays(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Displacements by bucket and the key index by slot. Buckets are placed large ones first."""
        n = len(keys)
        buckets = max(1, -(-n // BUCKET_KEYS))
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        first, step, bucket = PerfectHash._parts(hashes, n, buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        slots = np.full(n, -1, np.int64)
        displacements = np.zeros(buckets, np.int64)
        free = 0
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            members = order[bounds[b] : bounds[b + 1]]
            if not len(members):
                break
            f, s = first[members].astype(np.int64), step[members].astype(np.int64)
            if len(members) == 1:  # any free slot is one shift away
                while slots[free] >= 0:
                    free += 1
                slots[free], displacements[b] = members[0], (free - f[0]) % n
                continue
            for d in range(1 << 24):
                at = (f + d + d // n * s) % n
                if (slots[at] < 0).all() and (len(at) == 1 or len(np.unique(at)) == len(at)):
                    slots[at], displacements[b] = members, d
                    break
            else:
                raise ValueError("keys repeat or collide in 64 bits")
        return displacements, slots

    @staticmethod
    def _parts(h, n: int, buckets: int):
        """Start, step and bucket of a 64-bit hash; h: an int or an array."""
        low = h & 0xFFFFFFFF if isinstance(h, int) else h & np.uint64(0xFFFFFFFF)
        high = h >> 32 if isinstance(h, int) else h >> np.uint64(32)
        return low % n, 1 + high % (n - 1) if n > 1 else high * 0 + 1, (low ^ high) % buckets

    def index(self, key: bytes) -> int:
        """The only key index that `key` could have."""
        first, step, bucket = self._parts(xxhash.xxh3_64_intdigest(key), self.n, self.buckets)
        d = self.displacements[bucket]
        return self.slots[(first + d + d // self.n * step) % self.n]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file (base64 and rank a line)."""
    with open(path, "rb") as file:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [t for _, t in pairs]


class Coder(dict):
    """Encoder and decoder; the mapping itself remembers pre-token -> ids."""

    def __init__(self, tokens: list[bytes], pattern: str, displacements: np.ndarray, slots: np.ndarray):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.hash = PerfectHash(displacements, slots)
        self.names = [str(i) for i in range(len(tokens))]
        self.split = regex.compile(pattern).findall
        self.older: dict = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode("utf-8")
            rank = self.hash.index(raw)
            found = (rank,) if self.tokens[rank] == raw else self.merge(raw)
        if len(piece) <= 64:  # long ones hardly come again
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def forget(self) -> None:
        """Drops the memory, not the tables."""
        self.clear()
        self.older = {}

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no token."""
        n, ranks = len(raw), self.ranks
        get = ranks.get
        ends = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # where the part to the left starts
        pair = [-1] * n  # rank * n + start of the part that starts here joined to the next one
        heap = []
        for i in range(n - 1):
            r = get(raw[i : i + 2])
            if r is not None:
                pair[i] = r * n + i
                heap.append(pair[i])
        heapify(heap)
        while heap:
            k = heappop(heap)
            i = k % n
            if pair[i] != k:  # a neighbour was merged meanwhile
                continue
            j = ends[i]
            end = ends[i] = ends[j]
            pair[i] = pair[j] = -1
            if end < n:
                before[end] = i
                r = get(raw[i : ends[end]])
                if r is not None:
                    k = pair[i] = r * n + i
                    heappush(heap, k)
            h = before[i]
            if h >= 0:
                r = get(raw[h:end])
                if r is None:
                    pair[h] = -1
                else:
                    k = pair[h] = r * n + h
                    heappush(heap, k)
        out, i = [], 0
        while i < n:
            end = ends[i]
            out.append(ranks[raw[i:end]])
            i = end
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def show(self, ids: list[int]) -> str:
        """Ids in decimal with blanks between."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Vocabulary:
    """What executors get: the tokens by rank, the pattern and the perfect hash, broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens = read_ranks(path)
        self.shared = spark.sparkContext.broadcast((tokens, pattern, *PerfectHash.arrays(tokens)))
        self.name = hashlib.sha256(b"\n".join([pattern.encode(), *tokens])).hexdigest()


_CODERS: dict[str, Coder] = {}


def _coder(name: str, shared) -> Coder:
    """One coder a worker process, with its memory."""
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(*shared.value)
    return _CODERS[name]


ENCODED = "doc_id long, n_tokens long, ids array<int>"


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids of every row of docs."""
    name, shared = vocabulary.name, vocabulary.shared

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared)
        for batch in slices(batches):
            ids = [coder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, raw (the bytes) of every row of encoded; null ids as none."""
    name, shared = vocabulary.name, vocabulary.shared

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared)
        for batch in batches:
            raw = [coder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, raw binary")


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Token count, digest of the ids and digest of what they decode to, of every row of docs.

    Encoding and decoding share one pass here, so that ids needn't travel to the JVM and back.
    """
    name, shared = vocabulary.name, vocabulary.shared

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text)
                rows.append((len(ids), hashlib.sha256(coder.show(ids).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], [f.split()[0] for f in ROUND_TRIP.split(", ")])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(work, ROUND_TRIP)


CHECKED = "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string"


def encode_checked(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of what they decode to, of every row of docs.

    A task's end drops what its coder remembers: this is one stage of a pipeline, and a worker that keeps
    it holds it through the others too.
    """
    name, shared = vocabulary.name, vocabulary.shared

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared)
        for batch in slices(batches):
            ids = [coder.encode(t) for t in batch.column(1).to_pylist()]
            decoded = [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids))))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(decoded, pa.string())], [f.split()[0] for f in CHECKED.split(", ")])
        coder.forget()

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(work, CHECKED)
