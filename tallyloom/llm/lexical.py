"""Ranked lexical search as a blocked sparse matrix product.

Scores are a product of two sparse matrices of integers: items by terms (how often an item has a
term) and terms by documents (impacts, int64). One pass over the whole texts counts, per document,
all terms and those that the items use; it is written once, since document frequencies must be known
before impacts are. A second pass takes the documents in blocks of columns. Within a block the
impacts are put in rows by term, and each item merges the rows of its own terms (Gustavson) in a
numpy accumulator over the block. Blocks give their k best per item, tasks merge the bests of their
blocks, and a window merges those of the tasks: tasks * k rows an item, however many documents.

Items are dealt into blocks whose terms take BLOCK_BYTES at most as they are measured, one block in a
broadcast at a time; the documents are read once more for each further block of items. An item's own
terms are held by one task, as its text is.

Defined results: a null text has no terms; documents without terms don't count. Rows with a null
doc_id count in the statistics and are never returned. Rows that share a doc_id are documents of their
own. Rows that share an item_id (null is one) are one item with the terms of all. Equal scores go by
doc_id. Without items or documents there are no rows. Other columns of the tables are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import durable, release, slices

#: Terms of one block of items: bytes of the terms and 16 a row.
BLOCK_BYTES = 32 << 20
#: Documents and entries of one block of columns.
BLOCK_DOCS, BLOCK_ENTRIES = 16_384, 2_000_000
#: A longer text is cut, between terms, into pieces of about so many bytes.
PIECE = 4 << 20

#: On bytes whose A-Z are lower-cased: digits, letters and every byte of a character past ASCII.
TERM, BETWEEN = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def tally(raw: bytes) -> tuple[int, Counter]:
    """The number of terms of a text and how often each occurs."""
    total, times, at = 0, Counter(), 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            gap = BETWEEN.search(raw, end)
            end = gap.start() if gap else len(raw)
        # bytes.lower() touches A-Z only.
        found = TERM.findall(raw[at:end].lower())
        total += len(found)
        times.update(found)
        at = end
    return total, times


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of all items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owners, terms, times = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for term, n in tally(text or b"")[1].items():
                    owners.append(item), terms.append(term), times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["item_id", "term", "times"])

    each = items.select(F.col("item_id").cast("long"), "text").mapInArrow(rows, "item_id long, term binary, times long")
    return each.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Items:
    """One block of items: a row of terms and multiplicities each."""

    def __init__(self, rows: list, repeats: bool) -> None:
        owners: dict = {}
        self.terms: dict[bytes, int] = {}
        for row in rows:
            owners.setdefault(row.item_id, []).append((self.terms.setdefault(bytes(row.term), len(self.terms)), row.times if repeats else 1))
        self.ids = list(owners)
        self.rows = [(np.array([t for t, _ in row]), np.array([n for _, n in row], dtype=np.int64)) for row in owners.values()]


def term_counts(docs: DataFrame, items) -> DataFrame:
    """doc_id, n (all terms), terms (numbers in the block of items) and tf of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value.terms
        for batch in slices(batches):
            n, ends, terms, tf = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                total, times = tally(text.as_py() or b"")
                n.append(total)
                for term, often in times.items():
                    number = known.get(term)
                    if number is not None:
                        terms.append(number), tf.append(often)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind)) for values, kind in ((terms, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n long, terms array<int>, tf array<long>")


def weight(documents: int, frequency: int) -> int:
    """How much a term says: floor(1000 * ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of each document: 100 at the mean length; exact also where 50 n N passes 64 bits."""
    if len(n) and int(n.max()) * 50 * documents >= 1 << 63:
        return np.array([50 + 50 * int(x) * documents // total for x in n], dtype=np.int64)
    return 50 + (50 * n * documents) // total


class Best:
    """The k best (score, doc_id) of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.score, self.doc = k, [np.empty(0, np.int64)] * items, [np.empty(0, np.int64)] * items
        self.least = np.ones(items, dtype=np.int64)

    def offer(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score[item], score]), np.concatenate([self.doc[item], doc])
        if len(score) > self.k:
            near = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc = score[near], doc[near]
            order = np.lexsort((doc, -score))[: self.k]
            score, doc = score[order], doc[order]
            self.least[item] = score[-1]
        self.score[item], self.doc[item] = score, doc


def product(items: Items, doc: np.ndarray, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray, best: Best) -> None:
    """One block of columns: rows by term are merged for each item, the block's best offered."""
    column = np.repeat(np.arange(len(doc)), np.diff(ends))
    order = np.argsort(terms, kind="stable")
    column, impact = column[order], impact[order]
    starts = np.searchsorted(terms[order], np.arange(len(items.terms) + 1))
    for item, (row, times) in enumerate(items.rows):
        merged = np.zeros(len(doc), dtype=np.int64)
        for term, often in zip(row, times):
            lo, hi = starts[term], starts[term + 1]
            merged[column[lo:hi]] += impact[lo:hi] * often
        found = np.flatnonzero(merged >= best.least[item])
        if len(found):
            best.offer(item, merged[found], doc[found])


def block_bests(counts: DataFrame, items, weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each task's documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, best, held, entries = items.value, Best(len(items.value.ids), k), [], 0

        def flush() -> None:
            doc, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            sizes, terms, tf = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
            m = np.repeat(lengths(n, documents, total), sizes)
            impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            product(mine, doc, np.concatenate([[0], np.cumsum(sizes)]), terms, impact, best)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), sizes, part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()))
                entries += int(sizes.sum())
                if entries >= BLOCK_ENTRIES or sum(len(h[0]) for h in held) >= BLOCK_DOCS:
                    flush()
                    entries = 0
        if held:
            flush()
        for item, ident in enumerate(mine.ids):
            if len(best.doc[item]):
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(best.doc[item]), pa.int64()), pa.array(best.doc[item]), pa.array(best.score[item])], ["item_id", "doc_id", "score"])

    return counts.where("doc_id IS NOT NULL AND n > 0").mapInArrow(rows, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, repeats: bool = False) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    A term counts once an item, or with repeats as often as the item has it.
    """
    spark = docs.sparkSession
    terms = durable(item_terms(items), "item-terms")
    size = terms.select(F.sum(F.length("term") + 16)).first()[0] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    # On a hash by item, half full on average; an item stays whole.
    numbered = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = []
    for block in range(blocks):
        mine = spark.sparkContext.broadcast(Items(numbered.where(F.col("block") == block).collect(), repeats))
        counts = durable(term_counts(docs, mine), "term-counts")
        documents, total = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(mine.value.terms), dtype=np.int64)
        for row in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            weights[row.term] = weight(documents, row.df)
        found.append(durable(block_bests(counts, mine, weights, documents, total, k), "block-bests"))
        release(counts)
    release(terms)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
