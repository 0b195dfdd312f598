"""Line deduplication by a suffix array over line-ID sequences; DataFrame operations only.

Every document is a sequence of line ids (lines without a word are left aside), and a run of lines
that occurs anywhere earlier is a later copy: it is deleted if it has at least `min_words` words.
Earlier means a smaller doc_id or an earlier line of the same document; copies may overlap.

Prefix doubling ranks the suffixes: level 0 orders the lines that occur more than once, level k + 1
orders pairs (rank of the first 2^k lines, rank of the next 2^k) that occur more than once. A suffix
whose prefix is unique can't begin a repeated run and drops out, so a level holds only what still
repeats. Ranks come from one distributed sort of the distinct pairs, not of the suffixes: a line that
a third of all documents share is one row there.

Doubling goes on until nothing repeats, so the last levels order the repeating suffixes in full.

Suffixes with equal rank are an LCP interval: they share that prefix. In each interval the first
occurrence stays and the others begin later copies of 2^k lines. A longer run that repeats is covered
by such copies from its first and its last lines on. Runs of fewer lines than min_words may have too
few words, so these intervals are formed at their exact size: a block of m lines with
2^k <= m < 2^(k+1) is the interval of (rank of its first, rank of its last 2^k lines), and the
shortest blocks with min_words words, from each line forwards and backwards, are looked at. runs()
extends the copies with their first occurrence in both directions to maximal repeated runs.

Equal texts are folded first: all but the one with the smallest doc_id are later copies as a whole
and don't enter the array, unless they have fewer than min_words words.

Defined cases: null text stays null. Null doc_id comes last in the order. Rows that share doc_id and
text are one document: none is a copy of the other. Lines are compared exactly; only a line feed
ends a line. Lines without words are never deleted. Empty tables give no rows; other columns are
passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import durable, release, unused

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 4
PLACE = ["id", "key", "seq"]


def _keyed(docs: DataFrame) -> DataFrame:
    """id (doc_id, null last), key (digest of the text), text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """id, key, seq (among lines with words), pos (among all lines), line (digest), words."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    spoken = F.filter(numbered, lambda x: x["line"].rlike(WORD))
    rows = keyed.select("id", "key", F.posexplode(spoken).alias("seq", "at"))
    return rows.select("id", "key", "seq", F.col("at.pos").alias("pos"), F.unhex(F.md5("at.line")).alias("line"), F.regexp_count("at.line", F.lit(WORD)).alias("words"))


def _ranked(distinct: DataFrame, by: list[str], tag: str) -> DataFrame:
    """The rows in order with a rank that grows with it (not dense)."""
    return durable(distinct.orderBy(*by).select(*by, F.monotonically_increasing_id().alias("rank")), tag)


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Level k of the list: id, key, seq, rank of the suffixes whose first 2^k lines repeat, for all k with any."""
    # Counts are written before they are joined: both sides are plain shuffles then, and a hot line can be split.
    often = durable(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-often")
    alphabet = _ranked(often, ["line"], "line-ids")
    levels = [durable(lines.join(alphabet, "line").select(*PLACE, "pos", "words", "rank"), "line-ranks")]
    release(often, alphabet)
    while True:
        step = 1 << len(levels) - 1
        here = levels[-1].select(*PLACE, F.col("rank").alias("first"))
        there = levels[-1].select("id", "key", (F.col("seq") - step).alias("seq"), F.col("rank").alias("second"))
        pairs = durable(here.join(there, PLACE), "line-pairs")
        names = _ranked(pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["first", "second"], "line-names")
        level = durable(pairs.join(names, ["first", "second"]).select(*PLACE, "rank"), "line-ranks")
        release(pairs, names)
        if level.isEmpty():
            return levels
        levels.append(level)


def _reach(words: Column, order: Window, least: int, sign: int) -> Column:
    """Lines of the shortest block from here (sign 1: forwards, -1: backwards) with `least` words."""
    total, size = words, F.when(words >= least, 1)
    near = F.lead if sign > 0 else F.lag
    for k in range(1, least):
        total = F.when(near("seq", k).over(order) == F.col("seq") + sign * k, total + near("words", k).over(order))
        size = F.coalesce(size, F.when(total >= least, k + 1))
    return size


def later_copies(levels: list[DataFrame], min_words: int = MIN_WORDS) -> DataFrame:
    """id, key, seq, m, owner: blocks of m lines that begin later copies, and the place of the first."""
    short = [k for k in range(len(levels)) if 1 << k < min_words]
    order = Window.partitionBy("id", "key").orderBy("seq")
    sized = levels[0].select(*PLACE, _reach(F.col("words"), order, min_words, 1).alias("ahead"), _reach(F.col("words"), order, min_words, -1).alias("back"))
    forth = sized.where("ahead is not null").select(*PLACE, F.col("ahead").alias("m"))
    back = sized.where("back is not null").select("id", "key", (F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("m"))
    blocks = durable(forth.union(back).distinct().withColumn("k", F.floor(F.log2(F.col("m") + F.lit(0.5))).cast("int")), "line-blocks")
    interval, place = ["m", "first", "last"], F.struct("id", "key", "seq")
    named = None
    for k, level in enumerate(levels):
        rank = level.select(*PLACE, F.col("rank").alias("first"))
        if k in short:
            end = level.select("id", "key", F.col("seq").alias("tail"), F.col("rank").alias("last"))
            part = blocks.where(F.col("k") == k).join(rank, PLACE).withColumn("tail", F.col("seq") + F.col("m") - (1 << k)).join(end, ["id", "key", "tail"])
        else:  # that many lines have words enough
            part = rank.withColumn("m", F.lit(1 << k)).withColumn("last", F.col("first"))
        part = part.select(*PLACE, *interval)
        named = part if named is None else named.union(part)
    named = durable(named, "line-intervals")
    # Written first: then both sides of the join are plain shuffles, and Spark can split a hot interval.
    owners = durable(named.groupBy(*interval).agg(F.min(place).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-owners")
    return named.join(owners, interval).where(place != F.col("owner")).select(*PLACE, "m", "owner")


def covered(level: DataFrame, copies: DataFrame) -> DataFrame:
    """id, key, seq, pos of the repeating lines that lie in a later copy."""
    ends = copies.groupBy(*PLACE).agg(F.max(F.col("seq") + F.col("m")).alias("end"))
    reach = F.max("end").over(Window.partitionBy("id", "key").orderBy("seq"))
    return level.select(*PLACE, "pos").join(ends, PLACE, "left").withColumn("reach", reach).where("reach > seq").select(*PLACE, "pos")


def _twins(ids: DataFrame, min_words: int) -> DataFrame:
    """id, key of documents whose text a smaller id has, and whether they go as a whole."""
    owners = durable(ids.groupBy("key").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1"), "line-text-owners")
    return durable(ids.join(owners, "key").where("id <> owner").select("id", "key", (F.col("words") >= min_words).alias("whole")).distinct(), "line-twins")


def _verdicts(keyed: DataFrame, min_words: int) -> DataFrame:
    """id, key, whole (all lines with words go) or gone (ranges of line numbers) of changed documents."""
    ids = keyed.select("id", "key", F.regexp_count("text", F.lit(WORD)).alias("words"))
    twins = _twins(ids, min_words)
    lines = _distinct_lines(keyed, ids, twins)
    levels = suffix_ranks(lines)
    lost = covered(levels[0], later_copies(levels, min_words))
    ranges = runs_of(lost).groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("gone"))
    return ranges.select("id", "key", F.lit(False).alias("whole"), "gone").union(twins.where("whole").select("id", "key", "whole", F.lit(None).cast("array<struct<first:int,last:int>>").alias("gone")))


def _distinct_lines(keyed: DataFrame, ids: DataFrame, twins: DataFrame) -> DataFrame:
    """Lines of the documents that aren't whole copies; rows that repeat doc_id and text count once."""
    lines = _lines(keyed).join(twins.where("whole").select("id", "key"), ["id", "key"], "left_anti")
    twice = durable(ids.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "key"), "line-twice")
    if not twice.isEmpty():
        lines = lines.join(twice, ["id", "key"], "left_anti").union(lines.join(twice, ["id", "key"], "left_semi").distinct())
    return durable(lines, "lines")


def runs_of(lost: DataFrame) -> DataFrame:
    """id, key, first, last: chains of adjacent line numbers (pos)."""
    order = Window.partitionBy("id", "key").orderBy("pos")
    chained = lost.select("id", "key", "pos", (F.col("pos") - F.row_number().over(order)).alias("chain"))
    return chained.groupBy("id", "key", "chain").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of line runs deleted from text, and the columns n_lines and n_deleted."""
    keyed = _keyed(docs)
    verdicts = durable(_verdicts(keyed, min_words), "line-verdicts")
    own = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    own_id, own_key = unused(docs, "_id"), unused(docs, "_key")
    left = docs.select(*(f"`{c}`" for c in own)).withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), own_key: F.unhex(F.md5(F.coalesce("text", F.lit(""))))}).alias("d")
    right = verdicts.alias("v")
    both = left.join(right, (F.col(f"d.{own_id}") == F.col("v.id")) & (F.col(f"d.{own_key}") == F.col("v.key")), "left")
    lines = F.split("d.text", "\n")
    spoken = F.size(F.filter(lines, lambda x: x.rlike(WORD)))
    gone = F.coalesce("v.gone", F.array().cast("array<struct<first:int,last:int>>"))
    # What lies before the first, between and after the last range, joined again.
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(gone, lambda r: r["first"]), F.array(F.size(lines)))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"]))
    blank = F.array_join(F.filter(lines, lambda x: ~x.rlike(WORD)), "\n")
    text = F.when(F.col("v.id").isNull(), F.col("d.text")).when(F.col("v.whole"), blank).otherwise(F.array_join(F.flatten(parts), "\n"))
    removed = F.when(F.col("v.id").isNull(), 0).when(F.col("v.whole"), spoken).otherwise(F.aggregate(gone, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1))
    count = F.coalesce(F.when(F.col("d.text").isNotNull(), F.size(lines)), F.lit(0))
    return both.select(*(text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in own), count.cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_deleted"))


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, first, last, source_doc_id, source_first: maximal repeated runs and their first occurrence.

    Line numbers from 0, first and last of the later copy. A run can't be extended with this source
    in either direction, lines without words aside. Together the runs cover the deleted lines but for
    later copies of whole texts, which aren't listed.
    """
    keyed = _keyed(docs)
    ids = keyed.select("id", "key", F.regexp_count("text", F.lit(WORD)).alias("words"))
    lines = _distinct_lines(keyed, ids, _twins(ids, min_words))
    levels = suffix_ranks(lines)
    pairs = later_copies(levels, min_words).select(*PLACE, "m", F.col("owner.id").alias("oid"), F.col("owner.key").alias("okey"), F.col("owner.seq").alias("oseq"))
    pairs = durable(pairs.withColumn("right", F.col("m").cast("int")).withColumn("left", F.lit(0)).drop("m"), "line-copies")
    for side in ("right", "left"):  # what follows and what comes before on both sides, by halving steps
        for k in range(len(levels) - 1, -1, -1):
            shift = F.col("right") if side == "right" else -F.col("left") - (1 << k)
            level = levels[k].select(*PLACE, "rank")
            own = level.select(F.col("id").alias("i"), F.col("key").alias("j"), F.col("seq").alias("s"), F.col("rank").alias("a"))
            other = level.select(F.col("id").alias("x"), F.col("key").alias("y"), F.col("seq").alias("z"), F.col("rank").alias("b"))
            at = pairs.withColumn("own_at", F.col("seq") + shift).withColumn("other_at", F.col("oseq") + shift)
            both = at.join(own, (F.col("id") == F.col("i")) & (F.col("key") == F.col("j")) & (F.col("own_at") == F.col("s")), "left")
            both = both.join(other, (F.col("oid") == F.col("x")) & (F.col("okey") == F.col("y")) & (F.col("other_at") == F.col("z")), "left")
            grown = F.col(side) + F.when(F.col("a") == F.col("b"), 1 << k).otherwise(0)
            pairs = durable(both.withColumn(side, grown).select(*PLACE, "oid", "okey", "oseq", "right", "left"), "line-copies")
    found = pairs.select("id", "key", (F.col("seq") - F.col("left")).alias("start"), (F.col("seq") + F.col("right") - 1).alias("end"), "oid", "okey", (F.col("oseq") - F.col("left")).alias("source")).distinct()
    place = lines.select("id", "key", "seq", "pos")
    found = found.join(place.withColumnsRenamed({"seq": "start", "pos": "first"}), ["id", "key", "start"]).join(place.withColumnsRenamed({"seq": "end", "pos": "last"}), ["id", "key", "end"])
    found = found.join(place.withColumnsRenamed({"id": "oid", "key": "okey", "seq": "source", "pos": "source_first"}), ["oid", "okey", "source"])
    null_last = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c))
    return found.select(null_last("id").alias("doc_id"), "first", "last", null_last("oid").alias("source_doc_id"), "source_first")
