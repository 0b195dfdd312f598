"""Comparing the members of inverted lists in tasks of bounded size, without all pairs of a list.

A list (value) may hold a third of all rows. Its members are dealt into blocks; in the first wave a
task holds one block and, from every long list, a few representatives that visit all its blocks. So
a group of copies grows together by its representatives, and each member is sent once. In the second
wave only lists whose members are not yet in one component come back: members outside the list's
largest component meet all others, since one link of theirs may be to any member. Nothing is left
out: two members of a list either meet or are connected already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import durable

#: Members of a long list that visit all its blocks.
REPRESENTATIVES = 8


def with_blocks(entries: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Entries (value, node, ...) of the lists in sizes (value, members), with blocks and own (block of the entry)."""
    blocks = F.ceil(F.col("members") / block).cast("int")
    return entries.join(sizes, "value").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "value"), F.col("blocks")).cast("int"))


def first_wave(entries: DataFrame) -> DataFrame:
    """Entries of with_blocks() with their tasks (value, lo, hi): the own block, representatives every block."""
    rest = [c for c in entries.columns if c not in ("value", "own")]
    home = entries.withColumn("lo", F.col("own")).withColumn("hi", F.lit(0))
    turn = F.pmod(F.xxhash64("node"), F.lit(REPRESENTATIVES))
    chosen = entries.where("blocks > 1").groupBy("value", turn.alias("turn")).agg(F.min(F.struct("node", "own", *(c for c in rest if c != "node"))).alias("r"))
    guests = chosen.select("value", "r.*").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("lo <> own").withColumn("hi", F.lit(0))
    return home.unionByName(guests).drop("own", "blocks", "members")


def second_wave(entries: DataFrame, components: DataFrame, block: int) -> DataFrame | None:
    """Tasks for what the first left apart, with label (the component so far); None if there is nothing.

    Tasks (block, chunk) hold a block of a list and a chunk of the members outside its largest
    component; tasks with a negative lo hold two such chunks.
    """
    long = entries.where("blocks > 1")
    if long.isEmpty():
        return None
    # Read several times below; written, so that the rows of long lists are joined once.
    marked = durable(long.join(components, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component", "blocks", "own"), "long-lists")
    labels = marked.groupBy("value", "label").agg(F.count(F.lit(1)).alias("rows"))
    top = labels.groupBy("value").agg(F.max(F.struct("rows", "label")).alias("top"), F.sum("rows").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    top = top.select("value", F.col("top.label").alias("most"), F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("top.rows")) / block).cast("int").alias("chunks"))
    apart = marked.join(top, "value").withColumn("own", F.pmod(F.xxhash64("node", "value"), F.col("blocks")).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("value", "node"), F.col("chunks")).cast("int"))
    outside, every = F.col("label") != F.col("most"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = apart.where(~outside).withColumn("hi", every("chunks")).withColumn("lo", F.col("own"))
    meeting = apart.where(outside).withColumn("lo", every("blocks")).withColumn("hi", F.col("chunk"))
    among = apart.where(outside).where("chunks > 1").withColumn("other", every("chunks")).where("other <> chunk")
    among = among.withColumn("lo", -1 - F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other")
    return inside.unionByName(meeting).unionByName(among).drop("own", "blocks", "chunks", "chunk", "most", "members")
