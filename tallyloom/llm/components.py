"""Connected components of a table of links, by minimum labels and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import durable, release


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, component (smallest node reachable) of every node of links (a, b: long).

    Each round every node takes the least among itself and its neighbours and then what that one took;
    links between nodes of one label are done, the others go on as links between labels. What a small
    component ends with isn't read again, only the labels that are still linked. At the end the rounds'
    labels are put in each other's place. Only joins and minima on keys: a hub's links are folded
    before they are shuffled, nothing is gathered.

    known: components that other links gave; then the components of both, of the nodes in known or links.
    """
    rounds, made = [] if known is None else [known], []
    if known is not None:
        links = _between(links, known)
    while True:
        both = durable(links.select("a", "b").where("a <> b").union(links.select("b", "a").where("a <> b")).distinct(), "links")
        if rounds and both.isEmpty():
            release(both)
            break
        near = durable(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("least")), "near")
        above = near.select(F.col("node").alias("least"), F.col("least").alias("component"))
        labels = durable(near.join(above, "least").select("node", "component"), "labels")
        rounds.append(labels)
        between = durable(_between(both.where("a < b"), labels), "between")
        release(both, near, *([links] if made else []))
        links = between
        made.append(labels)
    release(*([links] if made else []))
    out = rounds.pop()
    while rounds:
        # A label that a later round has is linked on; others stand, and nodes that only later rounds have are added.
        first = rounds.pop()
        later = out.select(F.col("node").alias("label"), F.col("component").alias("last"))
        joined = first.join(later, first["component"] == later["label"], "left").select("node", F.coalesce("last", "component").alias("component"))
        if not rounds and known is not None:
            joined = joined.unionByName(out.join(known.select("node"), "node", "left_anti"))
        out = joined
    whole = durable(out, "components")
    release(*made)
    return whole


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links (a, b) as links between labels (node, component); a node without a label stands for itself."""
    for end in ("a", "b"):
        label = labels.select(F.col("node").alias(end), F.col("component").alias("label"))
        links = links.join(label, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
