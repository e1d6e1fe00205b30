"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _sum(df: DataFrame, col: str):
    return df.agg(F.sum(F.col(col).cast("decimal(38,0)")).alias("s")).first()["s"]


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``a``, ``b``); component: the least node reachable.

    Each round every node hooks onto the least of itself and its neighbours, the trees so made are flattened by jumping
    to the label's label, and the links are rewritten to the trees' roots: links within a tree go, repeated ones become
    one. At least half of the nodes that still have a link vanish in a round, so a group of many copies shrinks to one
    node at once and the number of rounds grows with the logarithm of the longest chain.

    Labels and links are tables in the shared folder: a step starts from files, not from a growing lineage. Both sides
    of each join are dealt out by the join itself, so that a hub can be split among tasks. Only sums and counts reach
    the driver. Links of a node to itself and repeated links do no harm; NULL ends are ignored. No links: no rows.
    """
    links = scratch.put(edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), f"{name}-links-0")
    total, k = None, 0
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), f"{name}-{k}-0")
        jump, size = 0, _sum(labels, "component")
        while True:
            up = labels.select(F.col("node").alias("at"), F.col("component").alias("top"))
            jump += 1
            new = scratch.put(labels.join(up, labels["component"] == up["at"]).select("node", F.col("top").alias("component")), f"{name}-{k}-{jump}")
            scratch.drop(f"{name}-{k}-{jump - 1}")
            labels, old, size = new, size, _sum(new, "component")
            if size == old:  # labels only fall, so an equal sum means that none has
                break
        if total is None:
            total = labels
        else:
            up = labels.select(F.col("node").alias("at"), F.col("component").alias("top"))
            joined = total.join(up, total["component"] == up["at"], "left")
            total = scratch.put(joined.select("node", F.coalesce("top", "component").alias("component")), f"{name}-total-{k}")
        ends = [labels.select(F.col("node").alias(f"{c}_"), F.col("component").alias(f"{c}_top")) for c in "ab"]
        moved = links.join(ends[0], links["a"] == F.col("a_")).join(ends[1], links["b"] == F.col("b_")).filter("a_top <> b_top")
        links = scratch.put(moved.select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).distinct(), f"{name}-links-{k + 1}")
        scratch.drop(f"{name}-links-{k}")
        k += 1
        if not links.limit(1).count():
            return total
