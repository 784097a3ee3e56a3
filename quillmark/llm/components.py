"""Connected components by alternating stars, as joins and groupings of edges.

Nodes are of any orderable type.  Every node adopts the smallest neighbour it
knows; large-star and small-star steps alternate until the edges no longer
change, which leaves each component as one star around its smallest node.  No
neighbour list is gathered anywhere, and a hub is split: the edges of a node that
has more than a ``1 / HUBS`` of all go to ``SPLITS`` tasks, each with a copy of the
hub's row.  There are at most ``2 * HUBS`` such nodes whatever the graph, so their
list is sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.shared import discard, materialize

HUBS, SPLITS = 200, 64


def _with_least(edges: DataFrame, limit: int) -> DataFrame:
    """``u, v, m`` with m the smallest v of u."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    hubs = F.broadcast(least.where(F.col("degree") > limit).select(F.col("n").alias("hub")))
    split = F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(SPLITS))).cast("int")
    dealt = edges.join(hubs, F.col("u") == F.col("hub"), "left").select("u", "v", split.alias("split"))
    last = F.when(F.col("degree") > limit, SPLITS - 1).otherwise(0)
    copies = least.select("n", "m", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    return dealt.join(copies, (F.col("u") == F.col("n")) & (F.col("split") == F.col("copy"))).select("u", "v", "m")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v); root is the component's smallest node.

    Self-loops, repeated edges and either direction are fine; null ends are
    ignored.  No edges give no rows.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]) or not state["n"]:
            break
        before = (state["n"], state["h"])
        limit = max(1000, state["n"] // HUBS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Every larger neighbour of a node is linked to the node's smallest one.
        large = _with_least(both, limit).where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("m", F.col("u")).alias("v")).distinct()
        large = materialize(large, "large-stars")
        # All smaller neighbours of a node, and itself, are linked to the smallest of them.
        small = _with_least(large, limit).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(
            F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        found = materialize(small, "edges")
        discard(edges)
        discard(large)
        edges = found
    else:
        raise RuntimeError("components did not converge")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
