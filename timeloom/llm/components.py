"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import cut

#: A node that has more than 1 / HEAVY of all edges is heavy; there are at most 2 * HEAVY such nodes, which bounds what is broadcast.
HEAVY = 2000


def _with_least(edges: DataFrame, limit: int) -> DataFrame:
    """edges (u, v) with m, the least of u and its neighbours.

    The least is a sum per key, combined before it is shuffled. Edges of heavy nodes get it by broadcast and stay where they are; only the others meet it by a join.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    heavy = least.where(F.col("n") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(heavy), F.col("u") == F.col("hub"), "left")
    of_hubs = marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m"))
    return of_hubs.unionByName(marked.where("hub is null").select("u", "v").join(least.where(F.col("n") <= limit).select("u", "m"), "u").select("u", "v", "m"))


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for each node of edges (u, v): component is the least node reachable.

    Large-star and small-star steps in turn until nothing changes: every node's edges are turned to its least neighbour, first to larger neighbours, then to smaller.
    An edge of a node with itself says nothing; edges may repeat; without edges there are no rows.
    """
    flat = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    before = flat.agg(*mark).first()
    for _ in range(most_rounds):
        if not before["n"]:
            break
        limit = max(1, 2 * before["n"] // HEAVY)
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_with_least(both, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = _with_least(large, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        flat = cut(small.unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct())
        after = flat.agg(*mark).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components didn't settle")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
