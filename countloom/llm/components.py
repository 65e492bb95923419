"""Connected components of a large graph, as alternating large-star and small-star steps.

Everything stays in DataFrames.  Each step is a partially aggregated minimum and a
join with it.  The few nodes with a considerable share of all edges (at most
2 * HOT_SHARE of them by counting) are looked up by a broadcast join, so that no
task gets a hub's edges; their keys are dealt out evenly in the other join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import cut

#: A node is a hub if it has more than one in HOT_SHARE of the directed edges: there are at most HOT_SHARE hubs.
HOT_SHARE = 500
#: ... and at least so many edges.
HOT_LEAST = 2_000


def _with_least(directed: DataFrame, n_edges: int) -> DataFrame:
    """(u, v, m): each directed edge with the least node among u and its neighbours."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HOT_LEAST, 2 * n_edges // HOT_SHARE)
    hubs = F.broadcast(least.filter(hub).select("u", F.col("m").alias("hub_m")))
    marked = directed.join(hubs, "u", "left")
    key = F.when(F.col("hub_m").isNull(), F.col("u")).otherwise(-1 - F.abs(F.col("v")))
    rest = least.filter(~hub).select(F.col("u").alias("k"), "m")
    return marked.withColumn("k", key).join(rest, "k", "left").select("u", "v", F.coalesce("hub_m", "m").alias("m"))


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that an edge names; component: its least node.

    Nodes are integers.  Self-loops, repeated edges and null ends are
    harmless; without edges the result is empty.
    """
    edges = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a is not null and b is not null")
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (sums.n, sums.s) == state or not sums.n:
            break
        state = sums.n, sums.s
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")
        large = _with_least(both, sums.n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.unionAll(now.filter("u = v")).distinct())
        # small star: hang a node's smaller neighbours, and the node, under the least of them
        small = _with_least(large.filter("u > v"), sums.n)
        small = small.select("u", F.col("m").alias("v")).unionAll(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(small.unionAll(large.filter("u = v")).distinct())
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
