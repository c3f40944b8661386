"""Connected components of an undirected edge list.

Alternating large-star / small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014): every round joins each edge
with the smallest neighbour of its end points, so path lengths shrink
geometrically and the loop ends after O(log^2 n) rounds, when the edge set no
longer changes. There is no round limit that could return unfinished labels.

Each round is written to a table in the shared checkpoint folder, so lineage
stays short and a lost executor costs one round at most. Only the edge count
and a checksum come to the driver. A hot node (a star with a third of all
edges) is one key of a sort-merge join whose other side has one row per node,
which adaptive execution may split; its minimum is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _signature(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).head()
    return r[0], r[1] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .filter("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def component_labels(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node;
    ``component`` is the smallest node reachable. Self loops, repeated edges
    and null ends are ignored; an empty edge list gives an empty result."""
    cur = stored(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
                 .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") != F.col("b")))
                 .distinct(), "components")
    seen = _signature(cur)
    while seen[0]:
        cur = stored(_small_star(_large_star(cur)), "components")
        now = _signature(cur)
        if now == seen:
            break
        seen = now
    low = cur.groupBy("a").agg(F.min("b").alias("component"))
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return low.select(F.col("a").alias("node"), "component").unionByName(roots)
