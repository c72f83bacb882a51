"""Connected components by alternating large-star and small-star passes.

Every pass is a pair of joins and partial aggregates; its edges are written to
the shared folder, so the lineage stays short and no edge reaches the driver.
A pass leaves at most as many edges as it got, and a chain of n nodes needs
O(log n) passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordchecks.llm.common import store


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of the edges."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node of an edge; root: the component's smallest node."""
    edges = pairs.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a != b").distinct()
    edges = store(edges, "components-0")
    state, n = _state(edges), 0
    while state[0]:
        # large star: each larger neighbour of a node goes to the node's smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        large = store(large, f"components-{n}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        n += 1
        edges, before = store(small, f"components-{n}"), state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
