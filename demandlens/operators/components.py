"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined_min(edges: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The component of every node of an undirected edge list.

    edges has two columns (u, v) of one type that can be ordered; loops, repeats and both directions are allowed, rows with a null are
    ignored. Returns (node, root): root is the least node that is reachable. An empty list gives no rows.
    Each round is checkpointed, so that a lost executor costs one round at most; the rows are two ids wide, and rounds stay equally short.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _joined_min(large)
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        now = small.select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1000003).alias("s")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
