"""Connected components of an edge table by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmenta.llm.store import drop, stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node it is connected to.

    Each round hangs the larger neighbours of a node on its smallest one (large star), then its smaller ones (small star);
    edges never grow in number beyond twice the input and rounds grow with the logarithm of the longest path. Minima are
    combined before the shuffle, so a node with a third of all edges is no hot key there; they are written as a table of their own,
    so that both sides of the join are plain shuffles and AQE can split a star's centre. The result is a stored table.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "lows")
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        inner = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(inner.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        new = _state(after)
        drop(large, low, now)
        now, old, state = after, state, new
        if new == old:
            roots = now.select(F.col("b").alias("node")).distinct()
            out = stored(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root"))), "roots")
            drop(now)
            return out
