"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: A node with more than its share of all ends of edges (one in HOT_SHARE, and HOT_LEAST of them) is hot: there are fewer than HOT_SHARE.
HOT_LEAST, HOT_SHARE = 1000, 1000


def _with_least(edges: DataFrame, total: int, scratch: list[DataFrame]) -> DataFrame:
    """edges with m, the least b of the edge's a. Minima are pre-aggregated; those of hot nodes are broadcast to their edges, so
    that no node's neighbours are gathered."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    scratch.append(least)
    large = F.col("n") > max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(least.filter(large).drop("n"))
    rest = edges.join(hot.select("a"), "a", "left_anti").join(least.filter(~large).drop("n"), "a")
    return edges.join(hot, "a").unionByName(rest)


def _large(edges: DataFrame, total: int, scratch: list[DataFrame]) -> DataFrame:
    """Links each greater neighbour of a node to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return _with_least(both, 2 * total, scratch).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small(edges: DataFrame, total: int, scratch: list[DataFrame]) -> DataFrame:
    """Links each node and its lesser neighbours to the least of them."""
    down = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
    scratch.append(down)
    moved = _with_least(down, total, scratch).select("a", F.col("b").alias("c"), "m")
    return moved.select(F.explode(F.array(F.struct(F.col("c").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge to another; root is the least node of its component. edges: a, b.

    Rows that are null or join a node to itself say nothing. Rounds grow with the logarithm of the longest path; each is
    written out, and what it has read is deleted.
    """
    state, mark = written(edges.select("a", "b").filter("a <> b").distinct(), "edges"), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first()
        if now == mark or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        scratch = [state]
        state, mark = written(_small(_large(state, now[0], scratch), now[0], scratch), "edges"), now
        discard(*scratch)
