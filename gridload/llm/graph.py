"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.session import discard, written


def _toward_least(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are tied to the least node around it (large star)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _below_least(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are tied to the least of them (small star)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    # edges are distinct, so equal counts and equal xor of hashes mean equal tables
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; ``root`` is its component's least node.

    Edges are longs ``a`` and ``b``. Every round is a written table of at most one row
    per edge; the number of rounds grows with the logarithm of the nodes.
    """
    edges = written(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        larger = _toward_least(edges).filter("a <> b").distinct()
        after = written(_below_least(larger).distinct(), "edges")
        before, state = state, _state(after)
        discard(edges)
        edges = after
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
