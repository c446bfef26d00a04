"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectic.llm.frames import stored


def _contract(pairs: DataFrame, name: str) -> DataFrame:
    """``pairs`` (u, v): link every ``v`` to the smallest of u's neighbours and
    u itself. The minima are written first, so that the join reads two fresh
    shuffles and a node with very many neighbours can be split."""
    low = stored(pairs.groupBy("u").agg(F.min("v").alias("low"))
                 .select("u", F.least("u", "low").alias("low")), f"{name}-low")
    return pairs.join(low, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is the
    smallest node that can be reached.

    Large-star links each larger neighbour to the smallest neighbour, small-star
    does so among the smaller ones; both keep the components and in a few
    rounds only stars are left. Each round is written to the shared folder.
    Null ends and loops are ignored; no edges give no rows.
    """
    e = (edges.filter("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = stored(e, "cc-edges")
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_contract(both, "cc-large").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("low").alias("v")))
        large = stored(large, "cc-large")  # one row per row of e; the round's end drops repeats
        small = _contract(large, "cc-small")
        small = (small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .union(small.select("u", F.col("low").alias("v"))).distinct())
        e = stored(small, "cc-round")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
