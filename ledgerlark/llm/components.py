"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import stored


def _stars(pairs: DataFrame, both: bool) -> DataFrame:
    """Point every neighbour of a node (only the larger ones if *both*) at the smallest node around it."""
    around = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else pairs
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    turned = around.join(least.hint("merge"), "a")  # files of edges are several times smaller than what a broadcast of them gathers
    if both:
        out = turned.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = turned.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of *edges* (two whole-number columns ``a, b``).

    The component is its smallest node.  Nulls and loops link nothing; repeated edges count
    once; an empty table gives an empty table.  A hub is never gathered: its smallest
    neighbour is an aggregate, and the join back to its edges can be split.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(edges)
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.count_distinct("a").alias("k")).first()
        if state["n"] == state["k"] and now.join(now.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi").isEmpty():
            break
        now = stored(_stars(_stars(now, both=True), both=False))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
