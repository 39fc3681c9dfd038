"""Condensation of strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def condensed(edges: DataFrame, scc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scc_edges(src, dst, multiplicity) between different components of scc(node, scc), and sizes(scc, size)."""
    one = edges.join(scc.select(F.col("node").alias("src"), F.col("scc").alias("s")), "src")
    two = one.join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("d")), "dst")
    between = two.filter("s <> d").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.count(F.lit(1)).alias("multiplicity"))
    return between, scc.groupBy("scc").agg(F.count(F.lit(1)).alias("size"))


def is_acyclic(edges: DataFrame) -> bool:
    """Whether removing nodes without an edge in, again and again, removes every edge."""
    live = cut(edges.select("src", "dst").distinct())
    while True:
        n = live.count()
        if n == 0:
            return True
        live = cut(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if live.count() == n:
            return False
