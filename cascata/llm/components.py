"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_fewer_files


#: Parts that a node's edges are dealt out in when they meet the node's smallest neighbour.
PARTS = 4
#: Shuffle partitions to a file of a round's edges, and the fewest files.
BY, FILES = 32, 6


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges(u, v) with the m of least(u, m); a hub's edges are spread over PARTS keys."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    every = least.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return dealt.join(every, ["u", "part"]).select("u", "v", "m")


def _largest(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours now point to its smallest neighbour (or to itself)."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _with_least(both.filter("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _smallest(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours now point to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _with_least(down, least).select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, root: every node that has an edge with the smallest node it can reach.

    ``edges`` has two columns of one orderable type.  Alternates the large-star and small-star steps until
    the edge set stays the same; each round's edges are checkpointed in the shared folder, so a lost
    executor costs a round at most, and a long chain takes a logarithmic number of rounds.
    """
    now = cut(in_fewer_files(edges.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), BY, FILES))
    state = None
    for _ in range(max_rounds):
        now = cut(in_fewer_files(_smallest(_largest(now)).filter("a <> b").distinct(), BY, FILES))
        before, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
