"""Possible worlds: live edges under Independent Cascade and Linear Threshold, and forward simulation.

Edges carry an integer ``c``; the activation probability is min(c, den) / den.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..coins import SIDES, happens, u32
from ..runtime import cut
from .fixpoint import reach


def worlds(edges: DataFrame, n: int, name: str = "world") -> DataFrame:
    """Every row once per world 0..n-1."""
    return edges.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def live_ic(edges: DataFrame, den: int, n: int, tag: str = "ic", name: str = "world") -> DataFrame:
    """world, src, dst of the live edges: one coin per edge and world."""
    return worlds(edges.select("src", "dst", "c"), n, name).filter(happens(u32(tag, "src", "dst", name), F.col("c"), den)).select(name, "src", "dst")


def lt_bounds(edges: DataFrame, den: int) -> DataFrame:
    """src, dst, lo, hi, den: the draws of dst that pick the edge; in-weights that sum to more than one are scaled to one."""
    order = Window.partitionBy("dst").orderBy("src")
    total = F.sum("c").over(Window.partitionBy("dst"))
    return edges.select("src", "dst", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lo"), F.sum("c").over(order).alias("hi"), F.greatest(total, F.lit(den)).alias("den"))


def lt_picks(tag: str, node: str, name: str):
    """Whether the node picks an edge of lt_bounds() in a world."""
    draw = u32(tag, node, name) * F.col("den")
    return (draw >= F.col("lo") * SIDES) & (draw < F.col("hi") * SIDES)


def live_lt(edges: DataFrame, den: int, n: int, tag: str = "lt", name: str = "world") -> DataFrame:
    """world, src, dst: every node picks at most one in-edge, in proportion to its weight.

    One draw per node and world on the whole graph, made before the draw meets the node's in-edges.  A world
    serves every number of blocked nodes: a pick of a blocked node is no edge.
    """
    bounds = lt_bounds(edges, den)
    draws = worlds(edges.select(F.col("dst").alias("v")).distinct(), n, name).select("v", name, u32(tag, "v", name).alias("_draw"))
    value = F.col("_draw") * F.col("den")
    picked = (F.col("v") == F.col("dst")) & (value >= F.col("lo") * SIDES) & (value < F.col("hi") * SIDES)
    return bounds.join(draws, picked).select(name, "src", "dst")


def without_blocked(live: DataFrame, blocked: DataFrame) -> DataFrame:
    """live(world, src, dst) for every set of blocked(strategy, node): same worlds, common coins."""
    strategies = blocked.select("strategy").distinct()
    b = blocked.select("strategy", "node").distinct()
    every = live.crossJoin(strategies)
    out = every.join(b, (every["strategy"] == b["strategy"]) & (every["src"] == b["node"]), "left_anti")
    return out.join(b, (out["strategy"] == b["strategy"]) & (out["dst"] == b["node"]), "left_anti")


def replaced_seeds(seeds: DataFrame, blocked: DataFrame, k: int) -> DataFrame:
    """strategy, pos, node: the first k of seeds(pos, node) that a strategy has not blocked."""
    every = seeds.crossJoin(blocked.select("strategy").distinct())
    left = every.join(blocked.select("strategy", "node").distinct(), ["strategy", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy("pos"))
    return left.withColumn("rank", rank).filter(F.col("rank") <= k).select("strategy", "pos", "node")


def simulate(live: DataFrame, seeds: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """keys, world, node, depth of everything activated from seeds(keys, node) in each of n worlds."""
    keys = keys or []
    start = worlds(seeds.select(*keys, "node").distinct(), n)
    # the live edges are drawn once, not in every round
    return reach(start, cut(live), [*keys, "world"])


def spread(active: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, mean and population deviation of the number of active nodes over n worlds."""
    per = active.groupBy(*keys, "world").agg(F.count(F.lit(1)).alias("k"))
    total, square = F.sum("k"), F.sum(F.col("k") * F.col("k"))
    return per.groupBy(*keys).agg((total / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square / n - (total / n) * (total / n))).alias("std"))
