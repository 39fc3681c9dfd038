"""Searches over graphs: degree-preserving rewiring and greedy removal orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..coins import u32
from ..runtime import cut, numbered
from .statistics import degrees


def _proposed(edges: DataFrame, tag: str) -> DataFrame:
    """k, a, b, c, d: disjoint random pairs of edges (a, b), (c, d) that may become (a, d), (c, b)."""
    order = numbered(edges.select("src", "dst").withColumn("_u", u32(tag, "src", "dst")), [F.col("_u"), F.col("src"), F.col("dst")], "i")
    half = order.withColumn("k", F.floor(F.col("i") / 2).cast("long"))
    one = half.filter("i % 2 = 0").select("k", F.col("src").alias("a"), F.col("dst").alias("b"))
    two = half.filter("i % 2 = 1").select("k", F.col("src").alias("c"), F.col("dst").alias("d"))
    return one.join(two, "k").filter("a <> d AND c <> b AND a <> c AND b <> d")


def _feasible(swaps: DataFrame, edges: DataFrame) -> DataFrame:
    """Swaps whose new edges neither exist nor are proposed twice (the first by k wins)."""
    new = swaps.select("k", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("d").alias("dst")), F.struct(F.col("c").alias("src"), F.col("b").alias("dst")))).alias("e")).select("k", "e.*")
    taken = new.join(edges.select("src", "dst"), ["src", "dst"], "left_semi").select("k")
    first = new.groupBy("src", "dst").agg(F.min("k").alias("first"))
    late = new.join(first, ["src", "dst"]).filter("k > first").select("k")
    return swaps.join(taken.union(late).distinct(), "k", "left_anti")


def _swapped(edges: DataFrame, swaps: DataFrame) -> DataFrame:
    gone = swaps.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(swaps.select("c", "d"))
    new = swaps.select(F.col("a").alias("src"), F.col("d").alias("dst")).union(swaps.select("c", "b"))
    return edges.select("src", "dst").join(gone, ["src", "dst"], "left_anti").union(new)


def improve_assortativity(edges: DataFrame, swaps: int, rounds: int = 50, tag: str = "rewire") -> DataFrame:
    """src, dst after up to ``swaps`` degree-preserving exchanges that each raise the assortativity.

    Degrees stay, so an exchange helps exactly if it raises the sum over edges of out-degree times
    in-degree, which takes its four ends alone; each round tests all disjoint pairs of a random pairing.
    """
    d = cut(degrees(edges))
    x, y = d.select(F.col("node"), F.col("out_degree").alias("deg")), d.select(F.col("node"), F.col("in_degree").alias("deg"))
    now, left = cut(edges.select("src", "dst").distinct()), swaps
    for k in range(rounds):
        if left <= 0:
            break
        found = _proposed(now, f"{tag}{k}")
        for name, side in (("a", x), ("c", x), ("b", y), ("d", y)):
            found = found.join(side.select(F.col("node").alias(name), F.col("deg").alias(f"{name}_deg")), name)
        better = found.filter("a_deg * d_deg + c_deg * b_deg > a_deg * b_deg + c_deg * d_deg").select("k", "a", "b", "c", "d")
        good = cut(_feasible(better, now).orderBy("k").limit(left))
        n = good.count()
        now, left = cut(_swapped(now, good)), left - n
    return now


def climb(edges: DataFrame, score: Callable[[DataFrame], float], patience: int, tag: str = "climb") -> tuple[DataFrame, float]:
    """Random exchanges one at a time, each kept if ``score`` rises; ends after ``patience`` failures in a row."""
    now = cut(edges.select("src", "dst").distinct())
    best, failures, k = score(now), 0, 0
    while failures < patience:
        one = cut(_feasible(_proposed(now, f"{tag}{k}"), now).orderBy("k").limit(1))
        k += 1
        tried = cut(_swapped(now, one))
        value = score(tried)
        if value > best:
            now, best, failures = tried, value, 0
        else:
            failures += 1
    return now, best


def greedy_removal(nodes: list[int], score: Callable[[list[int]], float], steps: int) -> list[tuple[int, float]]:
    """(node, score) of removals that each leave the best-scoring rest; ``score`` takes the nodes removed so far."""
    gone: list[int] = []
    out = []
    for _ in range(min(steps, len(nodes))):
        best = max(((score([*gone, v]), -v) for v in nodes if v not in gone))
        out.append((-best[1], best[0]))
        gone.append(-best[1])
    return out
