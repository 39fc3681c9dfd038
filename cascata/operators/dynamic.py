"""Reverse-reachable sketches that follow a graph's changes.

Coins and roots are pure functions of ids, so a sketch changes only if its root does or if it holds the head
of an edge that was inserted, deleted or re-weighted: only such edges are met anew.  All others stay as they
are, and the result equals that of drawing every sketch on the new graph.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .fixpoint import reach
from .seeding import greedy_cover
from .sketches import backward, roots, rr_sets


def changed_heads(old: DataFrame, new: DataFrame) -> DataFrame:
    """node: heads of the edges(src, dst, c) that only one of the graphs has, or that differ in c."""
    a, b = old.select("src", "dst", "c"), new.select("src", "dst", "c")
    return a.subtract(b).union(b.subtract(a)).select(F.col("dst").alias("node")).distinct()


def stale_sketches(rr: DataFrame, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], n: int) -> DataFrame:
    """rr_id of the sketches of rr(rr_id, node) that the change from the old (edges, nodes) to the new may alter."""
    before, after = roots(old[1], n).withColumnRenamed("node", "old"), roots(new[1], n)
    moved = after.join(before, "rr_id", "left").filter(~F.col("node").eqNullSafe(F.col("old"))).select("rr_id")
    return moved.union(rr.join(changed_heads(old[0], new[0]), "node").select("rr_id")).distinct()


def refreshed(rr: DataFrame, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], den: int, n: int, model: str = "ic") -> DataFrame:
    """The n sketches rr(rr_id, node) after the change; only stale ones are drawn again, from their new roots."""
    stale = cut(stale_sketches(rr, old, new, n))
    back, alive = backward(new[0], den, model)
    again = reach(roots(new[1], n).join(stale, "rr_id", "left_semi"), back, ["rr_id"], [], alive)
    return rr.join(stale, "rr_id", "left_anti").union(again.select("rr_id", "node"))


def sketches_for_work(edges: DataFrame, nodes: DataFrame, den: int, beta: float = 32.0, model: str = "ic", first: int = 64) -> tuple[DataFrame, int]:
    """rr(rr_id, node) and their number: as many as it takes to look at beta * (n + m) * log2(n) nodes and in-edges."""
    n, m = nodes.count(), edges.count()
    budget = beta * (n + m) * math.log2(max(2, n))
    degree = cut(edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("d")))
    rr, have, work, want = None, 0, 0, first
    while n and work < budget:
        more = cut(rr_sets(edges, nodes, den, want, model, have).select("rr_id", "node"))
        work += more.join(degree, "node", "left").agg(F.sum(1 + F.coalesce("d", F.lit(0)))).first()[0] or 0
        rr, have = more if rr is None else rr.union(more), want
        want = max(have + 1, min(8 * have, math.ceil(have * budget / max(1, work))))
    return (rr if rr is not None else nodes.sparkSession.createDataFrame([], "rr_id int, node long")), have


class FollowedSketches:
    """Sketches and seeds of a graph that follows change-logs; ``on_change`` is an observer of an IncrementalGraph.

    Weights are rounded to multiples of 1 / den.  With ``beta`` the number of sketches follows from the work
    that they take on the first graph, else it is ``n``.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, den: int = 1_000_000, n: int = 200, beta: float | None = None, model: str = "ic"):
        self.den, self.model = den, model
        self.now = self._scaled(edges), nodes
        if beta is None:
            self.rr, self.n = cut(rr_sets(*self.now, den, n, model).select("rr_id", "node")), n
        else:
            self.rr, self.n = sketches_for_work(*self.now, den, beta, model)

    def _scaled(self, edges: DataFrame) -> DataFrame:
        return cut(edges.select("src", "dst", F.round(F.col("weight") * self.den).cast("long").alias("c")))

    def on_change(self, epoch: int, edges: DataFrame, nodes: DataFrame) -> None:
        new = self._scaled(edges), nodes
        self.rr = cut(refreshed(self.rr, self.now, new, self.den, self.n, self.model))
        self.now = new

    def seeds(self, k: int) -> list[tuple[int, float]]:
        """(node, sketches newly covered) of k seeds on the graph as it is now."""
        return greedy_cover(self.rr, k)
