"""Resilience over removal orders: one max-min closure serves every number of removed nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from . import kernels
from .fixpoint import bottleneck, reach
from .sketches import backward, roots
from .worlds import live_ic, live_lt, simulate, without_blocked
from .worlds import worlds as every_world


def closure(live: DataFrame, order: DataFrame, n_worlds: int) -> DataFrame:
    """world, s, v, b: v is reachable from s with the first l nodes of order(node, rank) gone exactly if b >= l."""
    sources = every_world(order.select("node", "rank"), n_worlds)
    ranked = live.join(order.select(F.col("node").alias("dst"), "rank"), "dst")
    return bottleneck(sources, cut(ranked), ["world"])


def reach_counts(pairs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, s, l, reach: nodes with b >= l, from the histogram of b and a suffix sum, for l = 0..n-1."""
    hist = pairs.groupBy(*keys, "s", "b").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy(*keys, "s").orderBy("b")
    spans = hist.select(
        *keys, "s", "b",
        (F.coalesce(F.lag("b").over(order), F.lit(-1)) + 1).alias("first"),
        F.sum("k").over(Window.partitionBy(*keys, "s").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)).alias("reach"),
    )
    return spans.select(*keys, "s", F.explode(F.sequence("first", "b")).alias("l"), "reach").filter(F.col("l") < n)


def sequence(pairs: DataFrame, n: int, n_worlds: int) -> DataFrame:
    """l, sum_max_reach, avg_max_reach: the largest reach of one node, summed and averaged over the worlds."""
    top = reach_counts(pairs, ["world"], n).groupBy("world", "l").agg(F.max("reach").alias("k"))
    return top.groupBy("l").agg(F.sum("k").alias("sum_max_reach"), (F.sum("k") / F.lit(float(n_worlds))).alias("avg_max_reach"))


def relational_reach(live: DataFrame, order: DataFrame, n_worlds: int, k: int, levels: list[int]) -> DataFrame:
    """world, l, reach: nodes that k greedily picked roots reach, at chosen levels; all worlds and levels advance together."""
    at = F.array(*[F.lit(v) for v in levels])
    pairs = closure(live, order, n_worlds).select("world", "s", "v", F.explode(F.filter(at, lambda x: x <= F.col("b"))).alias("l"))
    left, gains = cut(pairs), []
    for _ in range(k):
        best = left.groupBy("world", "l", "s").agg(F.count(F.lit(1)).alias("k")).groupBy("world", "l").agg(F.max(F.struct("k", "s")).alias("b"))
        best = cut(best.select("world", "l", "b.s", "b.k"))
        gains.append(best.select("world", "l", "k"))
        covered = left.join(best.select("world", "l", "s"), ["world", "l", "s"]).select("world", "l", "v")
        left = cut(left.join(covered, ["world", "l", "v"], "left_anti"))
    return reduce(DataFrame.union, gains).groupBy("world", "l").agg(F.sum("k").alias("reach"))


def greedy_reach(live: DataFrame, order: DataFrame, n_worlds: int, k: int, levels: list[int]) -> DataFrame:
    """world, l, reach of k greedily picked roots: by the grouped kernel, or by relational rounds where a world does not fit it."""
    if order.count() > kernels.MAX_NODES:
        return relational_reach(live, order, n_worlds, k, levels)
    if k > 1:
        return kernels.greedy_reach(live, order, n_worlds, k, levels)
    return kernels.max_reach(live, order, n_worlds).select("world", "l", F.col("max_reach").alias("reach")).filter(F.col("l").isin(levels))


def saved_nodes(live: DataFrame, seeds: DataFrame, blocked: DataFrame, n: int, base: str) -> DataFrame:
    """strategy, activated, var_activated, saved, fraction_saved, against the strategy ``base`` in the same worlds."""
    names = blocked.select("strategy").distinct()
    start = seeds.crossJoin(names).join(blocked.select("strategy", "node").distinct(), ["strategy", "node"], "left_anti")
    active = simulate(cut(without_blocked(live, blocked)), start, n, ["strategy"])
    k = every_world(names, n).join(active.groupBy("strategy", "world").agg(F.count(F.lit(1)).alias("k")), ["strategy", "world"], "left").na.fill(0, ["k"])
    zero = k.filter(F.col("strategy") == base).select("world", F.col("k").alias("z"))
    both = k.join(zero, "world").withColumn("s", F.col("z") - F.col("k"))
    return both.groupBy("strategy").agg(F.avg("k").alias("activated"), F.var_samp("k").alias("var_activated"), F.avg("s").alias("saved"), F.avg(F.col("s") / F.col("z")).alias("fraction_saved"))


def strategy_sketches(edges: DataFrame, nodes: DataFrame, blocked: DataFrame, den: int, n: int, model: str = "ic") -> tuple[DataFrame, DataFrame]:
    """rr(strategy, rr_id, node) on every strategy's blocked graph, and sizes(strategy, n, r).

    Coins and roots are common; a sketch whose root is blocked does not count for the strategy, which
    leaves its roots uniform over the nodes that are left.
    """
    names = blocked.select("strategy").distinct()
    gone = blocked.select("strategy", "node").distinct()
    back, alive = backward(edges, den, model)
    start = cut(roots(nodes, n).crossJoin(names).join(gone, ["strategy", "node"], "left_anti"))
    rr = reach(start, back, ["strategy", "rr_id"], [], alive, gone).select("strategy", "rr_id", "node")
    left = nodes.select(F.col("id").alias("node")).crossJoin(names).join(gone, ["strategy", "node"], "left_anti").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    r = start.groupBy("strategy").agg(F.count(F.lit(1)).alias("r"))
    return rr, names.join(left, "strategy", "left").join(r, "strategy", "left").na.fill(0, ["n", "r"])


def dynamic_influence(edges: DataFrame, nodes: DataFrame, order: DataFrame, den: int, n: int, levels: list[int], k: int = 1, model: str = "ic") -> DataFrame:
    """l, pos, node, influence: the k seeds that greedy covering picks at each level, from one set of bottleneck sketches.

    b is the largest l at which the node still reaches the root; a sketch counts at levels up to its
    root's rank.  Influence is that of the seeds so far: (n - l) * covered / sketches whose root is left.
    All levels advance together, a seed in each round.
    """
    total = nodes.count()
    live = (live_ic if model == "ic" else live_lt)(edges, den, n, f"rr{model}", "rr_id")
    back = live.join(order.select(F.col("node").alias("src"), "rank"), "src").select("rr_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "rank")
    start = cut(roots(nodes, n).join(order, "node"))
    pairs = bottleneck(start, cut(back), ["rr_id"])
    at = F.array(*[F.lit(v) for v in levels])
    open_ = pairs.select("rr_id", F.col("v").alias("node"), F.explode(F.filter(at, lambda x: x <= F.col("b"))).alias("l"))
    picks = []
    for pos in range(k):
        open_ = cut(open_) if k > 1 else open_
        gains = open_.groupBy("l", "node").agg(F.count(F.lit(1)).alias("k"))
        best = gains.groupBy("l").agg(F.max(F.struct("k", "node")).alias("b")).select("l", F.lit(pos).alias("pos"), "b.node", "b.k")
        picks.append(cut(best) if k > 1 else best)
        if pos + 1 < k:
            covered = open_.join(picks[-1].select("l", "node"), ["l", "node"]).select("l", "rr_id").distinct()
            open_ = open_.join(covered, ["l", "rr_id"], "left_anti")
    chosen = reduce(DataFrame.union, picks).withColumn("covered", F.sum("k").over(Window.partitionBy("l").orderBy("pos")))
    left = start.select(F.explode(F.filter(at, lambda x: x <= F.col("rank"))).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("r"))
    return chosen.join(left, "l").select("l", "pos", "node", (F.col("covered") * (total - F.col("l")) / F.col("r")).alias("influence"))


def dynamic_worst_case(edges: DataFrame, nodes: DataFrame, orders: DataFrame, den: int, n: int, levels: list[int]) -> DataFrame:
    """l, node, objective: the best single seed against the worst of several orders(strategy, node, rank), by level.

    One bottleneck closure serves all strategies and levels; a seed that a strategy has removed reaches nothing there.
    """
    total = nodes.count()
    names = cut(orders.select("strategy").distinct())
    live = live_ic(edges, den, n, "rric", "rr_id")
    back = live.join(orders.select("strategy", F.col("node").alias("src"), "rank"), "src").select("strategy", "rr_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "rank")
    start = cut(roots(nodes, n).join(orders, "node").select("strategy", "rr_id", "node", "rank"))
    pairs = bottleneck(start, cut(back), ["strategy", "rr_id"])
    at = F.array(*[F.lit(v) for v in levels])
    counts = pairs.select("strategy", F.col("v").alias("node"), F.explode(F.filter(at, lambda x: x <= F.col("b"))).alias("l")).groupBy("l", "strategy", "node").agg(F.count(F.lit(1)).alias("k"))
    left = start.select("strategy", F.explode(F.filter(at, lambda x: x <= F.col("rank"))).alias("l")).groupBy("l", "strategy").agg(F.count(F.lit(1)).alias("r"))
    value = counts.join(left, ["l", "strategy"]).withColumn("i", F.col("k") * (total - F.col("l")) / F.col("r"))
    # a strategy that a candidate is missing from counts as zero
    per = value.groupBy("l", "node").agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("m")).crossJoin(F.broadcast(names.agg(F.count(F.lit(1)).alias("all"))))
    worst = F.when(F.col("m") == F.col("all"), F.col("low")).otherwise(0.0)
    best = per.groupBy("l").agg(F.max(F.struct(F.round(worst, 9).alias("objective"), "node")).alias("b"))
    return best.select("l", "b.node", "b.objective")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
