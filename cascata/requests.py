"""Typed requests of the engine's solvers; arguments are checked when a request is made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import robust, seeding, sketches, transforms, worlds
from .runtime import cut

#: Reachability modes 1 to 6 are ways to compute one value and share one implementation.
MODES = ("DFS_MAX_TREE", "TOPDOWN", "BOTUP", "DYN_BOTUP", "DAGGER", "DAGGER_BITSET")


@dataclass(frozen=True)
class Resilience:
    """Expected largest reach of ``seeds`` roots while nodes are removed in an order."""

    iterations: int = 100
    seeds: int = 1
    blocked: int = -1  # -1: every level (by alpha), else this one
    alpha: float = 1.0
    mode: int = 5
    lt: bool = False
    den: int = 1_000_000

    def __post_init__(self):
        assert 1 <= self.mode <= len(MODES), "mode 0 (largest component) is another measure"
        assert self.alpha >= 1 and self.iterations > 0 and self.seeds > 0

    def series(self, edges: DataFrame, order: DataFrame) -> DataFrame:
        """l, value, sd; edges(src, dst, c), order(node, rank), a permutation of the nodes if every level is asked for."""
        n = order.count()
        if self.blocked < 0:
            ids = transforms.nodes(edges)
            if not ids.join(order, ids["id"] == order["node"], "left_anti").isEmpty():
                raise ValueError("the order must hold every node")
        elif self.blocked >= n:
            raise ValueError(f"{self.blocked} of {n} nodes removed")
        levels = seeding.levels(self.alpha, n) if self.blocked < 0 else [self.blocked]
        live = (worlds.live_lt if self.lt else worlds.live_ic)(edges, self.den, self.iterations)
        reach = robust.greedy_reach(live, order, self.iterations, self.seeds, levels)
        return reach.groupBy("l").agg(F.avg("reach").alias("value"), F.stddev_pop("reach").alias("sd"))

    def value(self, edges: DataFrame, order: DataFrame) -> float:
        """The mean over all levels (sampled levels are interpolated), or the value at the one level asked for."""
        from .functions.analytics import interpolated

        found = self.series(edges, order)
        if self.blocked >= 0:
            return found.first()["value"]
        n = order.count()
        total = interpolated(found.select(F.lit(0).alias("k"), "l", "value"), ["k"]).agg(F.sum("value"), F.max("l"), F.max_by("value", "l")).first()
        return (total[0] + (n - 1 - total[1]) * total[2]) / n


@dataclass(frozen=True)
class InfluenceMaximisation:
    """k seeds of the largest expected spread on the graph without blocked nodes."""

    seeds: int = 2
    epsilon: float = 0.2
    lt: bool = False
    den: int = 1_000_000
    limit: int | None = None  # a sample that has to be larger raises

    def __post_init__(self):
        assert self.epsilon < 1, "epsilon is a share"

    def run(self, edges: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
        """pos, node, gain (sketches newly covered) and sketches."""
        own = transforms.block(edges, blocked) if blocked is not None else edges
        ids = transforms.nodes(edges)
        if blocked is not None:
            ids = ids.join(blocked.select(F.col("node").alias("id")), "id", "left_anti")
        ids, own = cut(ids), cut(own)
        n = ids.count()
        if n <= self.seeds:
            raise ValueError(f"{self.seeds} seeds among {n} nodes")
        model = "lt" if self.lt else "ic"
        picked, r = seeding.imm(lambda first, r: sketches.rr_sets(own, ids, self.den, r, model, first).select("rr_id", "node"), n, self.seeds, self.epsilon, self.limit)
        return edges.sparkSession.createDataFrame([(i, int(v), int(g), r) for i, (v, g) in enumerate(picked)], "pos int, node long, gain long, sketches int")


@dataclass(frozen=True)
class RobustSeeding:
    """One seed set against the worst of several removal sets blocked(strategy, node)."""

    seeds: int = 2
    gamma: float = 0.1
    beta: float = 0.0
    sketches: int = 200
    method: str = "single"  # single, all, saturate, adversarial
    den: int = 1_000_000

    def __post_init__(self):
        assert 0 < self.gamma < 1 and self.method in ("single", "all", "saturate", "adversarial")

    def run(self, edges: DataFrame, blocked: DataFrame) -> tuple[list[int], float]:
        """Seeds and their worst-case expected spread over the strategies."""
        rr, sizes = robust.strategy_sketches(edges, transforms.nodes(edges), blocked, self.den, self.sketches)
        rr = cut(rr)
        least = sizes.agg(F.min("n")).first()[0]
        if least <= self.seeds:
            raise ValueError(f"{self.seeds} seeds among {least} nodes")
        if self.method == "single":
            return seeding.single_greedy(rr, sizes, self.seeds)
        if self.method == "all":
            return seeding.all_greedy(rr, sizes, self.seeds)[1:]
        if self.method == "saturate":
            return seeding.saturate(rr, sizes, self.seeds, self.gamma, self.beta)
        picked = [v for v, _ in seeding.greedy_cover(sketches.worst_case(rr).select("rr_id", "node"), self.seeds)]
        own = edges.sparkSession.createDataFrame([(v,) for v in picked], "node long")
        return picked, seeding.worst_case_objective(seeding.strategy_influence(rr, own, sizes)).first()["objective"]


@dataclass(frozen=True)
class Simulation:
    """Forward simulation of seeds(pos, node); blocked seeds are replaced by later ones where ``seeds`` limits them."""

    iterations: int = 10_000
    seeds: int | None = None
    lt: bool = False
    den: int = 1_000_000

    def __post_init__(self):
        assert self.iterations > 0

    def run(self, edges: DataFrame, seeds: DataFrame, blocked: DataFrame) -> DataFrame:
        """strategy, mean, std of the final number of active nodes for each set of blocked(strategy, node)."""
        names = blocked.select("strategy").distinct()
        own = worlds.replaced_seeds(seeds, blocked, self.seeds) if self.seeds else seeds.crossJoin(F.broadcast(names)).join(blocked.select("strategy", "node").distinct(), ["strategy", "node"], "left_anti")
        live = (worlds.live_lt if self.lt else worlds.live_ic)(edges, self.den, self.iterations)
        active = worlds.simulate(cut(worlds.without_blocked(live, blocked)), own.select("strategy", "node"), self.iterations, ["strategy"])
        return worlds.spread(active, ["strategy"], self.iterations)

    def worst(self, found: DataFrame) -> DataFrame:
        """The strategy with the smallest mean: strategy, mean, std."""
        return found.agg(F.min_by(F.struct("strategy", "mean", "std"), F.struct("mean", "strategy")).alias("w")).select("w.*")


def sketch_error(simulated: float, estimated: float) -> float:
    """Relative difference of a sketch estimate from a simulation; above 0.065 more sketches are advised."""
    return abs(simulated - estimated) / simulated if simulated else 0.0
