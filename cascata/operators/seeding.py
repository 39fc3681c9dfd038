"""Seed selection: greedy coverage, sample sizes of influence maximisation, robust (worst-case) selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def greedy_cover(rr: DataFrame, k: int, reward: DataFrame | None = None) -> list[tuple[int, float]]:
    """(node, gain) of k greedy rounds over rr(rr_id, node); ties go to the larger node.

    Each round sums the reward (1 without ``reward``) of the sketches that are not covered yet by node;
    what reaches the driver is one row a round.
    """
    left = rr.select("rr_id", "node").distinct()
    left = left.join(reward, "rr_id") if reward is not None else left.withColumn("reward", F.lit(1))
    left, picked = cut(left), []
    for _ in range(k):
        best = left.groupBy("node").agg(F.sum("reward").alias("gain")).agg(F.max(F.struct("gain", "node")).alias("b")).first()["b"]
        if best is None:
            break
        picked.append((best["node"], best["gain"]))
        covered = left.filter(F.col("node") == best["node"]).select("rr_id").distinct()
        left = cut(left.join(covered, "rr_id", "left_anti"))
    return picked


def log_choose(n: int, k: int) -> float:
    """ln C(n, k)."""
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def imm_round_size(n: int, k: int, epsilon: float, x: int) -> float:
    """Sketches of doubling round x, with the published constants."""
    e = math.sqrt(2) * epsilon
    return (2 + 2 / 3 * e) * (math.log(n) + log_choose(n, k) + math.log(max(1.0001, math.log2(n)))) * 2**x / e**2


def imm_final_size(n: int, k: int, epsilon: float, opt: float) -> float:
    """Sketches of the final round, from a lower bound of the optimum."""
    alpha = math.sqrt(math.log(n) + math.log(2))
    beta = math.sqrt((1 - 1 / math.e) * (log_choose(n, k) + math.log(n) + math.log(2)))
    return 2 * n * ((1 - 1 / math.e) * alpha + beta) ** 2 / (opt * epsilon**2)


def imm(sample, n: int, k: int, epsilon: float = 0.2, limit: int | None = None) -> tuple[list[tuple[int, float]], int]:
    """Influence maximisation: double the sample until the covered share proves a bound, then size the last one.

    ``sample(first, r)`` returns rr(rr_id, node) of the sketches first to r - 1; sketches are pure functions
    of their id, so each round draws only those that it adds.  The guarantee needs all sketches that the
    bounds ask for, so a sample that would exceed ``limit`` raises.
    """
    rr, have = None, 0

    def grown(r: int) -> DataFrame:
        nonlocal rr, have
        if limit is not None and r > limit:
            raise ValueError(f"{r} sketches are needed, more than the limit of {limit}")
        if r > have:
            more = cut(sample(have, r))
            rr, have = more if rr is None else rr.union(more), r
        return rr.filter(F.col("rr_id") < r)

    opt = 1.0
    for x in range(1, max(2, int(math.log2(n)) + 1)):
        r = int(imm_round_size(n, k, epsilon, x)) + 1
        share = sum(g for _, g in greedy_cover(grown(r), k)) / r
        if share > 2.0**-x:
            opt = max(1.0, share * n / (1 + math.sqrt(2) * epsilon))
            break
    r = int(imm_final_size(n, k, epsilon, opt)) + 1
    return greedy_cover(grown(r), k), r


def levels(alpha: float, n: int) -> list[int]:
    """Geometric sample of removal counts: 0, then steps of floor(alpha), floor(alpha ** 2), ..., below n."""
    out, step, at = [], alpha, 0
    while at < n:
        out.append(at)
        at += max(1, math.floor(step))
        step *= alpha
    return out


def strategy_influence(rr: DataFrame, seeds: DataFrame, sizes: DataFrame) -> DataFrame:
    """strategy, influence of seeds(node) on each strategy's own sketches rr(strategy, rr_id, node).

    sizes(strategy, n, r): nodes that are left and sketches.  A strategy without a covered sketch has 0,
    and one without any sketch null.
    """
    hit = rr.join(seeds.select("node").distinct(), "node", "left_semi").groupBy("strategy").agg(F.count_distinct("rr_id").alias("covered"))
    return sizes.join(hit, "strategy", "left").select("strategy", F.try_divide((F.coalesce("covered", F.lit(0)) * F.col("n")).cast("double"), F.col("r").cast("double")).alias("influence"))


def worst_case_objective(by_strategy: DataFrame, norm: str | None = None) -> DataFrame:
    """objective: least influence over the strategies, divided by the column ``norm`` if given."""
    value = F.col("influence") / F.col(norm) if norm else F.col("influence")
    return by_strategy.agg(F.min(value).alias("objective"))


def truncated_sum(by_strategy: DataFrame, c: float) -> DataFrame:
    """total: sum over the strategies of min(c, influence)."""
    return by_strategy.agg(F.sum(F.least(F.lit(c), F.col("influence"))).alias("total"))


class Coverage:
    """Incremental coverage state of a robust objective: which sketches of each strategy are covered.

    Candidates are evaluated all at once in each round: gain by (candidate, strategy) is one aggregate.
    """

    def __init__(self, rr: DataFrame, sizes: DataFrame):
        self.left = cut(rr.select("strategy", "rr_id", "node").distinct())
        self.weight = {r["strategy"]: (r["n"] / r["r"] if r["r"] else 0.0) for r in sizes.collect()}  # one row per strategy
        self.value = dict.fromkeys(self.weight, 0.0)
        self.seeds: list[int] = []

    def candidates(self) -> DataFrame:
        """node and, per strategy, the value that the objective's terms would have with it."""
        gains = self.left.groupBy("node").pivot("strategy", sorted(self.weight)).agg(F.count(F.lit(1)))
        after = [(F.lit(self.value[s]) + F.coalesce(F.col(f"`{s}`"), F.lit(0)) * self.weight[s]).alias(f"v{i}") for i, s in enumerate(sorted(self.weight))]
        return gains.select("node", *after)

    def add(self, node: int) -> None:
        covered = self.left.filter(F.col("node") == node).select("strategy", "rr_id").distinct()
        gained = {r["strategy"]: r["n"] for r in covered.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).collect()}
        for s, g in gained.items():
            self.value[s] += g * self.weight[s]
        self.left = cut(self.left.join(covered, ["strategy", "rr_id"], "left_anti"))
        self.seeds.append(node)

    def best(self, score) -> tuple[float, int] | None:
        """(value, node) of the candidate with the largest ``score(columns)``; ties go to the larger node."""
        terms = [F.col(f"v{i}") for i in range(len(self.weight))]
        row = self.candidates().agg(F.max(F.struct(score(terms).alias("s"), F.col("node"))).alias("b")).first()["b"]
        return None if row is None else (row["s"], row["node"])


def _least(terms):
    return F.least(*terms) if len(terms) > 1 else terms[0]


def single_greedy(rr: DataFrame, sizes: DataFrame, k: int) -> tuple[list[int], float]:
    """k rounds of the largest worst case; ties by the larger sum, then the larger node."""
    state = Coverage(rr, sizes)
    for _ in range(k):
        terms = [F.col(f"v{i}") for i in range(len(state.weight))]
        row = state.candidates().agg(F.max(F.struct(_least(terms).alias("s"), sum(terms[1:], terms[0]).alias("t"), F.col("node"))).alias("b")).first()["b"]
        if row is None:
            break
        state.add(row["node"])
    return state.seeds, min(state.value.values())


def all_greedy(rr: DataFrame, sizes: DataFrame, k: int) -> tuple[str, list[int], float]:
    """Each strategy's own greedy seeds, judged by the worst case; ties go to the strategy first by name."""
    best = None
    for strategy in sorted(r["strategy"] for r in sizes.select("strategy").collect()):
        seeds = [v for v, _ in greedy_cover(rr.filter(F.col("strategy") == strategy), k)]
        own = rr.sparkSession.createDataFrame([(v,) for v in seeds], "node long")
        value = worst_case_objective(strategy_influence(rr, own, sizes)).first()["objective"]
        if best is None or (value or 0.0) > (best[2] or 0.0):
            best = (strategy, seeds, value)
    return best


def saturate(rr: DataFrame, sizes: DataFrame, k: int, gamma: float = 0.1, beta: float = 0.0) -> tuple[list[int], float]:
    """Bisection on the level c that all strategies can reach, with greedy cover of the truncated sum.

    At most beta * k seeds (beta = 1 + ln(strategies) + ln(3 / gamma) if not given).  The seed set of each
    step starts empty.
    """
    table = sizes.collect()
    top = min(r["n"] for r in table)
    most = min(math.ceil((beta or 1 + math.log(len(table)) + math.log(3 / gamma)) * k), max(1, top - 1))
    low, high, best = 0.0, 1.0, ([], 0.0)
    while high - low > gamma:
        c = (low + high) / 2
        state = Coverage(rr, sizes)
        scale = {s: 1.0 / next(r["n"] for r in table if r["strategy"] == s) for s in state.weight}
        names = sorted(state.weight)
        score = lambda terms, c=c: sum((F.least(F.lit(c), t * scale[s]) for s, t in zip(names[1:], terms[1:])), F.least(F.lit(c), terms[0] * scale[names[0]]))  # noqa: E731, B023
        value = lambda state=state, c=c: sum(min(c, state.value[s] * scale[s]) for s in names)  # noqa: E731, B023
        while value() < c * (len(names) - gamma / 3) and len(state.seeds) < most:
            found = state.best(score)
            if found is None:
                break
            state.add(found[1])
        if value() >= c * (len(names) - gamma / 3):
            low, best = c * (1 - gamma / 3), (state.seeds, min(state.value.values()))
        else:
            high = c
    return best
