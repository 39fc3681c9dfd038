"""Synthetic networks as edges(src, dst); randomness comes from keyed coins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..coins import uniform
from ..operators.transforms import assign_weights, both_directions, random_direction


def path(spark: SparkSession, n: int, **_) -> DataFrame:
    """0 -> 1 -> ... -> n-1."""
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def grid(spark: SparkSession, n: int, **_) -> DataFrame:
    """n by n lattice, each neighbour pair once; node = row * n + column."""
    cells = spark.range(n * n)
    right = cells.filter(F.col("id") % n < n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cells.filter(F.col("id") < n * (n - 1)).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst"))
    return right.union(down)


def binomial(spark: SparkSession, n: int, p: float, tag: str = "binomial", **_) -> DataFrame:
    """Directed G(n, p): every ordered pair once, by geometric skips within each row."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for u in pdf["id"]:
                rng = np.random.default_rng([sum(map(ord, tag)), int(u)])
                if p >= 1:
                    rows.append(np.arange(n))
                elif p > 0:
                    k = rng.geometric(p, size=int(n * p + 10 * np.sqrt(n * p) + 20)).cumsum() - 1
                    rows.append(k[k < n])
                else:
                    rows.append(np.zeros(0, int))
            dst = np.concatenate(rows) if rows else np.zeros(0, int)
            src = np.repeat(pdf["id"].to_numpy(), [len(r) for r in rows])
            yield pd.DataFrame({"src": src, "dst": dst})[lambda d: d.src != d.dst]

    return spark.range(n).mapInPandas(run, "src long, dst long")


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, tag: str = "ws", **_) -> DataFrame:
    """Ring of n nodes with k neighbours each; every edge's far end moves with probability p."""
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("d"))
    there = (F.col("src") + F.col("d")) % n
    moved = F.floor(uniform(f"{tag}-to", "src", "d") * n).cast("long")
    dst = F.when(uniform(tag, "src", "d") < p, moved).otherwise(there)
    return ring.select("src", dst.alias("dst")).filter("src <> dst").distinct()


def powerlaw_cluster(spark: SparkSession, n: int, mm: int, p: float, seed: int = 1, **_) -> DataFrame:
    """Preferential attachment with triangle closing; sequential by nature, so one task grows it."""

    def run(_batches):
        import pandas as pd

        rng = np.random.default_rng(seed)
        repeated, adjacent, edges = list(range(mm)), [set() for _ in range(n)], []
        for source in range(mm, n):
            targets: set[int] = set()
            last = None
            while len(targets) < min(mm, source):
                near = [v for v in adjacent[last] if v not in targets and v != source] if last is not None and rng.random() < p else []
                last = int(near[rng.integers(len(near))]) if near else int(repeated[rng.integers(len(repeated))])
                targets.add(last)
            for t in targets:
                adjacent[source].add(t)
                adjacent[t].add(source)
                edges.append((source, t))
                repeated += [source, t]
        yield pd.DataFrame(edges, columns=["src", "dst"]).astype("int64")

    return spark.range(0, 1, 1, 1).mapInPandas(run, "src long, dst long")


def gaussian_random_partition(spark: SparkSession, n: int, s: float, v: float, p_in: float, p_out: float, tag: str = "grp", seed: int = 1, **_) -> DataFrame:
    """Communities of normally distributed sizes (mean s, variance s / v); directed coins inside and between them."""
    rng = np.random.default_rng(seed)
    community, at = [], 0
    while len(community) < n:
        community += [at] * max(1, round(rng.normal(s, np.sqrt(s / v))))
        at += 1
    starts = np.flatnonzero(np.diff([-1, *community[:n]])).tolist() + [n]
    bounds = np.array([(starts[c], starts[c + 1]) for c in community[:n]])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            src, dst = [], []
            for u in pdf["id"]:
                own = np.random.default_rng([sum(map(ord, tag)), seed, int(u)])
                lo, hi = bounds[u]
                inner = np.flatnonzero(own.random(hi - lo) < p_in) + lo
                outer = _skips(own, n, p_out)
                keep = np.concatenate([inner[inner != u], outer[(outer < lo) | (outer >= hi)]])
                src += [u] * len(keep)
                dst += keep.tolist()
            yield pd.DataFrame({"src": np.array(src, "int64"), "dst": np.array(dst, "int64")})

    return spark.range(n).mapInPandas(run, "src long, dst long")


def _skips(rng, n: int, p: float) -> np.ndarray:
    if p <= 0:
        return np.zeros(0, int)
    k = rng.geometric(p, size=int(n * p + 10 * np.sqrt(n * p) + 20)).cumsum() - 1
    return k[k < n]


# The members' ties of the public 34-member karate club network, by lower member.
KARATE = {
    0: (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31), 1: (2, 3, 7, 13, 17, 19, 21, 30), 2: (3, 7, 8, 9, 13, 27, 28, 32), 3: (7, 12, 13), 4: (6, 10), 5: (6, 10, 16), 6: (16,),
    8: (30, 32, 33), 9: (33,), 13: (33,), 14: (32, 33), 15: (32, 33), 18: (32, 33), 19: (33,), 20: (32, 33), 22: (32, 33), 23: (25, 27, 29, 32, 33), 24: (25, 27, 31), 25: (31,), 26: (29, 33),
    27: (33,), 28: (31, 33), 29: (32, 33), 30: (32, 33), 31: (32, 33), 32: (33,),
}


def karate(spark: SparkSession, **_) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, others in KARATE.items() for b in others], "src long, dst long")


def random_degree(spark: SparkSession, n: int, average: int, tag: str = "er", **_) -> DataFrame:
    """Every node draws 1..2 * average targets."""
    k = 1 + F.floor(uniform(f"{tag}-k", "id") * 2 * average).cast("int")
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), k)).alias("i"))
    return rows.select("src", F.floor(uniform(tag, "src", "i") * n).cast("long").alias("dst")).filter("src <> dst").distinct()


GENERATORS: dict[str, Callable[..., DataFrame]] = {
    "path": path, "grid": grid, "binomial": binomial, "watts_strogatz": watts_strogatz, "powerlaw_cluster": powerlaw_cluster,
    "gaussian_random_partition": gaussian_random_partition, "karate": karate, "random_degree": random_degree,
}


def generate(spark: SparkSession, graph_type: str, weight_scale: float = 1.0, random_weight: int = 0, both: int | None = None, **params) -> DataFrame:
    """src, dst, weight: a topology, directed if asked for (1: both ways, 0: a coin), and weighted.

    ``weight_scale`` may be a list: then one topology is weighted several times and the result has a
    column weight_scale.
    """
    if graph_type not in GENERATORS:
        raise ValueError(f"unknown graph type {graph_type!r}")
    edges = GENERATORS[graph_type](spark, **params)
    if both is not None:
        edges = both_directions(edges) if both else random_direction(edges)
    if isinstance(weight_scale, list):
        parts = [assign_weights(edges, w, bool(random_weight)).withColumn("weight_scale", F.lit(float(w))) for w in weight_scale]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    return assign_weights(edges, weight_scale, bool(random_weight))


def update_workload(edges: DataFrame, n: int, tag: str = "workload", mix: tuple[float, float, float, float] = (0.6, 0.2, 0.15, 0.05)) -> DataFrame:
    """seq, op, src, dst: n random updates (insert edge, insert node, delete edge, delete node) in the given shares."""
    from ..operators.transforms import nodes

    top = nodes(edges).agg(F.max("id").alias("top"))
    draws = edges.sparkSession.range(n).withColumnRenamed("id", "seq").crossJoin(F.broadcast(top))
    u = uniform(f"{tag}-op", "seq")
    a, b, c, _ = np.cumsum(mix)
    op = F.when(u < float(a), "ie").when(u < float(b), "in").when(u < float(c), "de").otherwise("dn")
    x = F.floor(uniform(f"{tag}-a", "seq") * (F.col("top") + 1)).cast("long")
    y = F.floor(uniform(f"{tag}-b", "seq") * (F.col("top") + 1)).cast("long")
    return draws.select("seq", op.alias("op"), F.when(op == "in", F.col("top") + 1 + F.col("seq")).otherwise(x).alias("src"), F.when(op.isin("ie", "de"), y).alias("dst"))


def split_log(pairs: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Base graph from the first edges by timestamp of pairs(src, dst, ts), and the rest as insertions."""
    from ..runtime import numbered

    rows = numbered(pairs, [F.col("ts"), F.col("src"), F.col("dst")], "seq")
    base = rows.filter(F.col("seq") < first).select("src", "dst")
    rest = rows.filter(F.col("seq") >= first).select((F.col("seq") - first).alias("seq"), F.lit("ie").alias("op"), "src", "dst")
    return base, rest

