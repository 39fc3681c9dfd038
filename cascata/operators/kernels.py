"""Grouped kernels for worlds that fit one task: numpy inside applyInPandas, one call per group.

They agree exactly with the relational fixpoints; MAX_NODES guards their memory (n by n matrices).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAX_NODES = 4096


def bottleneck_matrix(n: int, src: np.ndarray, dst: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """B[s, v]: over all paths, the largest least rank on one; -1 if there is no path; B[s, s] = rank[s].

    Nodes join in descending rank as through-nodes, so each update is final.
    """
    b = np.full((n, n), -1, np.int32)
    b[src, dst] = np.minimum(rank[src], rank[dst])
    np.fill_diagonal(b, rank)
    for k in np.argsort(-rank, kind="stable"):
        into, out = b[:, k], b[k]
        rows = np.flatnonzero(into >= 0)
        cols = np.flatnonzero(out >= 0)
        if len(rows) > 1 and len(cols) > 1:
            block = np.ix_(rows, cols)
            b[block] = np.maximum(b[block], np.minimum.outer(into[rows], out[cols]))
    return b


def reach_by_level(b: np.ndarray) -> np.ndarray:
    """R[s, l] = #{v: B[s, v] >= l} for l = 0..n-1."""
    n = len(b)
    hist = np.zeros((n, n + 1), np.int64)
    s, v = np.nonzero(b >= 0)
    np.add.at(hist, (s, b[s, v]), 1)
    return hist[:, ::-1].cumsum(1)[:, ::-1][:, :n]


def greedy_cover_by_level(b: np.ndarray, level: int, k: int) -> tuple[list[int], list[int]]:
    """Greedy roots for one level: (nodes, gains); ties go to the larger node."""
    covers = b >= level
    alive = covers.diagonal()
    left = covers & alive[None, :]
    picked, gains = [], []
    for _ in range(min(k, int(alive.sum()))):
        gain = left.sum(1) * alive
        best = len(gain) - 1 - int(np.argmax(gain[::-1]))
        picked.append(best)
        gains.append(int(gain[best]))
        left = left & ~left[best][None, :]
    return picked, gains


def _matrix(pdf: pd.DataFrame, order: pd.DataFrame):
    nodes = order["node"].to_numpy()
    at = {v: i for i, v in enumerate(nodes)}
    src, dst = (np.array([at[v] for v in pdf[c]], int) for c in ("src", "dst"))
    return nodes, bottleneck_matrix(len(nodes), src, dst, order["rank"].to_numpy(np.int32))


def _grouped(live: DataFrame, order: DataFrame, n_worlds: int, per_world, schema: str) -> DataFrame:
    """Run per_world(world, nodes, B) for every strategy and world; worlds without edges included."""
    ranks = order.select("node", "rank").limit(MAX_NODES + 1).toPandas().sort_values("node").reset_index(drop=True)
    if len(ranks) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes in a world: use the relational closure")
    spark = live.sparkSession
    every = spark.range(n_worlds).selectExpr("CAST(id AS INT) AS world")
    rows = every.join(live, "world", "left").select("world", "src", "dst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        world = int(pdf["world"].iloc[0])
        nodes, b = _matrix(pdf.dropna(), ranks)
        return per_world(world, nodes, b)

    return rows.groupBy("world").applyInPandas(run, schema)


def max_reach(live: DataFrame, order: DataFrame, n_worlds: int) -> DataFrame:
    """world, l, max_reach: the largest number of nodes that one node reaches with the first l of the order gone."""

    def per(world, nodes, b):
        r = reach_by_level(b).max(0)
        return pd.DataFrame({"world": np.int32(world), "l": np.arange(len(r), dtype=np.int32), "max_reach": r})

    return _grouped(live, order, n_worlds, per, "world int, l int, max_reach long")


def scc_by_level(live: DataFrame, order: DataFrame, n_worlds: int) -> DataFrame:
    """world, l, n_scc: strongly connected components among the nodes that are left at each level."""

    def per(world, nodes, b):
        both = np.minimum(b, b.T)
        n = len(nodes)
        out = []
        for level in range(n):
            same = both >= level
            alive = same.diagonal()
            least = np.where(same, np.arange(n)[None, :], n).min(1)
            out.append(int((least[alive] == np.flatnonzero(alive)).sum()))
        return pd.DataFrame({"world": np.int32(world), "l": np.arange(n, dtype=np.int32), "n_scc": np.array(out, np.int64)})

    return _grouped(live, order, n_worlds, per, "world int, l int, n_scc long")


def greedy_reach(live: DataFrame, order: DataFrame, n_worlds: int, k: int, levels: list[int]) -> DataFrame:
    """world, l, reach: nodes that the greedy k roots reach, at chosen levels."""

    def per(world, nodes, b):
        rows = [(np.int32(world), np.int32(level), sum(greedy_cover_by_level(b, level, k)[1])) for level in levels]
        return pd.DataFrame(rows, columns=["world", "l", "reach"])

    return _grouped(live, order, n_worlds, per, "world int, l int, reach long")


def log_det(sampled: DataFrame) -> DataFrame:
    """rr_id, reward: log-determinant of the Laplacian of sampled(rr_id, root, src, dst) grounded at the root; 0 if singular."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=["src", "dst"])
        root = pdf["root"].iloc[0]
        nodes = sorted({root, *own["src"], *own["dst"]})
        at = {v: i for i, v in enumerate(nodes)}
        laplacian = np.zeros((len(nodes), len(nodes)))
        for a, b in {(min(a, b), max(a, b)) for a, b in zip(own["src"], own["dst"])}:
            i, j = at[a], at[b]
            laplacian[[i, j], [i, j]] += 1
            laplacian[[i, j], [j, i]] -= 1
        grounded = np.delete(np.delete(laplacian, at[root], 0), at[root], 1)
        sign, value = np.linalg.slogdet(grounded) if len(grounded) else (1, 0.0)
        return pd.DataFrame({"rr_id": [pdf["rr_id"].iloc[0]], "reward": [float(value) if sign > 0 else 0.0]})

    return sampled.groupBy("rr_id").applyInPandas(run, "rr_id int, reward double")


def delete_hubs(live: DataFrame, steps: int) -> DataFrame:
    """world, step, largest: size of the largest weak component while the node of highest degree is deleted, step by step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        at = {v: i for i, v in enumerate(nodes)}
        adjacent = [set() for _ in nodes]
        for a, b in zip(pdf["src"], pdf["dst"]):
            adjacent[at[a]].add(at[b])
            adjacent[at[b]].add(at[a])
        out, gone = [], set()
        for step in range(min(steps, len(nodes))):
            seen, largest = set(gone), 0
            for s in range(len(nodes)):
                if s in seen:
                    continue
                stack, size = [s], 0
                seen.add(s)
                while stack:
                    u = stack.pop()
                    size += 1
                    for v in adjacent[u]:
                        if v not in seen:
                            seen.add(v)
                            stack.append(v)
                largest = max(largest, size)
            out.append((np.int32(pdf["world"].iloc[0]), np.int32(step), largest))
            hub = max((i for i in range(len(nodes)) if i not in gone), key=lambda i: (len(adjacent[i] - gone), nodes[i]))
            gone.add(hub)
        return pd.DataFrame(out, columns=["world", "step", "largest"])

    return live.groupBy("world").applyInPandas(run, "world int, step int, largest long")
