"""Immunization strategies: removal orders as removal(rank, node, score); rank 0 is removed first."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..coins import u32
from ..runtime import cut, numbered
from .fixpoint import weak_components
from .transforms import both_directions, nodes, noisy_or

#: Most edges that a driver-side strategy accepts; they are counted before they are collected.
DRIVER_EDGES = 2_000_000
#: Edges that a task of betweenness meets, over all its sources, most tasks that a component's edges are copied to, and
#: about as many edges as are packed into a row.
WORK, COPIES, BLOCK = 20_000_000, 16, 250_000


def ranked(scores: DataFrame, ties: str = "asc") -> DataFrame:
    """rank, node, score in descending order of score; ties in node order (asc) or against it (desc)."""
    return numbered(scores.select("node", "score"), [F.desc("score"), F.desc("node") if ties == "desc" else F.asc("node")], "rank")


def collected(edges: DataFrame) -> pd.DataFrame:
    """Edges on the driver, after their number was checked."""
    n = edges.count()
    if n > DRIVER_EDGES:
        raise ValueError(f"{n} edges: this strategy works on graphs of up to {DRIVER_EDGES}")
    return edges.toPandas()


def degree(edges: DataFrame) -> DataFrame:
    """In- plus out-degree; ties to the later node."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return ranked(ends.groupBy("node").agg(F.count(F.lit(1)).alias("score")), "desc")


def random_order(edges: DataFrame, tag: str = "random") -> DataFrame:
    """A permutation by a hash of the node."""
    return ranked(nodes(edges).select(F.col("id").alias("node"), (-u32(tag, "id")).alias("score")))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20, tol: float | None = None) -> DataFrame:
    """node, score after ``rounds`` power iterations on weight-normalised out-edges; dangling mass is uniform.

    With ``tol`` it stops when the L1 change is below n * tol.
    """
    ids = cut(nodes(edges).select(F.col("id").alias("node")))
    n = ids.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    sources = out.select(F.col("src").alias("node"))
    now = ids.withColumn("score", F.lit(1.0 / n))
    for k in range(rounds):
        lost = now.join(sources, "node", "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        got = share.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        new = ids.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n).alias("score"))
        new = cut(new)
        if tol is not None and new.join(now.withColumnRenamed("score", "old"), "node").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < n * tol:
            return new
        now = new
    return now


def katz(edges: DataFrame, alpha: float = 0.1, beta: float = 1.0, rounds: int = 20) -> DataFrame:
    """node, score: x = alpha * A^T x + beta by Jacobi rounds, scaled to unit length (alpha below 1 / spectral radius)."""
    ids = cut(nodes(edges).select(F.col("id").alias("node")))
    own = cut(edges.select("src", "dst", "weight"))
    now = ids.withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        got = own.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("score")).alias("got"))
        now = cut(ids.join(got, "node", "left").select("node", (alpha * F.coalesce("got", F.lit(0.0)) + beta).alias("score")))
    norm = now.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    return now.crossJoin(F.broadcast(norm)).select("node", (F.col("score") / F.col("norm")).alias("score"))


def principal_vector(edges: DataFrame, rounds: int = 50) -> tuple[float, DataFrame]:
    """Largest eigenvalue and its unit vector (node, u) of the undirected weighted graph, by power iteration on A + I."""
    sym = cut(both_directions(edges.select("src", "dst", "weight")))
    ids = nodes(sym).select(F.col("id").alias("node"))
    now = cut(ids.withColumn("u", F.lit(1.0)))
    value = 0.0
    for _ in range(rounds):
        got = sym.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("u")).alias("got"))
        new = now.join(got, "node", "left").select("node", (F.col("u") + F.coalesce("got", F.lit(0.0))).alias("u"))
        norm = new.agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
        now = cut(new.crossJoin(F.broadcast(norm)).select("node", (F.col("u") / F.col("norm")).alias("u"), "norm"))
        value = now.first()["norm"] - 1
        now = now.select("node", "u")
    return value, now


def netshield(edges: DataFrame, k: int) -> DataFrame:
    """rank, node, score: score 2 * lambda * u^2; after each choice its neighbours lose 2 * u_s * u_j."""
    value, vector = principal_vector(edges)
    sym = both_directions(edges.select("src", "dst", "weight")).select("src", "dst")
    left = cut(vector.withColumn("score", 2 * value * F.col("u") * F.col("u")))
    picked = []
    for rank in range(k):
        row = left.agg(F.max(F.struct(F.round("score", 9).alias("r"), (-F.col("node")).alias("m"), "score", "u")).alias("b")).first()["b"]
        if row is None:
            break
        node = -row["m"]
        picked.append((rank, node, float(row["score"])))
        near = sym.filter(F.col("src") == node).select(F.col("dst").alias("node"), F.lit(1).alias("near"))
        left = cut(left.filter(F.col("node") != node).join(near, "node", "left").withColumn("score", F.col("score") - F.when(F.col("near") == 1, 2 * row["u"] * F.col("u")).otherwise(0.0)).drop("near"))
    return edges.sparkSession.createDataFrame(picked, "rank long, node long, score double")


def acquaintance(edges: DataFrame, tag: str = "acquaintance") -> DataFrame:
    """A random remaining node's random remaining out-neighbour, or the node itself, until all are removed."""
    table = collected(edges.select("src", "dst"))
    left = sorted({*table["src"], *table["dst"]})
    out = table.groupby("src")["dst"].apply(sorted).to_dict()
    rng = np.random.default_rng(list(tag.encode()))
    alive, order = set(left), []
    while left:
        node = left[rng.integers(len(left))]
        near = [v for v in out.get(node, ()) if v in alive and v != node]
        gone = near[rng.integers(len(near))] if near else node
        order.append(gone)
        alive.discard(gone)
        left.remove(gone)
    return edges.sparkSession.createDataFrame([(i, int(v), float(len(order) - i)) for i, v in enumerate(order)], "rank long, node long, score double")


def _dense(src: np.ndarray, dst: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids in order, and the positions in them of the edges' ends and of the other nodes."""
    ids = np.unique(np.concatenate((src, dst, others)))
    return ids, *(np.searchsorted(ids, x) for x in (src, dst, others))


def least_distances(n: int, start: dict[int, float], src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least sums of positive weights from the start nodes, given their own distances; edges are sorted by dst."""
    dist = np.full(n, np.inf)
    for v, d in start.items():
        dist[v] = d
    if not len(src):
        return dist
    first = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
    heads = dst[first]
    while True:
        new = np.minimum(np.minimum.reduceat(dist[src] + weight, first), dist[heads])
        if not (new < dist[heads]).any():
            return dist
        dist[heads] = new


#: A block of a component's in-edges as a row: heads, where each head's edges begin, their sources, and the weights as codes
#: of at most 256 values where that is enough (values is empty otherwise).
PACKED = "component long, parts int, heads binary, first binary, src binary, width int, values binary, codes binary"


def pack(table: pa.Table) -> pa.Table:
    """One block, in the order of heads and sources, from the edges (a, b, weight) of some heads b."""
    a, b, weight = (table.column(c).to_numpy() for c in ("a", "b", "weight"))
    order = np.lexsort((a, b))
    a, weight = a[order], weight[order]
    heads, first = np.unique(b[order], return_index=True)
    src = a.astype(np.uint16 if a.max() < 1 << 16 else np.int32)
    values, codes = np.unique(weight, return_inverse=True)
    values, codes = (values, codes.astype(np.uint8)) if len(values) <= 256 else (values[:0], weight)
    arrays = {"heads": heads.astype(np.int32), "first": first.astype(np.int32), "src": src, "values": values, "codes": codes}
    columns = {k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()} | {"width": pa.array([src.itemsize], pa.int32())}
    columns |= {k: table.column(k)[:1] for k in ("component", "parts")}
    return pa.table({k: columns[k] for k in ("component", "parts", "heads", "first", "src", "width", "values", "codes")})


class Blocks:
    """The edges of a component, as rows of pack(); what is computed for each edge is held for one block at a time."""

    def __init__(self, table: pa.Table):
        get = lambda c, k, t: np.frombuffer(table.column(c)[k].as_buffer(), t)
        self.rows = []
        for k in range(table.num_rows):
            values = get("values", k, np.float64)
            src = get("src", k, np.uint16 if table.column("width")[k].as_py() == 2 else np.int32)
            self.rows.append((get("heads", k, np.int32), get("first", k, np.int32), src, values, get("codes", k, np.uint8 if len(values) else np.float64)))
        self.n = 1 + max(max(int(r[0].max()), int(r[2].max())) for r in self.rows)

    def __iter__(self):
        for heads, first, src, values, codes in self.rows:
            yield heads, first, src, values[codes] if len(values) else codes

    def distances(self, s: int) -> np.ndarray:
        """Least sums of weights from node s."""
        dist = np.full(self.n, np.inf)
        dist[s] = 0.0
        shorter = True
        while shorter:
            shorter = False
            for heads, first, src, weight in self:
                old = dist[heads]
                new = np.minimum(np.minimum.reduceat(dist[src] + weight, first), old)
                if (new < old).any():
                    dist[heads] = new
                    shorter = True
        return dist

    def shortest_edges(self, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the edges on shortest paths."""
        ends = []
        for heads, first, src, weight in self:
            near, far = dist[src], np.repeat(dist[heads], np.diff(first, append=len(src)))
            on = np.flatnonzero(np.isfinite(near))
            on = on[(np.abs(near[on] + weight[on] - far[on]) <= 1e-12) & (near[on] < far[on])]
            ends.append((src[on].astype(np.int32), heads[np.searchsorted(first, on, side="right") - 1]))
        return tuple(np.concatenate(x) for x in zip(*ends))

    def dependencies(self, s: int) -> np.ndarray:
        """Brandes' dependency of source s on every node: shares of the shortest paths from s that run through it.

        Path counts and dependencies advance by one edge a round, for all nodes at once.
        """
        u, v = self.shortest_edges(self.distances(s))
        paths = np.zeros(self.n)
        now = paths.copy()
        now[s] = 1.0
        while now.any():
            paths += now
            now = np.bincount(v, now[u], self.n)
        share = paths[u] / paths[v]
        debt = np.zeros(self.n)
        now = np.bincount(u, share, self.n)
        while now.any():
            debt += now
            now = np.bincount(u, share * now[v], self.n)
        debt[s] = 0.0
        return debt


def betweenness(edges: DataFrame, pivots: int = 1000, tag: str = "pivot") -> DataFrame:
    """node, score: weighted shortest-path betweenness from min(pivots, n) sources; weights are positive.

    Paths stay in their weak component, so a task gets the edges of one component, packed into 3 to 12 bytes each,
    and some of its sources.  The sources of a component are dealt out over up to COPIES tasks, as far as their work
    asks for it.
    """
    edges = cut(edges.select("src", "dst", "weight"))
    if not edges.filter("weight <= 0").isEmpty():
        raise ValueError("weights are not positive")
    ids = cut(nodes(edges).select(F.col("id").alias("node")))
    chosen = ids.orderBy(u32(tag, "node"), "node").limit(pivots)
    # a node whose only edges are loops is on no path between others
    own = edges.filter("src <> dst")
    component = weak_components(edges)
    within = Window.partitionBy("component").orderBy("node")
    named = cut(component.join(chosen.withColumn("asked", F.lit(True)), "node", "left").select("node", "component", F.col("asked").isNotNull().alias("asked"), (F.row_number().over(within) - 1).alias("at")))
    degrees = own.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("m"))
    work = named.join(degrees, "node", "left").groupBy("component").agg(F.sum("m").alias("m"), F.sum(F.col("asked").cast("long")).alias("k")).filter("k > 0")
    parts = cut(work.select("component", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.least(F.lit(COPIES), F.col("k"), F.ceil(F.col("m") * F.col("k") / WORK)).cast("int").alias("parts")))
    # the sizes go to the nodes first: by component, all edges of one would meet in a task
    heads = named.join(parts, "component").select(F.col("node").alias("dst"), "component", "parts", F.col("at").alias("b"), F.pmod("at", "blocks").alias("block"))
    joined = own.join(heads, "dst").join(named.select(F.col("node").alias("src"), F.col("at").alias("a")), "src")
    packed = joined.select("component", "parts", "block", "a", "b", "weight").groupBy("component", "block").applyInArrow(pack, PACKED)
    dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    turn = F.pmod(F.row_number().over(within), F.col("parts")).cast("int")
    asked = named.filter("asked").join(parts, "component").select(F.col("component").alias("c"), turn.alias("p"), "at")

    def run(key, table, asked):
        starts = asked.column("at").to_numpy()
        if not len(starts):
            return pa.table({"component": pa.array([], pa.int64()), "at": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})
        blocks = Blocks(table)
        score = np.zeros(blocks.n)
        for s in np.sort(starts).tolist():
            score += blocks.dependencies(s)
        at = np.flatnonzero(score).astype(np.int32)
        return pa.table({"component": np.full(len(at), key[0].as_py()), "at": at, "score": score[at]})

    found = dealt.groupBy("component", "part").cogroup(asked.groupBy("c", "p")).applyInArrow(run, "component long, at int, score double")
    scores = found.groupBy("component", "at").agg(F.sum("score").alias("score")).join(named, ["component", "at"]).select("node", "score")
    return ids.join(scores, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def random_perturbation(edges: DataFrame, k: int, tag: str = "randpert") -> DataFrame:
    """The first k nodes of a random order."""
    return random_order(edges, tag).filter(F.col("rank") < k)


def dominator_tree(out: dict[int, list[int]], root: int) -> dict[int, int]:
    """Immediate dominators by iterated intersection in reverse post-order."""
    order, seen, stack = [], {root}, [(root, iter(out.get(root, ())))]
    while stack:
        node, rest = stack[-1]
        for v in rest:
            if v not in seen:
                seen.add(v)
                stack.append((v, iter(out.get(v, ()))))
                break
        else:
            order.append(node)
            stack.pop()
    number = {v: i for i, v in enumerate(order)}
    into: dict[int, list[int]] = {}
    for u in order:
        for v in out.get(u, ()):
            if v in number:
                into.setdefault(v, []).append(u)
    idom, changed = {root: root}, True
    while changed:
        changed = False
        for v in reversed(order):
            if v == root:
                continue
            new = None
            for u in into.get(v, ()):
                if u in idom:
                    if new is None:
                        new = u
                    else:
                        a, b = new, u
                        while a != b:
                            while number[a] < number[b]:
                                a = idom[a]
                            while number[b] < number[a]:
                                b = idom[b]
                        new = a
            if idom.get(v) != new:
                idom[v], changed = new, True
    return idom


def root_benefits(n: int, src: np.ndarray, dst: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of node 0 in the dominator tree of a graph, and their benefits; edges are sorted by dst.

    A node with an edge from 0 has no other dominator, so only the rest of the nodes keep their in-edges for the tree.
    """
    dist = least_distances(n, {0: 0.0}, src, dst, -np.log(chance))
    direct = np.zeros(n, bool)
    direct[dst[src == 0]] = True
    out: dict[int, list[int]] = {0: np.flatnonzero(direct).tolist()}
    kept = ~direct[dst] & np.isfinite(dist[src]) & (dst != 0)
    for a, b in zip(src[kept].tolist(), dst[kept].tolist()):
        out.setdefault(a, []).append(b)
    children: dict[int, list[int]] = {}
    for v, u in dominator_tree(out, 0).items():
        if v != 0:
            children.setdefault(u, []).append(v)
    total: dict[int, float] = {}
    stack = [(0, False)]
    while stack:
        v, ready = stack.pop()
        if not ready:
            stack.append((v, True))
            stack += [(c, False) for c in children.get(v, ())]
        else:
            total[v] = 1 + sum(total[c] * math.exp(dist[v] - dist[c]) for c in children.get(v, ()))
    found = np.array(children.get(0, []), int)
    return found, np.array([total[v] for v in found.tolist()]) * np.exp(-dist[found])


def dava(edges: DataFrame, infected: DataFrame, k: int, fast: bool = False) -> DataFrame:
    """rank, node, score: nodes to remove given infected(node), by dominator-tree benefit.

    The infected merge into a root (parallel edges by noisy-or).  A tree edge has the probability of the
    most likely path between its ends; a node's benefit is the expected size of its subtree.  The best
    child of the root by benefit times probability goes, and the tree is rebuilt (``fast``: built once).

    Without the root the rest falls into weak components, whose trees do not depend on each other: a task gets one
    component, and the driver only the choices within the k components that have the best first choices.
    """
    sick = cut(infected.select("node").distinct())
    weight = F.when(F.col("weight") >= 1, 0.99999).otherwise(F.col("weight"))
    own = edges.select("src", "dst", weight.alias("weight")).join(sick, F.col("dst") == F.col("node"), "left_anti")
    marked = own.join(sick, F.col("src") == F.col("node"), "left")
    root = F.col("node").isNotNull()
    merged = cut(noisy_or(marked.select(root.alias("is_root"), F.when(root, 0).otherwise(F.col("src")).alias("src"), "dst", "weight"), ["is_root", "src", "dst"]).filter("weight > 0"))
    component = weak_components(merged.filter("NOT is_root")).toDF("n", "c")
    parts = cut(merged.join(component, F.col("dst") == F.col("n"), "left").select(F.coalesce("c", "dst").alias("component"), "is_root", "src", "dst", "weight"))

    def choices(rows: DataFrame, count: int) -> DataFrame:
        """component, pos, node, score: the first choices in each component."""

        def run(table):
            from_root, src, dst = (table.column(c).to_numpy(zero_copy_only=False) for c in ("is_root", "src", "dst"))
            ids, src, dst, _ = _dense(np.where(from_root, dst, src), dst, dst[:0])
            src, dst = np.where(from_root, 0, src + 1), dst + 1
            order = np.lexsort((src, dst))
            src, dst, chance = src[order], dst[order], table.column("weight").to_numpy()[order]
            picked: list[tuple[float, int]] = []
            while len(picked) < count:
                found, benefit = root_benefits(len(ids) + 1, src, dst, chance)
                best = np.lexsort((found, benefit))[::-1][: count if fast else 1]
                picked += zip(benefit[best].tolist(), ids[found[best] - 1].tolist())
                if fast or not len(best):
                    break
                left = (src != found[best[0]]) & (dst != found[best[0]])
                src, dst, chance = src[left], dst[left], chance[left]
            at = pa.array([table.column("component")[0].as_py()] * len(picked), pa.int64())
            return pa.table({"component": at, "pos": pa.array(range(len(picked)), pa.int32()), "node": pa.array([v for _, v in picked], pa.int64()), "score": pa.array([b for b, _ in picked], pa.float64())})

        return rows.groupBy("component").applyInArrow(run, "component long, pos int, node long, score double")

    best_first = [F.desc("score"), F.desc("node")]
    if fast:
        picked = [(r["node"], r["score"]) for r in choices(parts, k).orderBy(*best_first).limit(k).collect()]
    else:
        # with k components whose first choice is better, one that is not among them never has its turn
        first = cut(choices(parts, 1).orderBy(*best_first).limit(k).select("component"))
        heads: dict[int, list[tuple[float, int]]] = {}
        for r in choices(parts.join(first, "component"), k).orderBy("component", F.desc("pos")).collect():
            heads.setdefault(r["component"], []).append((r["score"], r["node"]))
        picked = []
        while len(picked) < k and (left := [c for c in heads if heads[c]]):
            score, node = heads[max(left, key=lambda c: heads[c][-1])].pop()
            picked.append((node, score))
    rows = [(i, int(v), float(b)) for i, (v, b) in enumerate(picked)]
    return edges.sparkSession.createDataFrame(rows, "rank long, node long, score double")


#: Strategies by name: edges(src, dst, weight) to removal(rank, node, score).
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Degree": degree,
    "Random": random_order,
    "Pagerank": lambda e: ranked(pagerank(e, tol=0.01, rounds=100)),
    "Katz": lambda e: ranked(katz(e)),
    "Betweenness": lambda e: ranked(betweenness(e)),
    "Netshield": lambda e: netshield(e, nodes(e).count()),
    "Acquaintance": acquaintance,
}


def removal(edges: DataFrame, names: list[str]) -> DataFrame:
    """strategy, rank, node of several strategies; an unknown name is an error."""
    parts = [STRATEGIES[n](edges).select(F.lit(n).alias("strategy"), F.col("rank").cast("int").alias("rank"), "node") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
