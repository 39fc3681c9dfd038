"""Set-at-a-time fixpoints: reachability, depths, distances, components and max-min closures.

Every fan-out axis (world, strategy, sketch) is a key column, so all of them advance in one loop.  Each
round's new rows are checkpointed in the shared folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

MAX_ROUNDS = 10_000
#: Rows of a frontier that is sent to the edges, which then stay where they are; larger ones meet them in a shuffle.
SENT = 100_000


def reach(frontier: DataFrame, edges: DataFrame, keys: list[str], edge_keys: list[str] | None = None, alive: Column | None = None, closed: DataFrame | None = None) -> DataFrame:
    """keys, node, depth: all nodes reachable from frontier(keys, node), with their least number of steps.

    edges(edge_keys, src, dst); ``edge_keys`` (default: all keys) are the keys that edges depend on.  With
    ``alive``, a condition on keys and edge columns, an edge's coin is flipped only when the edge is met.
    Nodes of closed(some of the keys, node) are never entered.
    """
    edge_keys = keys if edge_keys is None else edge_keys
    edges = edges if alive is not None else edges.select(*edge_keys, "src", "dst")
    new = cut(frontier.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    seen, size = [new], new.count()
    for depth in range(1, MAX_ROUNDS):
        near = new.select(*keys, F.col("node").alias("src"))
        step = (F.broadcast(near) if size <= SENT else near).join(edges, [*edge_keys, "src"])
        step = (step if alive is None else step.filter(alive)).select(*keys, F.col("dst").alias("node")).distinct()
        step = step if closed is None else step.join(closed, closed.columns, "left_anti")
        new = cut(step.join(reduce(DataFrame.union, seen).select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        size = new.count()
        if not size:
            return reduce(DataFrame.union, seen)
        seen.append(new)
        if len(seen) > 8:
            seen = [cut(reduce(DataFrame.union, seen))]
    raise RuntimeError("no fixpoint within the allowed rounds")


def shortest(frontier: DataFrame, edges: DataFrame, keys: list[str], edge_keys: list[str] | None = None, limit: float | None = None) -> DataFrame:
    """keys, node, distance: least sums of edges.distance from frontier(keys, node); below ``limit`` if given."""
    edge_keys = keys if edge_keys is None else edge_keys
    best = cut(frontier.select(*keys, "node").distinct().withColumn("distance", F.lit(0.0)))
    new = best
    for _ in range(MAX_ROUNDS):
        step = new.withColumnRenamed("node", "src").withColumnRenamed("distance", "d0").join(edges.select(*edge_keys, "src", "dst", F.col("distance").alias("d1")), [*edge_keys, "src"])
        step = step.select(*keys, F.col("dst").alias("node"), (F.col("d0") + F.col("d1")).alias("distance"))
        if limit is not None:
            step = step.filter(F.col("distance") < limit)
        step = step.groupBy(*keys, "node").agg(F.min("distance").alias("distance"))
        old = best.withColumnRenamed("distance", "old")
        new = cut(step.join(old, [*keys, "node"], "left").filter("old IS NULL OR distance < old").select(*keys, "node", "distance"))
        if new.isEmpty():
            return best
        best = cut(best.union(new).groupBy(*keys, "node").agg(F.min("distance").alias("distance")))
    raise RuntimeError("no fixpoint within the allowed rounds")


def bottleneck(sources: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s, v, b: for all paths from s to v the largest least rank on one of them.

    sources(keys, node, rank); edges(keys, src, dst, rank) with the rank of dst.  v is reachable from s
    when the first l nodes of the order are gone exactly if b >= l, for every l at once.
    """
    best = cut(sources.select(*keys, F.col("node").alias("s"), F.col("node").alias("v"), F.col("rank").alias("b")))
    new = best
    for _ in range(MAX_ROUNDS):
        step = new.withColumnRenamed("v", "src").join(edges.select(*keys, "src", "dst", "rank"), [*keys, "src"]).groupBy(*keys, "s", F.col("dst").alias("v")).agg(F.max(F.least("b", "rank")).alias("b"))
        old = best.withColumnRenamed("b", "old")
        new = cut(step.join(old, [*keys, "s", "v"], "left").filter("old IS NULL OR b > old").select(*keys, "s", "v", "b"))
        if new.isEmpty():
            return best
        best = cut(best.union(new).groupBy(*keys, "s", "v").agg(F.max("b").alias("b")))
    raise RuntimeError("no fixpoint within the allowed rounds")


def weak_components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, node, component: the smallest node of every weakly connected component (nodes with edges).

    Labels take the neighbours' minimum, then the label of their label, so long paths halve each round.
    """
    keys = keys or []
    links = edges.select(*keys, "src", "dst").union(edges.select(*keys, F.col("dst"), F.col("src"))).filter("src <> dst").distinct()
    links = cut(links)
    label = cut(links.groupBy(*keys, F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    for _ in range(MAX_ROUNDS):
        near = links.join(label.withColumnRenamed("node", "dst"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node")).agg(F.min("component").alias("near"))
        now = label.join(near, [*keys, "node"]).select(*keys, "node", F.least("component", "near").alias("component"))
        up = now.select(*keys, F.col("node").alias("component"), F.col("component").alias("up"))
        now = cut(now.join(up, [*keys, "component"], "left").select(*keys, "node", F.least("component", F.coalesce("up", "component")).alias("component")))
        changed = now.join(label.withColumnRenamed("component", "old"), [*keys, "node"]).filter("component <> old")
        if changed.isEmpty():
            return now
        label = now
    raise RuntimeError("no fixpoint within the allowed rounds")


def strong_components(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """node, scc: strongly connected components, named by their smallest node.

    Colouring: every node takes the largest node that reaches it; within a colour, the nodes that reach
    the colour's own node form its component and leave.  Rounds shrink the graph until nothing is left.
    """
    left = cut(all_nodes.select(F.col("id").alias("node")).distinct())
    live = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    found: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        # nodes without an edge in or without an edge out are components of their own
        while True:
            inner = cut(live.select(F.col("src").alias("node")).intersect(live.select("dst")))
            trimmed = live.join(inner, live["src"] == inner["node"], "left_semi")
            trimmed = cut(trimmed.join(inner, trimmed["dst"] == inner["node"], "left_semi"))
            if trimmed.count() == live.count():
                break
            live = trimmed
        single = cut(left.join(inner, "node", "left_anti"))
        found.append(single.withColumn("scc", F.col("node")))
        left = cut(left.join(inner, "node", "left_semi"))
        if left.isEmpty():
            return reduce(DataFrame.union, found)
        colour = left.withColumn("colour", F.col("node"))
        while True:
            step = live.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("near"))
            now = cut(colour.join(step, "node", "left").select("node", F.greatest("colour", F.coalesce("near", "colour")).alias("colour")))
            if now.join(colour.withColumnRenamed("colour", "old"), "node").filter("colour <> old").isEmpty():
                break
            colour = now
        within = live.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").filter("colour = c2")
        back = within.select("colour", F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = cut(reach(colour.filter("node = colour").select("colour", "node"), back, ["colour"]).select("colour", "node"))
        names = members.groupBy("colour").agg(F.min("node").alias("scc"))
        found.append(cut(members.join(names, "colour").select("node", "scc")))
        left = cut(left.join(members.select("node"), "node", "left_anti"))
        live = live.join(left.withColumnRenamed("node", "src"), "src", "left_semi")
        live = cut(live.join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    raise RuntimeError("no fixpoint within the allowed rounds")


#: Most edges of a weak component whose strong components are found in one task.
TASK_EDGES = 8_000_000
#: Nodes of a strong component in a pack, and pairs for which a task is asked at least.
PACK, TASK_PAIRS = 512, 16_000_000


def strong_labels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A number for each of the nodes 0 to n - 1, the same within a strong component (Tarjan's search, without recursion)."""
    order = np.argsort(src, kind="stable")
    out, ends = dst[order], np.cumsum(np.bincount(src, minlength=n)).tolist()
    at = [0, *ends[:-1]]
    found, low, label = [-1] * n, [0] * n, [-1] * n
    met, components, path, held = 0, 0, [], []
    for root in range(n):
        if found[root] >= 0:
            continue
        found[root] = low[root] = met
        met += 1
        path.append(root)
        held.append(root)
        while path:
            u = path[-1]
            if at[u] < ends[u]:
                v = int(out[at[u]])
                at[u] += 1
                if found[v] < 0:
                    found[v] = low[v] = met
                    met += 1
                    path.append(v)
                    held.append(v)
                elif label[v] < 0:
                    low[u] = min(low[u], found[v])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[u])
            if low[u] == found[u]:
                while label[u] < 0:
                    label[held.pop()] = components
                components += 1
    return np.array(label, np.int64)


def strong_components_by_task(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """As strong_components(), by weak component in one task each; the rounds take those with more than TASK_EDGES edges."""
    live = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    component = weak_components(live)
    sizes = live.join(component, live["src"] == component["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    named = cut(component.join(sizes, "component"))

    def run(table):
        src, dst = (table.column(c).to_numpy() for c in ("src", "dst"))
        ids = np.unique(np.concatenate((src, dst)))
        label = strong_labels(len(ids), np.searchsorted(ids, src), np.searchsorted(ids, dst))
        # ids ascend, so a label's first place has its smallest node
        first = np.unique(label, return_index=True)[1]
        return pa.table({"node": ids, "scc": ids[first][label]})

    of = named.select(F.col("node").alias("src"), "component", "m")
    small = live.join(of.filter(F.col("m") <= TASK_EDGES), "src").select("component", "src", "dst")
    found = small.groupBy("component").applyInArrow(run, "node long, scc long")
    large = named.filter(F.col("m") > TASK_EDGES)
    if not large.isEmpty():
        rest = live.join(of.filter(F.col("m") > TASK_EDGES), "src").select("src", "dst")
        found = found.union(strong_components(rest, large.select(F.col("node").alias("id"))))
    ids = all_nodes.select(F.col("id").alias("node")).distinct()
    return ids.join(found, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def reach_pairs(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """s, node: the nodes that each of all_nodes(id) reaches, itself included; all_nodes has the ends of all edges.

    Nodes of one strong component reach the same, so rounds run on components, and their pairs are written out at
    the end: the time follows the pairs, not the edges that lead to nodes that are reached already.  Components are cut
    into packs; a pair of packs is one row until it is written, with the sources of a pack again and again for one node
    after the other, so that files of these pairs stay small.
    """
    members = cut(strong_components_by_task(edges, all_nodes))
    named = lambda c: members.select(F.col("node").alias(c), F.col("scc").alias(f"{c}_scc"))
    between = edges.join(named("src"), "src").join(named("dst"), "dst").filter("src_scc <> dst_scc").select(F.col("src_scc").alias("src"), F.col("dst_scc").alias("dst")).distinct()
    start = members.select(F.col("scc").alias("s"), F.col("scc").alias("node")).distinct()
    closure = cut(reach(start, cut(between), ["s"], []).select(F.col("s").alias("of"), F.col("node").alias("scc")))
    place = F.row_number().over(Window.partitionBy("scc").orderBy("node")) - 1
    packs = cut(members.select("scc", "node", F.floor(place / PACK).alias("pack")).groupBy("scc", "pack").agg(F.sort_array(F.collect_list("node")).alias("ids")))
    sizes = members.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    of = sizes.select(F.col("scc").alias("of"), F.col("n").alias("k"))
    pairs = closure.join(of, "of").join(sizes, "scc").agg(F.sum(F.col("k") * F.col("n"))).first()[0] or 0
    both = closure.join(packs.select(F.col("scc").alias("of"), "pack", F.col("ids").alias("sources")), "of").join(packs.select("scc", "ids"), "scc")
    # a number that is asked for stays: pairs are made after the shuffle, so its size tells nothing
    dealt = both.repartition(max(1, -(-pairs // TASK_PAIRS)), "of", "pack").sortWithinPartitions("of", "pack")
    return dealt.select("sources", F.explode("ids").alias("node")).select(F.explode("sources").alias("s"), "node")
