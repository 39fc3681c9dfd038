"""Sketches drawn in one task for each weak component: a sketch never leaves that of its root.

A component's in-edges are packed into one row once, as arrays; a round of sketches then moves only their roots and
these rows.  Linear threshold uses the same draws as the relational rounds.  Independent cascade draws the place of a
node's next live in-edge at once, instead of a coin for each in-edge, so that its time follows the live edges.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..coins import mixed
from ..runtime import cut
from .fixpoint import weak_components

#: In-edges of a component that fits a task, at 16 bytes an edge; larger ones are for relational rounds.
TASK_EDGES = 8_000_000
#: Least logarithm of a chance of an edge not being alive: below that of the smallest draw, 2 ** -53.
SURE = -40.0


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component, m of every node, of nodes(id) or with an edge: its weak component's smallest node and in-edges."""
    found = weak_components(edges.select("src", "dst"))
    ids = nodes.select(F.col("id").alias("node")).union(edges.select("src")).union(edges.select("dst")).distinct()
    named = cut(ids.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    sizes = edges.select(F.col("dst").alias("node")).join(named, "node").groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    return cut(named.join(sizes, "component", "left").select("node", "component", F.coalesce("m", F.lit(0)).cast("long").alias("m")))


def packed(edges: DataFrame, named: DataFrame) -> DataFrame:
    """component, ids, ends, src, c: the in-edges of each component by dst and src, as bytes of arrays."""
    own = edges.select("src", "dst", "c").join(named.filter(F.col("m") <= TASK_EDGES).select(F.col("node").alias("dst"), "component"), "dst")

    def run(table):
        src, dst, c = (table.column(k).to_numpy() for k in ("src", "dst", "c"))
        order = np.lexsort((src, dst))
        ids = np.unique(np.concatenate((src, dst)))
        src, dst = np.searchsorted(ids, src[order]), np.searchsorted(ids, dst[order])
        ends = np.cumsum(np.bincount(dst, minlength=len(ids)))
        values = (ids.astype(np.int64), ends.astype(np.int64), src.astype(np.int32), c[order].astype(np.int64))
        return pa.table({"component": table.column("component")[:1], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(("ids", "ends", "src", "c"), values)}})

    return cut(own.groupBy("component").applyInArrow(run, "component long, ids binary, ends binary, src binary, c binary"))


def _draws_lt(name: np.ndarray, rr: np.ndarray) -> np.ndarray:
    """The coins u32("rrlt", node, rr_id)."""
    return np.array([int(hashlib.md5(f"rrlt-{v}-{k}".encode()).hexdigest()[:8], 16) for v, k in zip(name.tolist(), rr.tolist())], np.int64)


def lt_step(ids, first, ends, src, upto, den, rr, node):
    """rr, node of the in-neighbours that the nodes pick; ``upto`` has the sums of c from the first edge on."""
    base = np.where(first[node] > 0, upto[first[node] - 1], 0)
    total = np.where(ends[node] > first[node], upto[np.maximum(ends[node], 1) - 1], base) - base
    # draw * max(total, den) < 2 ** 64: in Python's integers where it might not be
    scale = np.maximum(total, den)
    draw = _draws_lt(ids[node], rr)
    value = np.array([d * s >> 32 for d, s in zip(draw.tolist(), scale.tolist())], np.int64)
    hit = np.flatnonzero(value < total)
    return rr[hit], src[np.searchsorted(upto, base[hit] + value[hit], side="right")].astype(np.int64)


def ic_step(ids, first, ends, src, upto, den, rr, node):
    """rr, node of the live in-neighbours; ``upto`` has the sums of -log(1 - p) from the first edge on."""
    out = [(rr[:0], node[:0])]
    at = first[node]
    while len(rr):
        own = mixed(mixed(rr.astype(np.uint64)) ^ mixed(ids[node].view(np.uint64) ^ mixed((at - first[node]).astype(np.uint64) + np.uint64(1))))
        draw = ((own >> np.uint64(11)).astype(float) + 1) / float(1 << 53)
        before = np.where(at > 0, upto[np.maximum(at, 1) - 1], 0.0)
        # the first edge up to which none is alive with a chance below the draw
        place = np.maximum(np.searchsorted(upto, before - np.log(draw), side="right"), at)
        left = place < ends[node]
        rr, node, place = rr[left], node[left], place[left]
        out.append((rr, src[place].astype(np.int64)))
        at = place + 1
        more = at < ends[node]
        rr, node, at = rr[more], node[more], at[more]
    return tuple(np.concatenate(x) for x in zip(*out))


def drawn(graphs: DataFrame, named: DataFrame, roots: DataFrame, den: int, model: str) -> DataFrame:
    """rr_id, node, depth of the sketches of roots(rr_id, node), for roots in components of at most TASK_EDGES in-edges."""
    step = {"ic": ic_step, "lt": lt_step}[model]
    asked = roots.join(named.filter(F.col("m") <= TASK_EDGES), "node").select(F.col("component").alias("at"), "rr_id", "node")

    def run(key, graph, asked):
        rr, name = asked.column("rr_id").to_numpy().astype(np.int64), asked.column("node").to_numpy()
        rows = [(rr, name, 0)] if len(rr) else []
        if len(rr) and graph.num_rows:
            ids, ends, src, c = (np.frombuffer(graph.column(k)[0].as_buffer(), t) for k, t in (("ids", np.int64), ("ends", np.int64), ("src", np.int32), ("c", np.int64)))
            first = np.append(0, ends[:-1])
            if model == "lt":
                upto = np.cumsum(c)
            else:
                with np.errstate(divide="ignore"):
                    upto = np.cumsum(-np.maximum(np.log1p(-np.minimum(c, den) / den), SURE))
            # a sketch and a node as one number
            sketches, number = np.unique(rr, return_inverse=True)
            new = number * len(ids) + np.searchsorted(ids, name)
            seen, depth = np.unique(new), 0
            new = seen
            while len(new):
                depth += 1
                near = step(ids, first, ends, src, upto, den, sketches[new // len(ids)], new % len(ids))
                new = np.unique(np.searchsorted(sketches, near[0]) * len(ids) + near[1])
                new = new[~np.isin(new, seen, assume_unique=True)]
                seen = np.union1d(seen, new)
                rows.append((sketches[new // len(ids)], ids[new % len(ids)], depth))
        none = np.zeros(0, np.int64)
        rr, node, depth = (np.concatenate(x) for x in zip((none, none, none), *[(a, b, np.full(len(a), d)) for a, b, d in rows]))
        return pa.table({"rr_id": rr.astype(np.int32), "node": node.astype(np.int64), "depth": depth.astype(np.int32)})

    return graphs.groupBy("component").cogroup(asked.groupBy("at")).applyInArrow(run, "rr_id int, node long, depth int")
