"""Graph transforms on edges(src, dst, ...): views, relabelling, blocking, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..coins import u32, uniform
from ..runtime import numbered


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct end points, as id."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse; an edge present both ways keeps its smallest weight columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    both = edges.select("src", "dst", *rest).union(swapped)
    return both.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in rest]) if rest else both.distinct()


def random_direction(edges: DataFrame, tag: str = "direction") -> DataFrame:
    """Each undirected edge (least, greatest) gets one direction by a fair coin."""
    flip = u32(tag, "a", "b") >= (1 << 31)
    return undirected(edges).select(F.when(flip, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def relabel(edges: DataFrame) -> DataFrame:
    """Dense ids 0..n-1 in order of the old ids."""
    ids = numbered(nodes(edges), [F.col("id")], "new")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    one = edges.join(ids.select(F.col("id").alias("src"), F.col("new").alias("new_src")), "src")
    two = one.join(ids.select(F.col("id").alias("dst"), F.col("new").alias("new_dst")), "dst")
    return two.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *rest)


def block(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges with neither end in blocked(node)."""
    b = blocked.select("node").distinct()
    return edges.join(b, edges["src"] == b["node"], "left_anti").join(b, edges["dst"] == b["node"], "left_anti")


def shrink(edges: DataFrame, order: DataFrame, keep: int) -> DataFrame:
    """Remove the first nodes of order(node, rank) until ``keep`` are left, and relabel what remains."""
    n = order.count()
    return relabel(block(edges, order.filter(F.col("rank") < n - keep).select("node")))


def replace_edges(edges: DataFrame, edgelist: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Graph scan with an edge list: only listed edges, with the list's weight where it has one."""
    own = block(edges, blocked) if blocked is not None else edges
    listed = edgelist.select("src", "dst", *([F.col("weight").alias("_w")] if "weight" in edgelist.columns else [F.lit(None).cast("double").alias("_w")]))
    return own.join(listed, ["src", "dst"]).withColumn("weight", F.coalesce("_w", "weight")).drop("_w")


def assign_weights(edges: DataFrame, scale: float, random: bool = False, tag: str = "weight") -> DataFrame:
    """Constant ``scale`` (1 where it is not positive), or uniform on (0, scale); scale -2 is uniform on (0, 1)."""
    if scale == -2:
        w = uniform(tag, "src", "dst")
    elif random:
        w = uniform(tag, "src", "dst") * scale
    else:
        w = F.lit(float(scale) if scale > 0 else 1.0)
    return edges.withColumn("weight", w)


def normalise_in_weights(edges: DataFrame, by: str = "weight") -> DataFrame:
    """Divide by the sum of a node's in-weights, or by its in-degree."""
    own = Window.partitionBy("dst")
    total = F.sum("weight").over(own) if by == "weight" else F.count(F.lit(1)).over(own)
    return edges.withColumn("weight", F.col("weight") / total)


def double_weights(edges: DataFrame) -> DataFrame:
    """Perturbation for resilience: doubled, and 0.99 where that exceeds 1."""
    return edges.withColumn("weight", F.when(2 * F.col("weight") > 1, 0.99).otherwise(2 * F.col("weight")))


def log_distance(edges: DataFrame) -> DataFrame:
    """-log of the weight, after 1 became 0.99999."""
    w = F.when(F.col("weight") >= 1, 0.99999).otherwise(F.col("weight"))
    return edges.withColumn("distance", -F.log(w))


def noisy_or(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Merge parallel edges: 1 - prod(1 - weight); 1 as soon as one weight is 1."""
    sure = F.max(F.col("weight") >= 1)
    logs = F.sum(F.when(F.col("weight") < 1, F.log1p(-F.col("weight"))))
    return edges.groupBy(*keys).agg(F.when(sure, 1.0).otherwise(1 - F.exp(logs)).alias("weight"))


def ego_networks(edges: DataFrame, least: int = 10, most: int = 50, least_edges: int = 10, most_edges: int = 300) -> DataFrame:
    """ego, n, m of every node whose out-neighbourhood (itself included) induces a subgraph of accepted size."""
    members = edges.select(F.col("src").alias("ego"), F.col("dst").alias("node")).union(edges.select("src", "src")).distinct()
    n = members.groupBy("ego").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most))
    own = members.join(n, "ego")
    inner = own.join(edges.select("src", "dst"), F.col("node") == F.col("src")).join(members.select(F.col("ego").alias("e2"), F.col("node").alias("n2")), (F.col("ego") == F.col("e2")) & (F.col("dst") == F.col("n2")))
    m = inner.groupBy("ego", "n").agg(F.count(F.lit(1)).alias("m"))
    return m.filter(F.col("m").between(least_edges, most_edges))
