"""Graph statistics: degrees, assortativity, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transforms import nodes, undirected


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, degree of every node with an edge."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """One row: n, m, and least, largest, mean, population deviation and median degree."""
    stats = degrees(edges).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
        F.avg("degree").alias("avg_degree"),
        F.stddev_pop("degree").alias("std_degree"),
        F.percentile("degree", 0.5).alias("median_degree"),
    )
    return stats.crossJoin(edges.agg(F.count(F.lit(1)).alias("m")))


def assortativity(edges: DataFrame) -> DataFrame:
    """One row: correlation over edges of the source's out-degree with the target's in-degree."""
    d = degrees(edges)
    both = edges.join(d.select(F.col("node").alias("src"), F.col("out_degree").alias("x")), "src").join(d.select(F.col("node").alias("dst"), F.col("in_degree").alias("y")), "dst")
    return both.agg(F.corr("x", "y").alias("assortativity"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, triangles, degree, clustering on the undirected view; degree below 2 gives 0.

    Triangles are found once, from each edge's lower-degree end, so hubs do not multiply wedges.
    """
    pairs = undirected(edges)
    deg = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = pairs.join(deg.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    to = ranked.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = to.alias("p").join(to.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.x").alias("x"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    triangle = wedge.join(pairs, ["a", "b"])
    corners = triangle.select(F.explode(F.array("x", "a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    out = deg.join(corners, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))
    ratio = F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return out.withColumn("clustering", ratio)


def average_clustering(edges: DataFrame) -> DataFrame:
    return clustering(edges).agg(F.avg("clustering").alias("average_clustering"))


def analysed(graph_edges: DataFrame) -> DataFrame:
    """The enrichment row of a graph: degree statistics and clustering."""
    return degree_stats(graph_edges).crossJoin(average_clustering(graph_edges)).withColumn("directed", F.lit(True))


def node_count(edges: DataFrame) -> int:
    return nodes(edges).count()
