"""Graph readers and writers: edge lists, attribute files, solution JSON, seed lists, change-logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transforms import block, both_directions, relabel, without_loops
from ..runtime import numbered

#: How each public edge-list layout is read: a regular expression of header lines, lines to skip, and flags.
LAYOUTS: dict[str, dict] = {
    "stanford": {"comment": r"^#", "relabel": True},
    "gnutella": {"comment": r"^#", "counts": True},
    "epinions": {"comment": r"^%", "counts": True, "both": True},
    "mit": {"comment": r"^%", "counts": True, "both": True},
    "brightkite": {"comment": r"^%", "counts": True, "loops": False},
    "blogs": {"comment": r"^%", "loops": False},
    "advogato": {"comment": r"^%", "loops": False},
    "dblp": {"comment": r"^%", "loops": False},
    "minnesota": {"comment": r"^%", "counts": True, "loops": False, "both": True},
}


def edge_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """src, dst, weight of a ``graph.csv`` without header."""
    return spark.read.schema("src long, dst long, weight double").option("sep", sep).csv(path)


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """key, value of ``key=value`` lines."""
    pair = F.split("value", "=", 2)
    return spark.read.text(path).filter(F.col("value").contains("=")).select(F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))


def public_graph(spark: SparkSession, path: str, layout: str, id_base: int = 0) -> DataFrame:
    """src, dst of a public network file.

    A line of counts (numbers before the first edge) is recognised by holding the number of edges that
    follow as its last number; a wrong count is an error.
    """
    how = LAYOUTS[layout]
    lines = spark.read.text(path).filter(~F.col("value").rlike(how["comment"]) & (F.trim("value") != ""))
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.select(fields.alias("f"))
    if how.get("counts"):
        head = rows.first()["f"]
        n = rows.count() - 1
        if int(head[-1]) != n:
            raise ValueError(f"{path}: {head[-1]} edges announced, {n} found")
        # the header is one line; it goes by its place, which a file's first partition keeps
        rows = lines.withColumn("_i", F.monotonically_increasing_id()).filter("_i > 0").select(fields.alias("f"))
    edges = rows.select((F.get("f", 0).cast("long") - id_base).alias("src"), (F.get("f", 1).cast("long") - id_base).alias("dst")).distinct()
    if how.get("loops", True) is False:
        edges = without_loops(edges)
    if how.get("both"):
        edges = both_directions(edges)
    return relabel(edges) if how.get("relabel") else edges


def adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of lines ``node neighbour neighbour ...``."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(f.alias("f"))
    return rows.select(F.get("f", 0).cast("long").alias("src"), F.explode(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))).cast("array<long>")).alias("dst"))


def solution(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """removal(strategy, rank, node) and edgelist(src, dst, weight) of solution JSON files.

    A node listed twice in an order is an error.
    """
    schema = "`Blocked nodes` array<long>, solver string, edgelist array<long>, weights array<double>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    removal = rows.select(F.col("solver").alias("strategy"), F.posexplode("Blocked nodes").alias("rank", "node"))
    twice = removal.groupBy("strategy", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{path}: a node is listed twice")
    pairs = rows.filter("size(edgelist) > 0").select(F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("edgelist") / 2).cast("int") - 1), lambda i: F.struct(F.get("edgelist", 2 * i).alias("src"), F.get("edgelist", 2 * i + 1).alias("dst"), F.get("weights", i).alias("weight")))).alias("i", "e"))
    return removal, pairs.select("e.*")


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    """pos, node of one id per line."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return numbered(rows.withColumn("_i", F.monotonically_increasing_id()), [F.col("_i")], "pos").select("pos", F.trim("value").cast("long").alias("node"))


def continuous_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, shape, scale of a continuous-time edge list."""
    return spark.read.schema("src long, dst long, shape double, scale double").option("sep", " ").csv(path)


def binary_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight of little-endian (int32, int32, float32) records; a file is read by one task."""
    import numpy as np
    import pandas as pd

    kind = np.dtype([("src", "<i4"), ("dst", "<i4"), ("weight", "<f4")])

    def run(batches):
        for pdf in batches:
            for blob in pdf["content"]:
                found = np.frombuffer(blob, kind)
                yield pd.DataFrame({"src": found["src"].astype("int64"), "dst": found["dst"].astype("int64"), "weight": found["weight"].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "src long, dst long, weight double")


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """seq, op, src, dst, weight of lines ``op a [b [p]]`` with op one of in, dn, ie, de, ce (node and edge updates)."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumn("seq", F.monotonically_increasing_id())
    return rows.select("seq", F.get(f, F.lit(0)).alias("op"), F.get(f, F.lit(1)).cast("long").alias("src"), F.get(f, F.lit(2)).cast("long").alias("dst"), F.get(f, F.lit(3)).cast("double").alias("weight"))


def write_graph(edges: DataFrame, folder: str, graph_id: str, **attrs) -> None:
    """``graph.csv`` and ``attributes.txt`` below a folder."""
    spark = edges.sparkSession
    own = edges.select("src", "dst", "weight")
    own.write.mode("overwrite").option("sep", " ").csv(f"{folder}/graph.csv")
    n = own.select(F.max(F.greatest("src", "dst"))).first()[0]
    table = {"n": 0 if n is None else n + 1, "m": own.count(), "graph_id": graph_id} | {("gg_m" if k == "m" else k): v for k, v in attrs.items()}
    spark.createDataFrame([(f"{k}={v}",) for k, v in table.items()], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/attributes.txt")


def write_solution(edges: DataFrame, blocked: list[int], solver: str, path: str, static: bool = False) -> None:
    """Solution JSON: the order, and the edges with neither end blocked as flat pairs with weights (1 if ``static``)."""
    spark = edges.sparkSession
    left = block(edges, spark.createDataFrame([(v,) for v in blocked], "node long"))
    rows = F.array_sort(F.collect_list(F.struct("src", "dst", (F.lit(1.0) if static else F.col("weight")).alias("weight"))))
    out = left.agg(rows.alias("e")).select(
        F.lit(solver).alias("solver"),
        F.lit(blocked).cast("array<long>").alias("Blocked nodes"),
        F.flatten(F.transform("e", lambda x: F.array(x["src"], x["dst"]))).alias("edgelist"),
        F.transform("e", lambda x: x["weight"]).alias("weights"),
    )
    out.coalesce(1).write.mode("overwrite").json(path)


def write_seeds(seeds: DataFrame, path: str) -> None:
    """One id per line, in order of ``pos``."""
    seeds.orderBy("pos").select(F.col("node").cast("string")).coalesce(1).write.mode("overwrite").text(path)


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
