"""Weighted directed graphs derived from the relational tables, as edges(src, dst, c), and their SQL.

c counts the events behind an edge; its activation probability is min(c, den) / den.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Denominators of the activation probability.
TRADE_DEN, SUPP_DEN = 2000, 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer's nation to supplier's nation, by line items.

    Orders get their nation first, so the line items are shuffled once, by order; what meets the suppliers
    is already summed up by nation and supplier.
    """
    read = lambda n: table(spark, sf_dir, n)
    orders = read("orders").select("o_orderkey", "o_custkey").join(read("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    lines = read("lineitem").select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "src"), F.col("l_orderkey") == F.col("o_orderkey"))
    by_supplier = lines.groupBy("src", "l_suppkey").agg(F.count(F.lit(1)).alias("k"))
    joined = by_supplier.join(read("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.filter("src <> dst").groupBy("src", "dst").agg(F.sum("k").alias("c"))


def _succession(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Pairs of neighbouring lines of an order; one shuffle by order gathers its few lines, then pairs are counted."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("at"), F.col(key).alias("v")).alias("x"))
    own = lines.groupBy("l_orderkey").agg(F.collect_list("x").alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda a: F.transform(F.filter("xs", lambda b: (b["at"] == a["at"] + 1) & (b["v"] != a["v"])), lambda b: F.struct(a["v"].alias("src"), b["v"].alias("dst")))))
    return own.select(F.explode(pairs).alias("e")).groupBy(F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.count(F.lit(1)).alias("c"))


def supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier of a line to the supplier of the next line of the order."""
    return _succession(spark, sf_dir, "l_suppkey")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of a line to the part of the next line of the order."""
    return _succession(spark, sf_dir, "l_partkey")


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User of an event to the user of the next event of its type on its day."""
    day = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst"))
    return events.filter("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))


TRADE_SQL = """SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"""


def _succession_sql(key: str) -> str:
    return f"""SELECT a.{key} AS src, b.{key} AS dst, count(*) AS c FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.{key} <> b.{key} GROUP BY 1, 2"""


SUPP_SQL, PART_SQL = _succession_sql("l_suppkey"), _succession_sql("l_partkey")
USER_SQL = """SELECT src, dst, count(*) AS c FROM (
    SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2"""
