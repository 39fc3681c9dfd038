"""Shared folders, lineage cuts and distributed numbering."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as ``spark.checkpoint.dir`` names it.

    Where that setting is absent (tests on one machine) a temporary folder is used and set.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not path:
        if not current.isDefined() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="cascata-")
    if not current.isDefined():
        sc.setCheckpointDir(path)
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


#: Shuffle files of a plan are of no use once its result is in the shared folder.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, same_columns: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared folder and return it with its lineage cut.

    The plan's size estimate goes too: a join's is the product of its sides', so a loop would square it, and
    double its digits, with every round.  With ``same_columns`` it stays, and columns taken from ``df`` still name
    those of the result.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        done = df.checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)
    if same_columns:
        return done
    fresh = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(fresh, spark)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """``df`` with consecutive numbers in the given total order, without sorting all rows in one task.

    Rows are range-partitioned and numbered within partitions; only the partitions' row counts (one row
    per partition) are summed up in one place.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), same_columns=True)
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.join(F.broadcast(before), "_p").withColumn(name, (F.col("_b") + within - 1 + first).cast("long")).drop("_p", "_b")
