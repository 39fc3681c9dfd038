"""Collections of rows by tag, kept as Parquet partitions below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTIONS = ("parameters", "graphs", "immunization", "simple_seeding", "imm_simulations", "seeding", "analysis", "experiments")


class Store:
    """insert, find, count, update and remove rows of a collection; every row carries its tag."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, collection: str) -> str:
        if collection not in COLLECTIONS:
            raise KeyError(f"unknown collection {collection!r}")
        return f"{self.folder}/{collection}"

    def insert(self, collection: str, rows: DataFrame, tag: str) -> None:
        rows.withColumn("created", F.current_timestamp().cast("string")).withColumn("tag", F.lit(tag)).write.mode("append").partitionBy("tag").parquet(self._path(collection))

    def overwrite(self, collection: str, rows: DataFrame, tag: str) -> None:
        """Replace the tag's rows and no others."""
        rows.withColumn("created", F.current_timestamp().cast("string")).withColumn("tag", F.lit(tag)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").parquet(self._path(collection))

    def find(self, collection: str, tag: str | None = None) -> DataFrame | None:
        try:
            rows = self.spark.read.option("mergeSchema", True).parquet(self._path(collection))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return rows if tag is None else rows.filter(F.col("tag") == tag)

    def count(self, collection: str, tag: str) -> int:
        rows = self.find(collection, tag)
        return 0 if rows is None else rows.count()

    def update(self, collection: str, tag: str, key: str, changes: DataFrame) -> None:
        """Set columns of the rows that ``changes`` has by key; others stay."""
        from ..runtime import cut

        rows = self.find(collection, tag)
        new = [c for c in changes.columns if c != key]
        kept = rows.drop("tag", "created").join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in new]), key, "left")
        for c in new:
            kept = kept.withColumn(c, F.coalesce(f"_{c}", c) if c in rows.columns else F.col(f"_{c}")).drop(f"_{c}")
        self.overwrite(collection, cut(kept), tag)

    def remove(self, collection: str, tag: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path(collection)}/tag={tag}")
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
