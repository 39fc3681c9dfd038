"""Change-logs of a graph: batch application, and incremental maintenance with Structured Streaming.

Operations: ``in`` and ``dn`` insert and delete a node (deleting takes its edges along), ``ie``, ``de`` and
``ce`` insert, delete and re-weight an edge.  An insertion that repeats a present edge, makes a loop or
names an absent node is ignored, and so is a change of an absent edge.  As all coins are pure functions
of ids, any evaluation after a log equals one from scratch on the graph that ``apply_log`` gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut


def apply_log(edges: DataFrame, nodes: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(src, dst, weight) and nodes(id) after log(seq, op, src, dst, weight), seq being non-negative and unique."""
    base_nodes = nodes.select(F.lit(-1).cast("long").alias("seq"), F.lit("in").alias("op"), F.col("id").alias("node"))
    node_events = base_nodes.union(log.filter(F.col("op").isin("in", "dn")).select(F.col("seq").cast("long"), "op", F.col("src").alias("node")))
    base_edges = edges.select(F.lit(-1).cast("long").alias("seq"), F.lit("ie").alias("op"), "src", "dst", F.col("weight").cast("double").alias("weight"))
    edge_events = base_edges.union(log.filter(F.col("op").isin("ie", "de", "ce")).select(F.col("seq").cast("long"), "op", "src", "dst", F.col("weight").cast("double")))
    edge_events = edge_events.filter("src <> dst")

    # a node's presence at every insertion of one of its edges: the last node event before it
    ends = edge_events.filter("op = 'ie'").select("seq", F.explode(F.array("src", "dst")).alias("node"))
    mixed = node_events.select("node", "seq", "op").unionByName(ends.select("node", "seq", F.lit("?").alias("op")))
    before = F.last(F.when(F.col("op") != "?", F.col("op")), True).over(Window.partitionBy("node").orderBy("seq", F.col("op") == "?"))
    absent = mixed.withColumn("state", before).filter("op = '?' AND (state IS NULL OR state = 'dn')").select("node", "seq")
    valid = _without(edge_events, absent.distinct())

    gone = node_events.filter("op = 'dn'").select("seq", "node")
    pairs = edge_events.select("src", "dst").distinct()
    hits = pairs.join(gone.withColumnRenamed("node", "src"), "src").select("src", "dst", "seq").union(pairs.join(gone.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "seq"))
    deleted = valid.filter("op = 'de'").select("src", "dst", "seq").union(hits).groupBy("src", "dst").agg(F.max("seq").alias("deleted"))
    since = valid.filter("op <> 'de'").join(deleted, ["src", "dst"], "left").filter("deleted IS NULL OR seq > deleted")
    first = since.filter("op = 'ie'").groupBy("src", "dst").agg(F.min(F.struct("seq", "weight")).alias("made"))
    changed = since.filter("op = 'ce'").join(first, ["src", "dst"]).filter("seq > made.seq").groupBy("src", "dst").agg(F.max(F.struct("seq", "weight")).alias("last"))
    new_edges = first.join(changed, ["src", "dst"], "left").select("src", "dst", F.when(F.col("last").isNotNull(), F.col("last.weight")).otherwise(F.col("made.weight")).alias("weight"))
    new_nodes = node_events.groupBy("node").agg(F.max(F.struct("seq", "op")).alias("e")).filter("e.op = 'in'").select(F.col("node").alias("id"))
    return new_edges, new_nodes


def _without(events: DataFrame, bad: DataFrame) -> DataFrame:
    """Edge events less the insertions with an absent end."""
    b = bad.select("seq", F.col("node"))
    out = events.join(b, (events["seq"] == b["seq"]) & (events["src"] == b["node"]), "left_anti")
    return out.join(b, (out["seq"] == b["seq"]) & (out["dst"] == b["node"]), "left_anti")


class IncrementalGraph:
    """A graph that follows a stream of change-logs; each epoch's state is a table of its own below ``folder``.

    A batch that is delivered again overwrites the same epoch from the same predecessor, so restarts leave
    the same state.  ``observers`` are called with (epoch, edges, nodes) after each batch.
    """

    def __init__(self, spark: SparkSession, folder: str, edges: DataFrame, nodes: DataFrame):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.observers: list[Callable[[int, DataFrame, DataFrame], None]] = []
        self.epoch = -1
        self._write(-1, edges, nodes)

    def _path(self, epoch: int, name: str) -> str:
        return f"{self.folder}/epoch={epoch}/{name}"

    def _write(self, epoch: int, edges: DataFrame, nodes: DataFrame) -> None:
        edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).write.mode("overwrite").parquet(self._path(epoch, "edges"))
        nodes.select("id").write.mode("overwrite").parquet(self._path(epoch, "nodes"))

    def state(self, epoch: int | None = None) -> tuple[DataFrame, DataFrame]:
        at = self.epoch if epoch is None else epoch
        return self.spark.read.parquet(self._path(at, "edges")), self.spark.read.parquet(self._path(at, "nodes"))

    def on_batch(self, log: DataFrame, epoch: int) -> None:
        edges, nodes = apply_log(*self.state(epoch - 1), cut(log))
        self._write(epoch, edges, nodes)
        self.epoch = epoch
        for observer in self.observers:
            observer(epoch, *self.state())

    def follow(self, log_folder: str, checkpoint: str, files_per_batch: int = 1):
        """Start a query over JSON log files; one run takes all there is, in order of the files' names and times."""
        schema = "seq long, op string, src long, dst long, weight double"
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(log_folder)
        return stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_log(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, event_type, n of tumbling (or sliding) windows; works on streams, where ``late`` is the watermark."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, n of sessions that end after a gap."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
