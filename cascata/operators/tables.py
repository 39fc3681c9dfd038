"""Table functions for SQL, and stages with a time limit."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="world int, live boolean")
class WorldEdges:
    """world_edges(src, dst, num, den, worlds): the edge's coin in each world, equal to live_ic()."""

    def eval(self, src: int, dst: int, num: int, den: int, worlds: int) -> Iterator[tuple[int, bool]]:
        for world in range(worlds):
            coin = int(hashlib.md5(f"ic-{src}-{dst}-{world}".encode()).hexdigest()[:8], 16)
            yield world, coin * den < min(num, den) << 32


@udtf(returnType="rr_id int, root long")
class SketchRoots:
    """rr_roots(n, sketches): root numbers of sketches over nodes 0..n-1, equal to roots()."""

    def eval(self, n: int, sketches: int) -> Iterator[tuple[int, int]]:
        for k in range(sketches):
            yield k, int(hashlib.md5(f"root-{k}".encode()).hexdigest()[:8], 16) * n >> 32


def register(spark: SparkSession) -> None:
    spark.udtf.register("world_edges", WorldEdges)
    spark.udtf.register("rr_roots", SketchRoots)


def within(spark: SparkSession, seconds: float, work: Callable[[], object], group: str = "limited") -> object:
    """The result of ``work``; its Spark jobs are cancelled after ``seconds`` and TimeoutError is raised."""
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
