"""Memory that kernels leave behind in workers that are used again, and the files of the pipeline's stages."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from cascata.llm import simhash, substring_words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FREED = """
import numpy as np
from cascata.llm.common import give_up_kept

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

before = resident()
held = [np.ones(100_000, np.uint8) for _ in range(2000)]
last = held[-1]
del held
give_up_kept()
assert resident() - before < 50, resident() - before
"""


def test_freed_memory_goes_back_though_later_blocks_are_in_use():
    subprocess.run([sys.executable, "-c", FREED], cwd=ROOT, check=True)


def test_stages_of_few_documents_make_few_files(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(f"w{k}") for k in range(60)], F.col("id").cast("string")).alias("text"))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        own_root = lambda d: d.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("doc_id").alias("root"))
        one = simhash.keep_one(docs, own_root)
        assert one.rdd.getNumPartitions() <= 12 and one.count() == 300
        cut = substring_words.remove_repeats(docs)
        assert cut.rdd.getNumPartitions() <= 12 and cut.count() == 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
