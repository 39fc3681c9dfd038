"""python -m cascata EXPERIMENT.json [FOLDER]: run an experiment and print its resilience values."""

from __future__ import annotations

import json
import os
import sys


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    from .experiment import Experiment

    with open(args[0]) as f:
        given = json.load(f)
    given.setdefault("tag", os.path.splitext(os.path.basename(args[0]))[0])
    spark = SparkSession.builder.getOrCreate()
    Experiment(spark, given, args[1] if len(args) > 1 else None).run().show(100, False)


if __name__ == "__main__":
    main(sys.argv[1:])
