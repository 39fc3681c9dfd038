"""Result rows: joins with their immunization and graph rows, unfolding of solver columns, nested values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _right_wins(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join in which the right side's columns replace the left side's of the same name."""
    kept = [c for c in left.columns if c == left_key or c not in right.columns]
    l, r = left.select(*kept, F.col(left_key).alias("_k")), right.withColumnRenamed(right_key, "_r") if right_key not in left.columns else right.withColumn("_r", F.col(right_key))
    if left_key in right.columns and left_key in l.columns:
        l = l.drop(left_key)
    return l.join(r, l["_k"] == r["_r"]).drop("_k", "_r")


# What stored commands of seed selections over all strategies, and of simulations, contain.
ROBUST, SIMULATOR = "SatGreedy", "Simulator"


def joined_results(seeding: DataFrame, immunization: DataFrame, simulations: DataFrame, graphs: DataFrame, robust: str = ROBUST, simulator: str = SIMULATOR) -> DataFrame:
    """Every result with its own rows, by which of the two marks its command contains.

    A seed selection over all strategies refers to a graph, a simulation to its request, anything else to
    an immunization; requests and immunizations refer to a graph.  The later table wins on equal names.
    """
    is_robust, is_simulation = F.contains("cmd", F.lit(robust)), F.contains("cmd", F.lit(simulator))
    sat, sim, rest = seeding.filter(is_robust), seeding.filter(~is_robust & is_simulation), seeding.filter(~is_robust & ~is_simulation)
    parts = [
        _right_wins(sat, graphs, "related_obj_id", "graph_id"),
        _right_wins(_right_wins(sim, simulations, "related_obj_id", "sim_id"), graphs, "graph", "graph_id"),
        _right_wins(_right_wins(rest, immunization, "related_obj_id", "imm_id"), graphs, "graph", "graph_id"),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unfolded(frame: DataFrame, ids: list[str], solvers: list[str], n: str | None = None) -> DataFrame:
    """One row per solver column that is not null: ids, solver, sequence (its objectives, times ``n`` if given)."""
    rows = [F.struct(F.lit(s).alias("solver"), F.col(f"{s}.objectives").alias("sequence")) for s in solvers]
    out = frame.select(*ids, *([n] if n and n not in ids else []), F.explode(F.array(*rows)).alias("x")).filter("x.sequence IS NOT NULL")
    seq = F.transform("x.sequence", lambda v: v * F.col(n)) if n else F.col("x.sequence")
    return out.select(*ids, F.col("x.solver").alias("solver"), seq.alias("sequence"))


def exploded(frame: DataFrame, ids: list[str], column: str = "sequence") -> DataFrame:
    """ids, l, value of an array column."""
    return frame.select(*ids, F.posexplode(column).alias("l", "value"))


def collected(series: DataFrame, ids: list[str]) -> DataFrame:
    """ids, sequence: the values in order of l."""
    return series.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "value"))), lambda x: x["value"]).alias("sequence"))


def map_of_lists(frame: DataFrame, ids: list[str], column: str) -> DataFrame:
    """ids, name, values: a list of maps turned into one list per map key, null where a map lacks it."""
    names = frame.select(*ids, F.explode(F.array_distinct(F.flatten(F.transform(column, F.map_keys)))).alias("name"), column)
    return names.select(*ids, "name", F.transform(column, lambda m: F.try_element_at(m, F.col("name"))).alias("values"))


def inverted(frame: DataFrame, outer: str = "solver", inner: str = "param") -> DataFrame:
    """Rows (solver, params map) as rows (param, solvers map)."""
    rows = frame.select(outer, F.explode("params").alias(inner, "_v"))
    return rows.groupBy(inner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(outer), F.col("_v"))))).alias("values"))


def merged(a: Column, b: Column) -> Column:
    """Two maps in one; the second wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def grouped_stats(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, mean and sample deviation by key; a deviation of one row is 0."""
    return frame.groupBy(*keys).agg(F.min(value).alias("least"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
