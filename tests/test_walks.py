"""Sketches drawn by component, against the relational rounds and against exact chances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cascata.operators import fixpoint, sketches, transforms, walks, worlds


def graph(spark):
    rows = [(base + (5 * k + j * j) % 12, base + k, 1 + (k + j) % 3) for base in (0, 100) for k in range(12) for j in (1, 2, 4)] + [(300, 300, 2)]
    return spark.createDataFrame(sorted({(a, b): c for a, b, c in rows}.items()), "e struct<src: long, dst: long>, c long").select("e.*", "c")


@pytest.mark.parametrize("task_edges", [walks.TASK_EDGES, 0])
def test_lt_sketches_equal_the_relational_rounds(spark, monkeypatch, task_edges):
    monkeypatch.setattr(walks, "TASK_EDGES", task_edges)
    edges = graph(spark)
    ids = transforms.nodes(edges)
    for den in (1, 9):
        back, alive = sketches.backward(edges, den, "lt")
        expected = fixpoint.reach(sketches.roots(ids, 60), back, ["rr_id"], [], alive)
        found = sketches.rr_sets(edges, ids, den, 60, "lt")
        assert sorted(map(tuple, found.collect())) == sorted((r["rr_id"], r["node"], r["depth"]) for r in expected.collect())


def test_ic_sketches_have_the_edges_chances(spark):
    rows = [(k, 50, k) for k in range(11)] + [(60, 4, 3)]
    edges = spark.createDataFrame(rows, "src long, dst long, c long")
    sampler = sketches.Sampler(edges, spark.createDataFrame([(50,)], "id long"), 10)
    n = 20_000
    found = {r["node"]: r["count"] / n for r in sampler.sample(0, n).groupBy("node").count().collect()}
    assert found[50] == found[10] == 1 and 0 not in found
    for k in range(1, 10):
        assert found[k] == pytest.approx(k / 10, abs=0.02)
    assert found[60] == pytest.approx(0.12, abs=0.02)
    both = {tuple(r)[:2] for r in sampler.sample(0, 50).collect()}
    assert both == {tuple(r)[:2] for r in sampler.sample(0, 20).union(sampler.sample(20, 50)).collect()}


def test_live_edges_are_drawn_once(spark):
    """A world's edges are not computed again in every round of a simulation."""
    drawn = spark.sparkContext.accumulator(0)

    def met(batches):
        for batch in batches:
            drawn.add(batch.num_rows)
            yield batch

    path = spark.createDataFrame([(0, k, k + 1) for k in range(6)], "world int, src long, dst long").mapInArrow(met, "world int, src long, dst long")
    active = worlds.simulate(path, spark.createDataFrame([(0,)], "node long"), 1)
    assert active.count() == 7 and drawn.value == 6


def test_reach_pairs_run_on_strong_components(spark, monkeypatch):
    """Two cycles in a row, a tail, and a node alone; the rounds meet components, not nodes."""
    met = []
    plain = fixpoint.reach
    monkeypatch.setattr(fixpoint, "reach", lambda frontier, *rest, **more: met.append(frontier.count()) or plain(frontier, *rest, **more))
    pairs = [(k, (k + 1) % 7) for k in range(7)] + [(10 + k, 10 + (k + 1) % 5) for k in range(5)] + [(3, 11), (3, 12), (14, 20), (20, 21), (20, 20)]
    ids = sorted({v for e in pairs for v in e} | {30})
    out = {v: {v} for v in ids}
    for _ in ids:
        for a, b in pairs:
            out[a] |= out[b]
        for v in ids:
            out[v] |= set().union(*(out[u] for u in out[v]))
    edges = spark.createDataFrame(pairs, "src long, dst long")
    found = fixpoint.reach_pairs(spark.createDataFrame([(v,) for v in [*ids, 0, 30]], "id long"), edges).collect()
    assert sorted(map(tuple, found)) == sorted((s, v) for s in ids for v in out[s])
    assert met[-1] == 5


def test_reach_pairs_of_a_large_component_are_small_files(spark, tmp_path):
    """All pairs of a cycle with chords, and a node alone: files take less than a quarter of a byte a pair."""
    n = 3000
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(*[(F.col("id") * k + 1) % n for k in (1, 3, 7, 11, 37)])).alias("dst"))
    fixpoint.reach_pairs(spark.range(n + 1), edges.distinct()).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.distinct().count() == found.count() == n * n + 1
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < n * n / 4


@pytest.mark.parametrize("task_edges", [8_000_000, 0])
def test_strong_components_by_task_equal_the_rounds(spark, monkeypatch, task_edges):
    monkeypatch.setattr(fixpoint, "TASK_EDGES", task_edges)
    rng = np.random.default_rng(3)
    pairs = [(base + int(a), base + int(b)) for base, n in ((0, 14), (50, 9)) for a, b in rng.integers(0, n, (n + 6, 2))]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    ids = spark.createDataFrame([(v,) for v in sorted({v for e in pairs for v in e} | {99})], "id long")
    found = fixpoint.strong_components_by_task(edges, ids).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, fixpoint.strong_components(edges, ids).collect()))
