import hashlib
import math

import pytest
from pyspark.sql import functions as F

from cascata.operators import kernels, robust, seeding, sketches, transforms, worlds
from cascata.plans import diffusion
from cascata.sources import derived

DEN = 10


def graph(spark, triples):
    return spark.createDataFrame([(a, b, round(p * DEN)) for a, b, p in triples], "src long, dst long, c long")


F7 = [(0, 1, 0.1), (1, 2, 0.9), (2, 3, 0.5), (3, 4, 0.4), (4, 5, 0.3)]


def path(n, p=0.5):
    return [(k, k + 1, p) for k in range(n - 1)]


def test_best_single_seed_and_closed_forms(spark):
    edges = graph(spark, F7)
    rr = sketches.rr_sets(edges, transforms.nodes(edges), DEN, 4000).select("rr_id", "node").cache()
    assert seeding.greedy_cover(rr, 1)[0][0] == 1
    for seeds, expected in (((1,), 2.584), ((2, 3), 2.52), ((1, 2, 3, 4), 4.3)):
        got = sketches.set_influence(rr, spark.createDataFrame([(v,) for v in seeds], "node long"), 6, 4000).first()["influence"]
        assert got == pytest.approx(expected, rel=0.05)


def test_forward_and_reverse_agree(spark):
    edges = graph(spark, F7)
    seeds = spark.createDataFrame([(1,)], "node long")
    active = worlds.simulate(worlds.live_ic(edges, DEN, 2000), seeds, 2000)
    assert worlds.spread(active, [], 2000).first()["mean"] == pytest.approx(2.584, rel=0.05)


def test_certain_and_impossible_edges(spark):
    edges = spark.createDataFrame([(0, 1, DEN), (1, 2, 0), (2, 3, 2 * DEN)], "src long, dst long, c long")
    live = {(r["src"], r["dst"]): r["n"] for r in worlds.live_ic(edges, DEN, 50).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert live == {(0, 1): 50, (2, 3): 50}


def test_linear_threshold_picks_one_edge(spark):
    edges = spark.createDataFrame([(0, 3, 4), (1, 3, 4), (2, 3, 4), (0, 2, 3)], "src long, dst long, c long")
    live = worlds.live_lt(edges, DEN, 600)
    assert live.groupBy("world", "dst").count().agg(F.max("count")).first()[0] == 1
    n = {(r["src"], r["dst"]): r["count"] for r in live.groupBy("src", "dst").count().collect()}
    assert sum(n[a, 3] for a in range(3)) == 600 and all(n[a, 3] == pytest.approx(200, abs=50) for a in range(3))
    assert n[0, 2] == pytest.approx(180, abs=45)


def test_dynamic_sequence_on_a_path(spark):
    edges = graph(spark, path(7))
    order = spark.createDataFrame([(6 - k, k) for k in range(7)], "node long, rank int")
    got = {r["l"]: r["influence"] for r in robust.dynamic_influence(edges, transforms.nodes(edges), order, DEN, 3000, list(range(6))).collect()}
    for level in range(6):
        assert got[level] == pytest.approx(1 + sum(0.5**j for j in range(1, 7 - level)), rel=0.08)


@pytest.mark.parametrize(
    "triples,blocked,k",
    [
        ([(0, 1, 0.1), (1, 2, 0.9), (2, 3, 0.5), (3, 4, 0.4), (4, 5, 0.3), (5, 6, 0.3), (6, 7, 0.3), (7, 6, 0.3), (6, 5, 0.3)], [(0, 1, 2), (3, 4, 5)], 2),
        (path(15), [(7,), (11,), (13,)], 3),
    ],
)
def test_saturate_is_no_worse(spark, triples, blocked, k):
    edges = graph(spark, triples)
    gone = spark.createDataFrame([(f"A{i}", v) for i, own in enumerate(blocked) for v in own], "strategy string, node long")
    rr, sizes = robust.strategy_sketches(edges, transforms.nodes(edges), gone, DEN, 400)
    rr = rr.cache()
    one = seeding.single_greedy(rr, sizes, k)
    every = seeding.all_greedy(rr, sizes, k)
    best = seeding.saturate(rr, sizes, k, gamma=0.05)
    assert len(one[0]) == k and best[1] >= one[1] - 1e-9 and best[1] >= every[2] - 1e-9


def test_coverage_is_submodular_and_weighted(spark):
    rr = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 2), (2, 3), (3, 3)], "rr_id int, node long")
    assert seeding.greedy_cover(rr, 3) == [(2, 3), (3, 1)]
    reward = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0), (3, 9.0)], "rr_id int, reward double")
    assert seeding.greedy_cover(rr, 1, reward) == [(3, 10.0)]
    assert sketches.covered_reward(rr, spark.createDataFrame([(1,), (3,)], "node long"), reward).first()["reward"] == 11.0


def test_sample_sizes():
    assert seeding.log_choose(10, 3) == pytest.approx(math.log(120))
    assert seeding.imm_round_size(1000, 5, 0.2, 2) == pytest.approx(2 * seeding.imm_round_size(1000, 5, 0.2, 1))
    assert seeding.imm_final_size(1000, 5, 0.1, 50) > seeding.imm_final_size(1000, 5, 0.2, 50)


def test_imm_on_a_star(spark):
    edges = graph(spark, [(0, k, 0.9) for k in range(1, 12)] + [(20, k, 0.2) for k in range(1, 12)])
    ids = transforms.nodes(edges)
    picked, r = seeding.imm(lambda first, r: sketches.rr_sets(edges, ids, DEN, r, first=first).select("rr_id", "node"), ids.count(), 1, 0.5)
    assert picked[0][0] == 0 and r <= 500


def test_continuous_horizon(spark):
    edges = spark.createDataFrame([(0, 1, 1.0, 1e-9), (1, 2, 1.0, 1e9)], "src long, dst long, shape double, scale double")
    rr = sketches.rr_sets_continuous(edges, transforms.nodes(edges), 60, 1.0)
    held = {}
    for r in rr.collect():
        held.setdefault(r["rr_id"], set()).add(r["node"])
    assert set(map(frozenset, held.values())) == {frozenset({0}), frozenset({0, 1}), frozenset({2})}


def test_log_det(spark):
    rows = [(0, 0, 0, 1), (0, 0, 1, 2), (0, 0, 2, 0), (1, 5, None, None), (2, 0, 1, 2)]
    got = {r["rr_id"]: r["reward"] for r in kernels.log_det(spark.createDataFrame(rows, "rr_id int, root long, src long, dst long")).collect()}
    assert got[0] == pytest.approx(math.log(3)) and got[1] == 0 and got[2] == 0


def test_reward_of_seeds_in_no_sketch_is_null(spark):
    rr = spark.createDataFrame([(0, 1), (1, 2)], "rr_id int, node long")
    reward = spark.createDataFrame([(0, 1.0), (1, 1.0)], "rr_id int, reward double")
    assert sketches.covered_reward(rr, spark.createDataFrame([(9,)], "node long"), reward).first()["reward"] is None


def test_weighted_reward_takes_the_graphs_own_chances(spark, sf_dir):
    """The registered query against sketches walked one by one, with every edge's chance c / SUPP_DEN."""
    edges = {(r["src"], r["dst"]): r["c"] for r in derived.supp(spark, sf_dir).collect()}
    coin = lambda *key: int(hashlib.md5("-".join(map(str, key)).encode()).hexdigest()[:8], 16)
    ids, into = sorted({v for e in edges for v in e}), {}
    for (a, b), c in edges.items():
        into.setdefault(b, []).append((a, c))
    reward = 0
    for k in range(diffusion.SKETCHES):
        held = new = {ids[coin("root", k) * len(ids) >> 32]}
        while new:
            new = {a for b in new for a, c in into.get(b, ()) if coin("rric", a, b, k) * derived.SUPP_DEN < min(c, derived.SUPP_DEN) << 32} - held
            held = held | new
        reward += (1 + k % 5) * bool(held & set(diffusion.SEEDS))
    assert diffusion.rr_weighted_reward(spark, sf_dir).first()["reward"] == reward
