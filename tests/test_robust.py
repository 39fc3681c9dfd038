import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cascata.operators import fixpoint, kernels, robust, seeding, transforms, worlds

F1 = ("1-0 2-1 4-1 4-2 2-3 3-4", [3, 4, 1, 0, 2], [5, 4, 3, 1, 1])
F2 = ("0-1 1-2 2-3 3-0 3-4 4-6 6-5 5-4 7-6 8-6 8-7 9-10 10-11 11-9 11-12 12-11 12-13 13-14", [5, 0, 1, 2, 3, 4, *range(6, 16)], [7, *[6] * 9, 5, 4, 3, 2, 1, 1])
F4 = ("0-11 11-0 1-10 10-1 10-9 9-11 2-3 4-8 8-7 7-6 6-5 5-4 9-12", list(range(13)), [6, 5, 5, 5, 5, 4, 4, 4, 4, 4, 1, 1, 1])


def edges_of(text):
    return [tuple(map(int, e.split("-"))) for e in text.split()]


def frames(spark, text, order):
    live = spark.createDataFrame([(0, a, b) for a, b in edges_of(text)], "world int, src long, dst long")
    return live, spark.createDataFrame([(v, i) for i, v in enumerate(order)], "node long, rank int")


@pytest.mark.parametrize("text,order,expected", [F1, F2, F4])
def test_golden_sequences(spark, text, order, expected):
    live, ranks = frames(spark, text, order)
    got = {r["l"]: r["max_reach"] for r in kernels.max_reach(live, ranks, 1).collect()}
    assert [got[k] for k in range(len(order))] == expected
    closure = robust.closure(live, ranks, 1)
    got = {r["l"]: r["sum_max_reach"] for r in robust.sequence(closure, len(order), 1).collect()}
    assert [got[k] for k in range(len(order))] == expected


def test_single_node_without_edges(spark):
    live = spark.createDataFrame([], "world int, src long, dst long")
    order = spark.createDataFrame([(0, 0)], "node long, rank int")
    assert [tuple(r) for r in kernels.max_reach(live, order, 1).collect()] == [(0, 0, 1)]


def test_three_seeds_reach_no_less(spark):
    live, ranks = frames(spark, F4[0], F4[1])
    one, three = (kernels.greedy_reach(live, ranks, 1, k, [0, 5]).orderBy("l").collect() for k in (1, 3))
    assert [r["reach"] for r in one] == [6, 4] and all(a["reach"] <= b["reach"] for a, b in zip(one, three))


def test_components_by_level(spark):
    live, ranks = frames(spark, F2[0], F2[1])
    got = {r["l"]: r["n_scc"] for r in kernels.scc_by_level(live, ranks, 1).collect()}
    assert got[10] == 5
    edges = live.select("src", "dst")
    scc = {r["node"]: r["scc"] for r in fixpoint.strong_components(edges, transforms.nodes(edges)).collect()}
    groups = {}
    for v, s in scc.items():
        groups.setdefault(s, set()).add(v)
    assert {0, 1, 2, 3} in groups.values() and {9, 10, 11, 12} in groups.values() and {4, 5, 6} in groups.values()
    blocked = transforms.block(edges, spark.createDataFrame([(5,)], "node long"))
    sizes = fixpoint.strong_components(blocked, transforms.nodes(blocked)).groupBy("scc").count().collect()
    assert sorted(r["count"] for r in sizes)[-2:] == [4, 4]


def brute_sequence(n, edges, order):
    out = []
    for level in range(n):
        left = set(order[level:])
        best = 0
        for s in left:
            seen, stack = {s}, [s]
            while stack:
                u = stack.pop()
                for a, b in edges:
                    if a == u and b in left and b not in seen:
                        seen.add(b)
                        stack.append(b)
            best = max(best, len(seen))
        out.append(best)
    return out


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_bottleneck_matrix_against_search(data):
    n = data.draw(st.integers(1, 8))
    edges = sorted(data.draw(st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).filter(lambda e: e[0] != e[1]), max_size=20)))
    order = data.draw(st.permutations(range(n)))
    rank = np.argsort(order).astype(np.int32)
    b = kernels.bottleneck_matrix(n, np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int), rank)
    got = kernels.reach_by_level(b).max(0).tolist()
    assert got == brute_sequence(n, edges, order)
    assert got == sorted(got, reverse=True)


def test_level_samples():
    assert seeding.levels(1, 5) == [0, 1, 2, 3, 4]
    assert seeding.levels(2, 20) == [0, 2, 6, 14]
    assert seeding.levels(1.5, 30) == [0, 1, 3, 6, 11, 18, 29]
    assert seeding.levels(1.1, 20) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 15, 18]


def test_simulation_with_a_blocked_node(spark):
    live = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "world int, src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    blocked = spark.createDataFrame([("None", -1), ("Three", 3)], "strategy string, node long")
    got = {r["strategy"]: r for r in robust.saved_nodes(live, seeds, blocked, 1, "None").collect()}
    assert got["None"]["activated"] == 4 and got["Three"]["activated"] == 2 and got["Three"]["saved"] == 2 and got["Three"]["fraction_saved"] == 0.5
    depth = worlds.simulate(live, seeds, 1).agg(F.max("depth")).first()[0]
    assert depth + 1 == 4


def test_reach_distances_and_weak_components(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 0, 1.0), (7, 8, 1.0)], "src long, dst long, distance double")
    start = spark.createDataFrame([(0,)], "node long")
    assert {(r["node"], r["depth"]) for r in fixpoint.reach(start, edges, []).collect()} == {(0, 0), (1, 1), (2, 1)}
    assert {(r["node"], r["distance"]) for r in fixpoint.shortest(start, edges, []).collect()} == {(0, 0.0), (1, 1.0), (2, 2.0)}
    assert {(r["node"], r["component"]) for r in fixpoint.weak_components(edges).collect()} == {(0, 0), (1, 0), (2, 0), (7, 7), (8, 7)}
