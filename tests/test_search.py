import time

import pytest

from cascata.operators import condense, fixpoint, search, statistics, tables, transforms, worlds
from cascata.sources import generators


def test_rewiring_keeps_degrees_and_raises_assortativity(spark):
    edges = generators.binomial(spark, 60, 0.08)
    before, degrees = statistics.assortativity(edges).first()[0], sorted(map(tuple, statistics.degrees(edges).collect()))
    after = search.improve_assortativity(edges, 40, rounds=6)
    assert sorted(map(tuple, statistics.degrees(after).collect())) == degrees
    assert after.distinct().count() == edges.count() and after.filter("src = dst").count() == 0
    assert statistics.assortativity(after).first()[0] > before + 0.05


def test_climb_never_loses(spark):
    edges = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (1, 2), (3, 4)], "src long, dst long")
    score = lambda e: float(e.filter("src = 0 AND dst = 3").count())
    _, best = search.climb(edges, score, patience=3)
    assert best >= score(edges)


def test_greedy_removal():
    assert search.greedy_removal([1, 2, 3], lambda gone: -sum(gone), 2) == [(1, -1), (2, -3)]


def test_condensation_and_cycles(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (0, 2), (2, 3)], "src long, dst long")
    scc = fixpoint.strong_components(edges, transforms.nodes(edges))
    between, sizes = condense.condensed(edges, scc)
    assert sorted(map(tuple, between.collect())) == [(0, 2, 2), (2, 3, 1)]
    assert dict(sizes.collect()) == {0: 2, 2: 1, 3: 1}
    assert condense.is_acyclic(between) and not condense.is_acyclic(edges)


def test_table_functions_equal_the_operators(spark):
    tables.register(spark)
    edges = spark.createDataFrame([(0, 1, 5), (1, 2, 9)], "src long, dst long, c long")
    edges.createOrReplaceTempView("some_edges")
    got = spark.sql("SELECT w.world, src, dst FROM some_edges, LATERAL world_edges(src, dst, c, 10, 30) w WHERE w.live").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, worlds.live_ic(edges, 10, 30).collect()))


def test_shrink_by_degree_and_reseed(spark):
    """A larger network is shrunk by its own hubs, relabelled, and seeded anew."""
    from cascata.operators import immunize
    from cascata.requests import InfluenceMaximisation

    edges = generators.generate(spark, "powerlaw_cluster", 0.5, n=40, mm=3, p=0.4).selectExpr("src", "dst", "500000L AS c")
    left = transforms.shrink(edges, immunize.degree(edges), 25)
    ids = [r["id"] for r in transforms.nodes(left).collect()]
    assert len(ids) <= 25 and sorted(ids) == list(range(len(ids)))
    assert InfluenceMaximisation(seeds=1, epsilon=0.5).run(left).count() == 1


def test_time_limit(spark):
    assert tables.within(spark, 60, lambda: spark.range(10).count()) == 10
    slow = spark.range(0, 4, 1, 4).mapInPandas(lambda it: (time.sleep(30) or p for p in it), "id long")
    with pytest.raises(TimeoutError):
        tables.within(spark, 1, slow.count)


def test_greedy_removal_order_of_the_whole_trade_graph(spark, sf_dir):
    from cascata.operators import worlds
    from cascata.plans.diffusion import TRADE_DEN, greedy_removal_order
    from cascata.sources.derived import trade

    edges = trade(spark, sf_dir)
    out = [{} for _ in range(5)]
    for r in worlds.live_ic(edges, TRADE_DEN, 5).collect():
        out[r["world"]].setdefault(r["src"], set()).add(r["dst"])
    left = {v for r in edges.collect() for v in (r["src"], r["dst"])}

    def reached(own, rest, at):
        seen, todo = {at}, [at]
        while todo:
            new = own.get(todo.pop(), set()) & rest - seen
            seen |= new
            todo += new
        return len(seen)

    expected = []
    while len(left) > 3:
        value, node = max((sum(max(reached(own, left - {v}, s) for s in left - {v}) for own in out) / 5, -v) for v in left)
        expected.append((len(expected), -node, value))
        left.remove(-node)
    assert [tuple(r) for r in greedy_removal_order(spark, sf_dir).orderBy("pos").collect()] == expected
    assert len(expected) == 22
