import json

import pytest

from cascata.operators import kernels
from cascata.requests import InfluenceMaximisation, Resilience, RobustSeeding, Simulation, sketch_error
from cascata.sources import files

DEN = 1_000_000


def path(spark, n, p=1.0):
    return spark.createDataFrame([(k, k + 1, int(p * DEN)) for k in range(n - 1)], "src long, dst long, c long")


def order(spark, nodes):
    return spark.createDataFrame([(v, i) for i, v in enumerate(nodes)], "node long, rank int")


def test_resilience(spark):
    edges, removal = path(spark, 6), order(spark, [5, 4, 3, 2, 1, 0])
    every = Resilience(iterations=2)
    assert [r["value"] for r in every.series(edges, removal).orderBy("l").collect()] == [6, 5, 4, 3, 2, 1]
    assert every.value(edges, removal) == pytest.approx(21 / 6)
    assert Resilience(iterations=2, blocked=2).value(edges, removal) == 4
    assert Resilience(iterations=2, alpha=2).value(edges, removal) == pytest.approx((6 + 5 + 4 + 4 + 4 + 4) / 6)
    assert [r["value"] for r in Resilience(iterations=2, seeds=2, blocked=0).series(edges, removal).collect()] == [6]
    with pytest.raises(ValueError):
        every.series(edges, order(spark, [0, 1]))
    with pytest.raises(ValueError):
        Resilience(blocked=6).series(edges, removal)
    with pytest.raises(AssertionError):
        Resilience(mode=0)


def test_resilience_of_worlds_that_fit_no_kernel(spark, monkeypatch):
    edges = spark.createDataFrame([(a, b, DEN // 2) for a, b in ((0, 1), (1, 2), (2, 3), (0, 3), (4, 1), (3, 5))], "src long, dst long, c long")
    removal = order(spark, [2, 0, 5, 1, 3, 4])
    series = lambda k: sorted(tuple(round(v, 9) for v in r) for r in Resilience(iterations=6, seeds=k).series(edges, removal).collect())
    small = [series(k) for k in (1, 2)]
    monkeypatch.setattr(kernels, "MAX_NODES", 3)
    assert [series(k) for k in (1, 2)] == small


def test_seeding_requests(spark):
    edges = path(spark, 8)
    assert InfluenceMaximisation(seeds=1, epsilon=0.5).run(edges).first()["node"] == 0
    gone = spark.createDataFrame([(0,)], "node long")
    assert InfluenceMaximisation(seeds=1, epsilon=0.5).run(edges, gone).first()["node"] == 1
    for bad in ({"epsilon": 1.0},):
        with pytest.raises(AssertionError):
            InfluenceMaximisation(**bad)
    blocked = spark.createDataFrame([("A", 0), ("B", 4)], "strategy string, node long")
    for method in ("single", "all", "saturate", "adversarial"):
        seeds, value = RobustSeeding(seeds=1, method=method, sketches=100).run(edges, blocked)
        assert seeds and value >= 0
    with pytest.raises(ValueError):
        RobustSeeding(seeds=7).run(edges, blocked)


def test_simulation(spark):
    edges = path(spark, 5)
    seeds = spark.createDataFrame([(0, 0), (1, 3)], "pos long, node long")
    blocked = spark.createDataFrame([("A", 0), ("B", 4)], "strategy string, node long")
    request = Simulation(iterations=3)
    got = request.run(edges, seeds, blocked)
    assert {r["strategy"]: r["mean"] for r in got.collect()} == {"A": 2, "B": 4}
    assert request.worst(got).first()["strategy"] == "A"
    one = Simulation(iterations=3, seeds=1).run(edges, seeds, blocked)
    assert {r["strategy"]: r["mean"] for r in one.collect()} == {"A": 2, "B": 4}
    assert sketch_error(10, 9) == pytest.approx(0.1)


def test_solution_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25), (2, 3, 0.75)], "src long, dst long, weight double")
    files.write_solution(edges, [0], "Degree", str(tmp_path / "s"))
    removal, listed = files.solution(spark, str(tmp_path / "s"))
    assert [r["node"] for r in removal.collect()] == [0]
    assert sorted(map(tuple, listed.collect())) == [(1, 2, 0.25), (2, 3, 0.75)]


def test_command_line(spark, tmp_path):
    from cascata.__main__ import main

    given = {"data": {"graph_type": "path", "weight_scale": 1.0, "n": 4}, "strategy": {"Degree": {}}, "solver": {"Rob": {"mode": 5, "iterations": 2}}, "problem": {"seeds": 1}}
    (tmp_path / "x.json").write_text(json.dumps(given))
    main([str(tmp_path / "x.json"), str(tmp_path / "out")])
