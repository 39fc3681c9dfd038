import numpy as np
import pytest

from cascata.functions import analytics as fn
from cascata.functions import results as res
from cascata.operators import transforms
from cascata.runtime import numbered


def series(spark, values, strategy="A"):
    return spark.createDataFrame([(strategy, k, float(v)) for k, v in enumerate(values)], "strategy string, l int, value double")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("l").collect()]


def test_windows(spark):
    s = series(spark, [4, 2, 6, 8])
    assert values(fn.moving_average(s, ["strategy"], 2), "average") == [None, None, 3.0, 4.0]
    assert values(fn.running_mean(s, ["strategy"]), "average") == [4, 3, 4, 5]
    assert values(fn.difference(s, ["strategy"]), "diff") == [None, -2, 4, 2]
    assert values(fn.relative_loss(s, ["strategy"]), "loss") == [0, 0.5, -0.5, -1]
    assert values(fn.next_ratio(s, ["strategy"]), "ratio") == [0.5, 3, pytest.approx(8 / 6), None]


def test_envelopes_and_scores(spark):
    both = series(spark, [4, 2, 6]).union(series(spark, [3, 5, 1], "B"))
    assert values(fn.envelope(both, [])) == [3, 2, 1] and values(fn.envelope(both, [], "max")) == [4, 5, 6]
    pairs = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 2.0), (2, 1.0, 1.0), (2, 0.0, 0.0)], "k int, p double, q double")
    jsd = {r["k"]: r["jsd"] for r in fn.jensen_shannon(pairs, ["k"]).collect()}
    p, q = np.array([0.25, 0.75]), np.array([0.5, 0.5])
    m = (p + q) / 2
    assert jsd[1] == pytest.approx(((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2) and jsd[2] == 0
    scored = fn.r2_score(pairs.filter("k = 1"), ["k"], "p", "q").first()["r2"]
    assert scored == pytest.approx(0.0)


def test_interpolation(spark):
    s = spark.createDataFrame([("A", 0, 0.0), ("A", 2, 4.0), ("A", 5, 1.0)], "strategy string, l int, value double")
    assert values(fn.interpolated(s, ["strategy"])) == [0, 2, 4, 3, 2, 1]
    x = np.array([0.0, 1, 2.5, 4, 7])
    at = np.linspace(0, 7, 15)
    cubic = lambda t: 2 * t**3 - t**2 + 3
    assert np.allclose(fn.not_a_knot(x, cubic(x), at), cubic(at))
    assert values(fn.spline(s, ["strategy"], 6))[2] == pytest.approx(4.0)
    fit = fn.cubic_fit(spark.createDataFrame([(1, float(t), float(cubic(t))) for t in range(6)], "k int, x double, y double"), ["k"]).first()
    assert [fit[c] for c in ("c3", "c2", "c1", "c0")] == pytest.approx([2, -1, 0, 3], abs=1e-6)


def test_result_shapes(spark):
    seeding = spark.createDataFrame([("1", "x Robust", "g", 1.0), ("2", "x Simulator", "s", 2.0), ("3", "x Rob", "i", 3.0), ("4", "x Rob", "none", 3.0)], "run string, cmd string, related_obj_id string, n double")
    graphs = spark.createDataFrame([("g", 50)], "graph_id string, n int")
    immunization = spark.createDataFrame([("i", "g", "Degree")], "imm_id string, graph string, solver string")
    simulations = spark.createDataFrame([("s", "g", 5)], "sim_id string, graph string, blocked int")
    got = {r["run"]: r for r in res.joined_results(seeding, immunization, simulations, graphs, robust="Robust").collect()}
    assert set(got) == {"1", "2", "3"} and all(r["n"] == 50 for r in got.values()) and got["3"]["solver"] == "Degree" and got["2"]["blocked"] == 5
    frame = spark.createDataFrame([("r", 10, ([0.1, 0.2],), None)], "run string, n int, sat struct<objectives:array<double>>, one struct<objectives:array<double>>")
    assert [tuple(r) for r in res.unfolded(frame, ["run"], ["sat", "one"], "n").collect()] == [("r", "sat", [1.0, 2.0])]
    back = res.collected(res.exploded(spark.createDataFrame([("r", [3.0, 1.0])], "run string, sequence array<double>"), ["run"]), ["run"])
    assert back.first()["sequence"] == [3.0, 1.0]
    maps = spark.createDataFrame([("r", [{"a": 1.0}, {"a": 2.0, "b": 5.0}])], "run string, o array<map<string,double>>")
    assert {r["name"]: r["values"] for r in res.map_of_lists(maps, ["run"], "o").collect()} == {"a": [1.0, 2.0], "b": [None, 5.0]}


def test_scalars(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        fn.initials(F.lit("number_of_seeds")), fn.title(F.lit("expected_max")), fn.flag_value(F.lit("x -s 12"), "s"), fn.contains_all(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))), fn.footprint(F.lit("b-a.5"))
    ).first()
    assert tuple(row) == ("nos", "Expected Max", 12, True, "a5_b")


def test_numbering_and_noisy_or(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 AS x")
    got = numbered(rows.repartition(7), [rows["x"].desc()], "k").collect()
    assert all(r["x"] == 999 - r["k"] for r in got) and len(got) == 1000
    edges = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0), (2, 0.3)], "dst long, weight double")
    assert dict(transforms.noisy_or(edges, ["dst"]).collect()) == {1: pytest.approx(0.75), 2: 1.0}
