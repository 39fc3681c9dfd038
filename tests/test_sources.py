import json
import struct

import pytest

from cascata.experiment import Experiment
from cascata.operators import transforms
from cascata.params import DEFAULTS, Parameters, first_values, flat, footprint, star
from cascata.sources import files, generators
from cascata.sources.store import Store


def test_generators(spark):
    pairs = lambda df: sorted((r["src"], r["dst"]) for r in df.collect())
    path = generators.generate(spark, "path", 1.0, n=3)
    assert [tuple(r) for r in path.orderBy("src").collect()] == [(0, 1, 1.0), (1, 2, 1.0)]
    assert generators.grid(spark, 3).count() == 12
    assert generators.karate(spark).count() == 78 and transforms.nodes(generators.karate(spark)).count() == 34
    full = generators.binomial(spark, 20, 1.0)
    assert full.count() == 380
    sparse = generators.binomial(spark, 300, 0.05)
    assert sparse.distinct().count() == sparse.count() and abs(sparse.count() - 300 * 299 * 0.05) < 500
    plc = generators.powerlaw_cluster(spark, 100, 3, 0.4)
    assert plc.count() == 97 * 3 and plc.distinct().count() == 97 * 3
    ring = pairs(generators.watts_strogatz(spark, 10, 4, 0.0))
    assert len(ring) == 20 and (9, 1) in ring
    grp = generators.gaussian_random_partition(spark, 120, 20, 10, 0.5, 0.0)
    assert grp.filter("src = dst").count() == 0 and grp.count() > 500
    weighted = generators.generate(spark, "path", [0.1, 0.2], n=4)
    assert weighted.groupBy("weight_scale").count().count() == 2
    both = generators.generate(spark, "grid", 0.5, both=1, n=3)
    assert both.count() == 24
    with pytest.raises(ValueError):
        generators.generate(spark, "none")
    log = generators.update_workload(path, 400)
    assert log.filter("op = 'ie'").count() > log.filter("op = 'dn'").count()
    base, rest = generators.split_log(spark.createDataFrame([(1, 2, 30), (2, 3, 10), (3, 4, 20)], "src long, dst long, ts long"), 2)
    assert pairs(base) == [(2, 3), (3, 4)] and [tuple(r) for r in rest.collect()] == [(0, "ie", 1, 2)]


def test_file_round_trips(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25)], "src long, dst long, weight double")
    files.write_graph(edges, str(tmp_path / "g"), "abc", m=3, p=0.1)
    assert sorted(map(tuple, files.edge_list(spark, str(tmp_path / "g/graph.csv")).collect())) == [(0, 1, 0.5), (1, 2, 0.25)]
    attrs = dict(files.attributes(spark, str(tmp_path / "g/attributes.txt")).collect())
    assert attrs == {"n": "3", "m": "2", "graph_id": "abc", "gg_m": "3", "p": "0.1"}
    files.write_seeds(spark.createDataFrame([(1, 9), (0, 4)], "pos long, node long"), str(tmp_path / "seeds"))
    assert [tuple(r) for r in files.seed_file(spark, str(tmp_path / "seeds")).orderBy("pos").collect()] == [(0, 4), (1, 9)]


def test_solutions(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"Blocked nodes": [3, 1, 2], "solver": "Degree", "edgelist": [0, 1, 1, 2], "weights": [0.5, 1.0]}))
    removal, listed = files.solution(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in removal.orderBy("rank").collect()] == [("Degree", 0, 3), ("Degree", 1, 1), ("Degree", 2, 2)]
    assert sorted(map(tuple, listed.collect())) == [(0, 1, 0.5), (1, 2, 1.0)]
    edges = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.1), (2, 3, 0.1)], "src long, dst long, weight double")
    assert sorted(map(tuple, transforms.replace_edges(edges, listed).select("src", "dst", "weight").collect())) == [(0, 1, 0.5), (1, 2, 1.0)]
    (tmp_path / "t.json").write_text(json.dumps({"Blocked nodes": [3, 3], "solver": "Degree"}))
    with pytest.raises(ValueError):
        files.solution(spark, str(tmp_path / "t.json"))


def test_public_layouts(spark, tmp_path):
    (tmp_path / "a").write_text("# c\n# d\n10 20\n20 5\n")
    assert sorted((r["src"], r["dst"]) for r in files.public_graph(spark, str(tmp_path / "a"), "stanford").collect()) == [(1, 2), (2, 0)]
    (tmp_path / "b").write_text("% c\n4 4 3\n1 2\n2 2\n3 4\n")
    got = sorted((r["src"], r["dst"]) for r in files.public_graph(spark, str(tmp_path / "b"), "minnesota", id_base=1).collect())
    assert got == [(0, 1), (1, 0), (2, 3), (3, 2)]
    (tmp_path / "c").write_text("4 9\n1 2\n")
    with pytest.raises(ValueError):
        files.public_graph(spark, str(tmp_path / "c"), "gnutella")
    (tmp_path / "d").write_text("1 2 3\n4\n")
    assert sorted(map(tuple, files.adjacency_list(spark, str(tmp_path / "d")).collect())) == [(1, 2), (1, 3)]
    (tmp_path / "e.bin").write_bytes(struct.pack("<iif", 1, 2, 0.5) + struct.pack("<iif", 2, 3, 0.25))
    assert sorted(map(tuple, files.binary_edges(spark, str(tmp_path / "e.bin")).collect())) == [(1, 2, 0.5), (2, 3, 0.25)]
    (tmp_path / "f").write_text("ie 1 2 0.5\ndn 3\n")
    assert [tuple(r)[1:] for r in files.change_log(spark, str(tmp_path / "f")).orderBy("seq").collect()] == [("ie", 1, 2, 0.5), ("dn", 3, None, None)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert store.find("graphs") is None and store.count("graphs", "x") == 0
    store.insert("graphs", spark.createDataFrame([("a", 1), ("b", 2)], "graph_id string, n int"), "x")
    store.insert("graphs", spark.createDataFrame([("c", 3)], "graph_id string, n int"), "y")
    store.update("graphs", "x", "graph_id", spark.createDataFrame([("a", 9.5)], "graph_id string, avg double"))
    rows = {r["graph_id"]: r["avg"] for r in store.find("graphs", "x").collect()}
    assert rows == {"a": 9.5, "b": None} and store.count("graphs", "y") == 1
    store.remove("graphs", "x")
    assert store.count("graphs", "x") == 0 and store.count("graphs", "y") == 1
    with pytest.raises(KeyError):
        store.count("nothing", "x")


def test_parameters():
    with pytest.raises(AssertionError):
        Parameters({"problem": {"a": 1}}, load_defaults=False)
    p = Parameters({"data": {"graph_type": "path", "weight_scale": [0.5, [1]], "n": [10, [15, 20]]}})
    sets = p.data_sets()
    assert [(s["weight_scale"], s["n"]) for s in sets] == [(0.5, 15), (0.5, 20), (1, 10), (0.5, 10)]
    assert all(k in s for s in sets for k in ("graph_type", "random_weight"))
    own = Parameters({"strategy": {"some": {"param": "value"}}}).immunization_sets()
    assert own == [{"param": "value", "solver_name": "some", "solver_timeout": 86400}]
    base = Parameters({})
    assert len(base.immunization_sets()) == len(DEFAULTS["strategy"]) and len(base.solver_sets()) == 4
    assert all(s["seeds"] == 2 for s in base.solver_sets())
    assert Parameters({"solver": {"Rob": {"seeds": 7}}}).solver_sets()[0]["seeds"] == 2
    assert first_values({"a": [1, [2]], "b": {"c": []}}) == {"a": 1, "b": {"c": None}}
    assert flat({"a": {"b": 1}, "c": 2}) == {"a_b": 1, "c": 2}
    assert footprint({"weight_scale": 0.5, "n": 10}) == "n10_ws05000"
    assert star({"x": {"y": [1, [2, 3]]}}) == [{"x": {"y": 2}}, {"x": {"y": 3}}, {"x": {"y": 1}}]


def test_experiment_end_to_end(spark, tmp_path):
    given = {
        "tag": "t", "data": {"graph_type": "path", "weight_scale": 1.0, "n": 6}, "strategy": {"Degree": {}, "Random": {"random_id": 1}},
        "solver": {"Rob": {"mode": [0, 5], "iterations": 3}, "SatGreedy": {}}, "problem": {"seeds": 1, "alpha": 2},
    }
    e = Experiment(spark, given, str(tmp_path / "e"))
    summary = e.run().collect()
    assert len(summary) == 3 and all(r["rob"] > 0 for r in summary)
    first = e.results().filter("solver = 'Rob' AND l = 0 AND params LIKE '%\"mode\": 5%'").collect()
    assert {r["value"] for r in first} == {6.0}
    assert e.store.find("graphs", "t").first()["m"] == 5
