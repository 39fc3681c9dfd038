import random

from pyspark.sql import functions as F

from cascata.streaming import changelog


def brute(edges, nodes, log):
    edges, nodes = {(a, b): w for a, b, w in edges}, set(nodes)
    for _, op, a, b, w in sorted(log):
        if op == "in":
            nodes.add(a)
        elif op == "dn":
            nodes.discard(a)
            edges = {e: x for e, x in edges.items() if a not in e}
        elif op == "ie" and a != b and a in nodes and b in nodes:
            edges.setdefault((a, b), w)
        elif op == "de":
            edges.pop((a, b), None)
        elif op == "ce" and (a, b) in edges:
            edges[a, b] = w
    return sorted((a, b, w) for (a, b), w in edges.items()), sorted(nodes)


def random_log(rng, n):
    return [(k, op, rng.randrange(9), None if op in ("in", "dn") else rng.randrange(9), rng.randrange(100) / 100) for k in range(n) for op in [rng.choice(["ie", "ie", "ie", "de", "ce", "in", "dn"])]]


SCHEMA = "seq long, op string, src long, dst long, weight double"


def test_log_against_brute_force(spark):
    rng = random.Random(8)
    for _ in range(4):
        nodes = [0, 1, 2, 3, 4]
        edges = [(0, 1, 0.5), (1, 2, 0.25), (3, 4, 1.0)]
        log = random_log(rng, 120)
        got = changelog.apply_log(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(v,) for v in nodes], "id long"), spark.createDataFrame(log, SCHEMA))
        assert (sorted(map(tuple, got[0].collect())), sorted(r["id"] for r in got[1].collect())) == brute(edges, nodes, log)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    log = random_log(rng, 90)
    nodes, edges = spark.range(6), spark.createDataFrame([(0, 1, 0.5)], "src long, dst long, weight double")
    for k in range(3):
        spark.createDataFrame(log[30 * k : 30 * k + 30], SCHEMA).coalesce(1).write.json(str(tmp_path / "parts" / str(k)))
    import shutil

    (tmp_path / "logs").mkdir()
    graph = changelog.IncrementalGraph(spark, str(tmp_path / "state"), edges, nodes)
    seen = []
    graph.observers.append(lambda epoch, e, n: seen.append((epoch, e.count())))
    for k in range(3):
        part = next((tmp_path / "parts" / str(k)).glob("part-*.json"))
        shutil.copy(part, tmp_path / "logs" / f"{k}.json")
        query = graph.follow(str(tmp_path / "logs"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
    got = [df.collect() for df in graph.state()]
    assert [e for e, _ in seen] == [0, 1, 2]
    assert (sorted(map(tuple, got[0])), sorted(r["id"] for r in got[1])) == brute([(0, 1, 0.5)], range(6), log)
    graph.on_batch(spark.createDataFrame(log[60:], SCHEMA), 2)
    assert sorted(map(tuple, graph.state()[0].collect())) == sorted(map(tuple, got[0]))


def test_windows_on_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 02:00:00", "b", 3.0)]
    events = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = changelog.windowed_log(stream, "1 hour", late="10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    streamed = sorted(map(tuple, spark.table("w").collect()))
    assert streamed == sorted(map(tuple, changelog.windowed_log(events, "1 hour").collect())) and len(streamed) == 2
    assert changelog.windowed_log(events, "1 hour", "30 minutes").count() == 5
