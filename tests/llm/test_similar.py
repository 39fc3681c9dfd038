"""The pipeline's near-duplicate stage against all pairs of exact shingle sets."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cascata.llm import similar
from cascata.llm.common import shared_folder

from .helpers import docs_frame, odd_rows, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The (doc_id, text) that heads each component, but for the choice among texts of one id."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return label


def rows_at_all_similarities():
    rng = random.Random(8)
    line = words(rng, 12)
    rows = odd_rows()
    for group in range(6):
        base = words(rng, rng.choice((6, 30, 100, 300)), 5000).split()
        for k in range(14):
            own = list(base)
            for _ in range(rng.randrange(1 + len(base) // 20)):
                own[rng.randrange(len(own))] = f"changed{rng.randrange(3)}"
            rows.append((100 * (group + 1) + k, " ".join(own).upper() if k % 5 == 0 else " ".join(own)))
    return rows + [(1000 + k, line + " " + words(rng, 8, 5000)) for k in range(60)]


@pytest.mark.parametrize("part_shingles", [similar.PART_SHINGLES, 600])
def test_components_against_all_pairs(spark, part_shingles):
    rows = rows_at_all_similarities()
    found = similar.classes(docs_frame(spark, rows), part_shingles=part_shingles).collect()
    label = brute(rows)
    as_sets = lambda pairs: sorted(sorted(map(str, g)) for g in pairs.values())
    got, expected = {}, {}
    for r in found:
        got.setdefault(r["root"], []).append(r["doc_id"])
    for (i, _), x in zip(rows, label):
        expected.setdefault(x, []).append(i)
    assert as_sets(got) == as_sets(expected)
    assert similar.classes(docs_frame(spark, [])).count() == 0


def test_components_of_a_large_group_in_which_some_are_apart(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHARED", 1)
    rng = random.Random(9)
    base = words(rng, 200, 5000).split()
    rows = []
    for k in range(90):
        own = list(base)
        for at in rng.sample(range(200), rng.choice((0, 2, 5, 8, 12))):
            own[at] = f"other{rng.randrange(900)}"
        rows.append((k, " ".join(own)))
    found = similar.classes(docs_frame(spark, rows), part_shingles=2500).collect()
    label = brute(rows)
    pairs = {(a["root"], x) for a in found for (i, _), x in zip(rows, label) if a["doc_id"] == i}
    assert len({a for a, _ in pairs}) == len(pairs) == len(set(label)) > 1


def test_stage_keeps_one_of_each_component(spark):
    rows = rows_at_all_similarities()
    heads = {}
    for (i, _), x in zip(rows, brute(rows)):
        heads[x] = i if heads.get(x) is None else min(heads[x], i) if i is not None else heads[x]
    kept = corpus_pipeline.without_near_duplicates(spark, docs_frame(spark, rows), "")
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(heads.values(), key=str)


def nodes_of(spark, rows, low):
    """A node for each text, all with the given smallest hashes."""
    signed = similar.signed(docs_frame(spark, rows).selectExpr("doc_id", "doc_id AS text_key", "text"), 5)
    return signed.withColumn("low", F.array(*[F.lit(x).cast("long") for x in low]).cast("array<long>"))


def test_fingerprint_blocks_find_near_sets(spark):
    rng = random.Random(10)
    base = [words(rng, 400, 5000).split() for _ in range(3)]
    rows = [(10 * k + j, " ".join(b[: 100 + j] + ["changed"] * bool(j) + b[100 + j :])) for k, b in enumerate(base) for j in range(4)]
    nodes = nodes_of(spark, rows, [])
    ids = {r["node"]: r["doc_id"] for r in nodes.collect()}
    found = {(ids[r["a"]] // 10, ids[r["b"]] // 10) for r in similar.close_links(nodes, similar.LEAST).collect()}
    assert found == {(0, 0), (1, 1), (2, 2)}


def test_fingerprints_rule_out_small_sets(spark):
    rng = random.Random(11)
    texts = [words(rng, n, 5000) for n in (9, 9, 11, 21, 25, 31, 35, 39) for _ in range(3)]  # even sets have fewer bits set
    near = words(rng, 8, 5000)
    for rows in (texts[:6], texts):
        nodes = nodes_of(spark, list(enumerate([*rows, near, near + " end"])), [7])
        ids = {r["node"]: r["doc_id"] for r in nodes.collect()}
        found = [{ids[r["a"]], ids[r["b"]]} for r in similar.close_links(nodes, similar.LEAST).collect()]
        assert found and all(pair == {len(rows), len(rows) + 1} for pair in found)


def test_few_files_for_many_partitions(spark):
    """Each file that is created starts processes where Hadoop has no native library."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    shared_folder(spark)
    files = lambda: len(list(Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).glob("**/part-*")))
    docs = docs_frame(spark, rows_at_all_similarities()).coalesce(1)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        had = files()
        similar.classes(docs)
        assert 0 < files() - had < 4 * 64
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
