import random

import numpy as np
import xxhash

from cascata.llm import simhash
from cascata.llm.components import connected_components

from .helpers import docs_frame, odd_rows, words


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    fps = np.array([brute_fp(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None, :], len(rows)).min(1)
        if (new == label).all():
            break
        label = new
    out = []
    for k, (i, _) in enumerate(rows):
        own = [j for (j, _), x in zip(rows, label) if x == label[k] and j is not None]
        out.append((i, f"{int(fps[k]):016x}", min(own) if own else None))
    return sorted(out, key=str)


def near_rows():
    rng = random.Random(2)
    base = words(rng, 400).split()
    rows = odd_rows()
    for k in range(20):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(400)] = "changed"
        rows.append((100 + k, " ".join(own)))
    return rows


def test_components_against_brute_force(spark):
    rows = near_rows()
    got = simhash.near_duplicates(docs_frame(spark, rows)).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0


def test_links_in_parts_connect_the_same(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([s ^ np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))], np.uint64) for s in seeds]))
    nodes = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    forests = []
    for part in (8192, 64, 16):
        found = connected_components(simhash.links(nodes, part=part)).collect()
        groups = {}
        for r in found:
            groups.setdefault(r["root"], set()).add(r["node"])
        forests.append(sorted(map(sorted, groups.values())))
    assert forests[0] == forests[1] == forests[2]


def test_compare_skips_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 20, 3000, dtype=np.uint64)
    fps = np.unique(fps)
    ordered, links = simhash.compare(fps, 2, tile=128)
    parent = simhash.Labels(np.arange(len(fps)))
    near = np.bitwise_count(ordered[:, None] ^ ordered[None, :]) <= 2
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        parent.join(int(i), np.array([j]))
    assert len(links) == len(parent.links)
    assert all(near[i, j] for i, j in links)


def test_keep_one(spark):
    rows = near_rows()
    docs = docs_frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    expected = {c for _, _, c in brute(rows)}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_keep_one_of_nameless_components_and_of_texts_that_share_an_id(spark):
    rng = random.Random(6)
    texts = [words(rng, 60, 9000) for _ in range(8)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0]), (1, texts[5]), (1, texts[6]), (1, texts[6]), (2, texts[7]), (None, texts[7])]
    kept = simhash.keep_one(docs_frame(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted({*rows[:5], (1, texts[5]), (1, texts[6]), (2, texts[7])}, key=str)


def test_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    found = connected_components(edges)
    assert found.count() == 301 and {r["root"] for r in found.collect()} == {0}
