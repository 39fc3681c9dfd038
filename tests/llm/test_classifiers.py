import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from cascata.llm import quality, toxicity
from cascata.llm.queries import op4_toxicity, op9_quality
from cascata.llm.textstats import QUALITY_FEATURES, TOXICITY_FEATURES, ToxicityFeatures, masked_words, quality_features

from .helpers import docs_frame, odd_rows, words

SF = "/root/testdata/sf0.01"


def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    for query, column, mod, rest, least in ((op4_toxicity, "toxic", 5, 0, 0.75), (op9_quality, "quality", 3, 1, 0.98)):
        found = query(spark, SF).toPandas()
        assert len(found) == 1000 and found["score"].between(0, 1).all() and not found["score"].isna().any()
        assert (found["predicted"] == (found["score"] >= 0.5)).all()
        assert all(h == (zlib.crc32(str(i).encode()) % mod == rest) for i, h in zip(found["doc_id"], found["held_out"]))
        own = found[found["held_out"]].merge(labels, on="doc_id")
        assert auc(own[column].to_numpy(), own["score"].to_numpy()) >= least


def test_labels_held_out_are_not_learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    one, two = (dict(quality.score(docs, x, quality.learning_rows).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert one == two


def test_odd_rows_and_empty_tables(spark):
    docs = docs_frame(spark, odd_rows())
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 1), (10, None, None), (None, 1, 1), (11, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        for table in (labels, none):
            found = module.score(docs, table).collect()
            assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in found)
            assert module.score(docs_frame(spark, []), table).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_features_of_odd_texts():
    texts = pa.array([None, "", " \n", "x", "You are an IDIOT! st*pid id10t m0r0n", "é" * 1000, "a|b | c\nd\nd"])
    for kernel, names in ((ToxicityFeatures(), TOXICITY_FEATURES), (quality_features, QUALITY_FEATURES)):
        x = kernel(texts)
        assert x.shape == (7, len(names)) and np.isfinite(x).all() and not x[:3, :6].any()
    t = dict(zip(TOXICITY_FEATURES, ToxicityFeatures()(texts)[4]))
    assert t["insults"] == 1 and t["near_rate"] > 0 and t["masked_insults"] == 3


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = toxicity.fit_trees(x, y)
    assert auc(y, model.margin(x)) > 0.98
    v = np.array([3.0, 1, 2, 2, 5, 4])
    knots = toxicity.isotonic(v, np.array([0.0, 1, 0, 0, 1, 1]))
    fit = np.interp(v, *knots)
    assert (np.diff(fit[np.argsort(v)]) >= -1e-12).all() and np.allclose(np.interp([1, 2, 3], *knots), 0.25)


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (3000, 3)), rng.normal(-1.5, 1, (1000, 3))
    model = quality.fit_pu(good[:800], np.concatenate([good[800:], bad]), 2200 / 3200, steps=600)
    assert (model(good) > 0.5).mean() > 0.95 and (model(bad) < 0.5).mean() > 0.95


def labelled_rows(n=60):
    rng = random.Random(3)
    rows = [(k, words(rng, 40) + (" You IDIOT! you st*pid m0ron!!" if k % 2 else " fine.")) for k in range(n)]
    return rows + [(k, words(rng, 30)) for k in range(0, n, 7)] + odd_rows()


def labels_of(spark, n=60):
    return spark.createDataFrame([(k, (k + 1) % 2, k % 2) for k in range(n)], "doc_id long, quality int, toxic int")


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    """Some ids have two texts here."""
    rows, labels = labelled_rows(), labels_of(spark)
    for module in (toxicity,):
        one, two = (sorted((str(r["doc_id"]), round(r["score"], 9)) for r in module.score(docs_frame(spark, own), labels).collect()) for own in (rows, rows[::-1]))
        assert one == two


def test_scores_against_one_text_at_a_time(spark):
    rows, labels = labelled_rows(), labels_of(spark)
    docs = docs_frame(spark, rows)
    every = lambda c: c.isNotNull() | c.isNull()
    kernel, model = toxicity.fit(docs, labels, every)
    network = quality.fit(docs, labels, every)
    for module, score in ((toxicity, lambda t: model(kernel(t))), (quality, lambda t: network(quality_features(t)))):
        got = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in module.score(docs, labels).collect())
        assert got == sorted((str(i), round(float(score(pa.array([t], pa.string()))[0]), 9)) for i, t in rows)


def test_splits_against_all_splits():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0.3).astype(float)
    model = toxicity.fit_trees(x, y, trees=1, depth=2)
    b, base = model.bins(x), 1 / (1 + np.exp(-model.base))
    g, h = y - base, np.full(300, base * (1 - base))
    gain = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1)
    expected = np.zeros(300)

    def grow(rows, node, depth):
        if depth == 2:
            expected[rows] = 0.15 * g[rows].sum() / (h[rows].sum() + 1)
            return
        every = {}
        for j in range(3):
            for k in range(32):
                left = rows[b[rows, j] <= k]
                right = rows[b[rows, j] > k]
                if len(left) and len(right):
                    every[j, k] = gain(left) + gain(right) - gain(rows)
        j, k = model.feature[0, node], model.split[0, node]
        assert np.isclose(every[j, k], max(every.values()))
        grow(rows[b[rows, j] <= k], 2 * node + 1, depth + 1)
        grow(rows[b[rows, j] > k], 2 * node + 2, depth + 1)

    grow(np.arange(300), 0, 0)
    assert np.allclose(model.margin(x), model.base + expected)


def test_masked_words_against_the_pattern():
    pattern = re.compile(r"(?<![^\W_])[^\W\d_]+(?:[*@$!0-9#]+[^\W\d_]+)+(?![^\W_])")
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1*!_ ²٣é-#") for _ in range(rng.randrange(14)))
        assert masked_words(text) == pattern.findall(text)
    began = time.time()
    masked_words("a1*" * 350_000)
    assert time.time() - began < 10  # the pattern takes hours
