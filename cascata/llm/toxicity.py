"""Toxicity (operator 4): gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of two lexicons (a fixed one, and one of words and word beginnings learned
from the labelled rows), closeness of insults to second-person words, and rates of capitals, punctuation
and obfuscated words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, cut
from .textstats import TOXICITY_FEATURES, ToxicityFeatures, feature_rows, score_rows, terms_of

#: Labelled rows that the trees and the calibration are fitted on, at most; chosen by a hash of the id.
FIT_ROWS = 10_000
#: Terms of the learned lexicon, at most, and the likelihood-ratio statistic that each must reach.
LEXICON_TERMS, LEXICON_G = 500, 25.0


@dataclass
class Trees:
    """Boosted regression trees of one depth, for the logistic loss, on quantile bins."""

    edges: list[np.ndarray]
    feature: np.ndarray  # (trees, inner nodes)
    split: np.ndarray  # (trees, inner nodes): bins up to it go left
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        out, depth = np.full(len(x), self.base), int(np.log2(self.leaf.shape[1]))
        for feature, split, leaf in zip(self.feature, self.split, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > split[node])
            out += leaf[node - (leaf.shape[0] - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting: every split maximises the gain of the second-order expansion, from histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(edges, np.zeros((trees, 2**depth - 1), int), np.full((trees, 2**depth - 1), bins, int), np.zeros((trees, 2**depth)), float(np.log(prior / (1 - prior))))
    b, d, margin = model.bins(x), x.shape[1], np.full(len(x), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * d + np.arange(d)) * bins + b
            shape = (width, d, bins)
            gs, hs = (np.bincount(key.ravel(), np.repeat(v, d), width * d * bins).reshape(shape).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < 1e-3) | (ht - hs < 1e-3)] = -1
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            model.feature[t, first : first + width] = best // bins
            model.split[t, first : first + width] = np.where(good, best % bins, bins)
            node = 2 * node + 1 + (b[np.arange(len(x)), model.feature[t, node]] > model.split[t, node])
        leaves = node - (2**depth - 1)
        model.leaf[t] = rate * np.bincount(leaves, g, 2**depth) / (np.bincount(leaves, h, 2**depth) + ridge)
        margin += model.leaf[t, leaves]
    return model


def isotonic(value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (value, fitted mean) of the best non-decreasing fit; equal values are pooled first."""
    levels, at = np.unique(value, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []  # [weight, sum, first, last]
    for k in range(len(levels)):
        blocks.append([weight[k], total[k], k, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2], last]
    xs = [levels[int(k)] for b in blocks for k in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    ys = [b[1] / b[0] for b in blocks for _ in range(2 if b[2] < b[3] else 1)]
    return np.array(xs), np.array(ys)


@dataclass
class Calibrated:
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        # a thousandth of the uncalibrated score keeps the order within a flat step
        return np.clip(0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, learn, limit: int) -> DataFrame:
    """Documents of at most ``limit`` labelled rows for which ``learn`` holds, with their label ``y``.

    A document with several label rows has the largest; null labels are no labels.  The chosen ids are
    bounded by ``limit``, so they may be broadcast.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).filter(learn(F.col("doc_id")) & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    chosen = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def term_counts(rows: DataFrame) -> DataFrame:
    """For every term of the labelled rows: documents with label 1 and with label 0 that hold it."""

    def run(batches):
        for batch in batches:
            found = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[1 if y else 0].update(terms_of(text or ""))
            terms = list(found[0].keys() | found[1].keys())
            yield pa.record_batch([pa.array(terms, pa.string()), *[pa.array([found[k][t] for t in terms], pa.int64()) for k in (1, 0)]], names=["term", "ones", "zeros"])

    return rows.select("text", "y").mapInArrow(run, "term string, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def learn_lexicon(rows: DataFrame, ones: int, zeros: int) -> frozenset[str]:
    """Terms that documents with label 1 hold far more often; the strongest LEXICON_TERMS by likelihood ratio."""
    if not ones or not zeros:
        return frozenset()
    share = ones / (ones + zeros)
    total = F.col("ones") + F.col("zeros")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (total * p))).otherwise(0.0)
    g = 2 * (part("ones", share) + part("zeros", 1 - share))
    # what reaches the driver is bounded by LEXICON_TERMS
    best = term_counts(rows).filter(F.col("ones") > 3 * total * share).withColumn("g", g).filter(F.col("g") >= LEXICON_G).orderBy(F.desc("g"), "term").limit(LEXICON_TERMS)
    return frozenset(r["term"] for r in best.collect())


def fit(docs: DataFrame, labels: DataFrame, learn, limit: int = FIT_ROWS) -> tuple[ToxicityFeatures, Calibrated]:
    """Lexicon and trees on four fifths of the learning rows, calibration on the rest.

    With no learning rows at all the model's score is the constant 0.
    """
    rows = cut(labelled_rows(docs, labels, "toxic", learn, limit).distinct().withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 0))
    tally = {r["y"]: r["n"] for r in rows.filter("NOT aside").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    kernel = ToxicityFeatures(learn_lexicon(rows.filter("NOT aside"), tally.get(1, 0), tally.get(0, 0)))
    table = feature_rows(rows, kernel, ("y", "aside")).toPandas()
    if not len(table):
        x, y, aside = np.zeros((1, len(TOXICITY_FEATURES))), np.zeros(1), np.zeros(1, bool)
    else:
        x, y, aside = np.stack(table["features"].to_numpy()), table["y"].to_numpy(float), table["aside"].to_numpy(bool)
    # an order that does not depend on where the rows come from, also where an id has several texts
    order = np.lexsort((*x.T, y))
    x, y, aside = x[order], y[order], aside[order]
    if aside.all() or aside.sum() < 10:
        aside = np.zeros(len(x), bool)
    trees = fit_trees(x[~aside], y[~aside])
    held = aside if aside.any() else ~aside
    return kernel, Calibrated(trees, isotonic(trees.margin(x[held]), y[held]))


def score(docs: DataFrame, labels: DataFrame, learn=None, limit: int = FIT_ROWS) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row of ``docs``; only the text goes into a score.

    ``learn`` picks the ids whose labels may be learned from (all by default).  Null and empty texts are
    scored like any other, repeated rows alike.
    """
    kernel, model = fit(docs, labels, learn or (lambda c: F.lit(True)), limit)
    return score_rows(docs, kernel, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learning_rows(column):
    """Ids that op4 may learn from."""
    return crc_bucket(column, 5) != 0
