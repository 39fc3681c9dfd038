"""Quality classifier (operator 9): positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1 that may be learned from; unlabelled text is a hash sample of the
whole table.  With class prior p, logistic losses l and means over positives (P) and unlabelled rows (U),
the risk  p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)])  is minimised; where the bracket falls below
zero the step goes against it, as the non-negative estimator prescribes.  The model is a one-layer
network on standardised dense features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket
from .textstats import QUALITY_FEATURES, feature_rows, quality_features, score_rows
from .toxicity import labelled_rows

#: Labelled rows and unlabelled rows that the model is fitted on, at most.
FIT_ROWS, UNLABELLED_ROWS = 20_000, 20_000


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def estimate_prior(y: np.ndarray) -> float:
    """Share of good text, from the labelled learning rows with one added to either class."""
    return float((y.sum() + 1) / (len(y) + 2))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 1500, batch: int = 1024, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> Network:
    """Minimise the non-negative risk with Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    d = unlabelled.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    zp, zu = (np.clip((v - mean) / scale, -8, 8) for v in (positive, unlabelled))
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    softplus = lambda t: np.logaddexp(0, t)
    for step in range(1, steps + 1):
        p, u = zp[rng.integers(0, len(zp), batch)], zu[rng.integers(0, len(zu), batch)]
        x = np.concatenate([p, u])
        hiddens = np.tanh(x @ w[0] + w[1])
        f = hiddens @ w[2] + w[3]
        fp, fu = f[:batch], f[batch:]
        negative = softplus(fu).mean() - prior * softplus(fp).mean()
        g = np.zeros(2 * batch)
        if negative >= 0:
            g[:batch] = -prior * sigmoid(-fp) / batch - prior * sigmoid(fp) / batch
            g[batch:] = sigmoid(fu) / batch
        else:
            g[:batch] = prior * sigmoid(fp) / batch
            g[batch:] = -sigmoid(fu) / batch
        back = np.outer(g, w[2]) * (1 - hiddens**2)
        grads = [x.T @ back + decay * w[0], back.sum(0), hiddens.T @ g + decay * w[2], np.array([g.sum()])]
        lr = rate * (1 - step / (steps + 1))
        for k in range(4):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            w[k] = w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))


def fit(docs: DataFrame, labels: DataFrame, learn, limit: int = FIT_ROWS, unlabelled_limit: int = UNLABELLED_ROWS) -> Network:
    """Without trusted positives or without text the model is the prior alone."""
    rows = feature_rows(labelled_rows(docs, labels, "quality", learn, limit), quality_features, ("y",)).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    # the sample is picked by a hash of the id; only ids are sorted, and they are bounded
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(unlabelled_limit).distinct()
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    pool = feature_rows(picked, quality_features).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(float)
    prior = estimate_prior(y)
    d = len(QUALITY_FEATURES)
    if not (y == 1).any() or not len(pool):
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(prior / (1 - prior))))
    return fit_pu(np.stack(rows["features"][y == 1].to_numpy()), np.stack(pool["features"].to_numpy()), prior)


def score(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row; only the text goes into a score.

    Null and empty texts are scored like any other, repeated rows alike.
    """
    model = fit(docs, labels, learn or (lambda c: F.lit(True)))
    return score_rows(docs, quality_features, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def learning_rows(column):
    """Ids that op9 may learn from."""
    return crc_bucket(column, 3) != 1


def keep_good(docs: DataFrame, labels: DataFrame, learn=None) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    from .textstats import filter_rows

    return filter_rows(docs, quality_features, fit(docs, labels, learn or learning_rows))
