"""Quality classifier learned from trusted positives and unlabelled web text.

The risk is the non-negative unbiased estimate of Kiryo et al. (2017): with the class
prior p, ``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))``. The prior is
estimated from the two samples alone, as the smallest ratio of their tail shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.anomaly import count_rows
from wakeline.llm.common import id_remainder, map_batches, sampled, with_text_columns
from wakeline.llm.textstats import COUNTS, ratios

#: Documents of each sample that the fit sees at most, about.
FIT_ROWS = 20_000
#: Rows whose id has this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2
REJECT_BELOW = 0.7

_KNOTS = (0.02, 0.2, 0.5, 0.8, 0.98)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Basis:
    """Each figure as a straight line and hinges at its own quantiles."""

    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Basis:
        scale = np.maximum(x.std(0), 1e-6)
        return cls(x.mean(0), scale, np.quantile((x - x.mean(0)) / scale, _KNOTS, axis=0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        hinges = [np.maximum(z - k, 0) for k in self.knots]
        return np.column_stack([np.ones(len(z)), z, *hinges])


@dataclass
class QualityModel:
    basis: Basis
    weights: np.ndarray
    slope: float
    shift: float
    prior: float

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return self.basis(ratios(counts)) @ self.weights

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(counts) + self.shift)


def minimise_risk(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 60, batch: int = 512, seed: int = 5
) -> np.ndarray:
    """Weights of the linear classifier with least non-negative risk (logistic loss, Adam steps)."""
    random = np.random.default_rng(seed)
    w = np.zeros(positive.shape[1])
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(rounds):
        rate = 0.05 / (1 + epoch / 10)
        order = random.permutation(len(unlabelled))
        for at in range(0, len(order), batch):
            u = unlabelled[order[at : at + batch]]
            p = positive[random.integers(0, len(positive), batch)]
            p_margin, u_margin = p @ w, u @ w
            negative_risk = np.logaddexp(0, u_margin).mean() - prior * np.logaddexp(0, p_margin).mean()
            as_negative = u.T @ _sigmoid(u_margin) / len(u) - prior * (p.T @ _sigmoid(p_margin)) / len(p)
            if negative_risk >= 0:
                slope = prior * (p.T @ -_sigmoid(-p_margin)) / len(p) + as_negative
            else:  # overfitted: step back up the part that must not be negative
                slope = -as_negative
            slope = slope + 1e-4 * w
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from margins of both.

    Above any cut, the unlabelled share is at least prior times the positive share; the
    least ratio (each with its sampling error) is the estimate.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    error = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = np.argmin((u + error) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def _platt(margin: np.ndarray, good: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve over labelled margins (damped Newton steps, smoothed targets)."""
    n_good, n_bad = float(weights[good].sum()), float(weights[~good].sum())
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    start = np.array([1.0, 0.0])
    x, theta = np.column_stack([margin, np.ones_like(margin)]), start

    def loss(theta: np.ndarray) -> float:
        z = x @ theta
        return float(weights @ (np.logaddexp(0, z) - target * z) + 5e-4 * ((theta - start) ** 2).sum())

    for _ in range(rounds):
        p = _sigmoid(x @ theta)
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weights * (p - target)) + 1e-3 * (theta - start))
        # a whole step from far away can overshoot; the loss is convex, so a part of it cannot
        size = next((k for k in 0.5 ** np.arange(30) if loss(theta - k * step) <= loss(theta)), 0.0)
        theta = theta - size * step
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 and np.isfinite(theta).all() else (1.0, 0.0)


def train(
    positive: np.ndarray, negative: np.ndarray, unlabelled: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)
) -> QualityModel:
    """From counts. ``negative`` rows only calibrate the curve from margin to score.

    ``weights``: the labelled rows that each positive and each negative stands for.
    """
    everything = np.concatenate([unlabelled, positive])
    if not len(everything):
        everything = np.zeros((1, len(COUNTS)), np.int64)
    basis = Basis.of(ratios(everything))
    if not len(positive) or not len(unlabelled):
        return QualityModel(basis, np.zeros(basis(ratios(everything)).shape[1]), 1.0, 0.0, 0.5)
    p, u = basis(ratios(positive)), basis(ratios(unlabelled))
    w = minimise_risk(p, u, 0.5, rounds=15)
    prior = estimate_prior(p @ w, u @ w)
    model = QualityModel(basis, minimise_risk(p, u, prior), 1.0, 0.0, prior)
    if len(negative):
        margin = np.concatenate([model.margins(positive), model.margins(negative)])
        good = np.arange(len(margin)) < len(positive)
        model.slope, model.shift = _platt(margin, good, np.where(good, *weights))
    return model


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Learn from labels outside the held-out fold and from unlabelled documents.

    About ``fit_rows`` positives, as many labelled negatives and as many unlabelled
    documents, chosen by a hash of the id, give their counts to the driver. The curve from
    margin to score weighs each class back to all its labels, so the cut means the same
    share on any input size. Null labels are not used; a document with both labels counts as negative. Without positives or
    documents every score is 0.5.
    """
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(id_remainder(FOLDS) != HELD_OUT)
    known = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    marked = sampled(known.where("quality = 1"), fit_rows, totals.get(1, 0)).unionAll(
        sampled(known.where("quality = 0"), fit_rows, totals.get(0, 0))
    )
    web = sampled(docs, fit_rows, docs.count(), seed=31).select("doc_id", "text", F.lit(None).cast("int").alias("quality"))
    # the labelled sample has a fixed bound, so its ids are sent to every task
    judged = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "text", "quality")

    def make():
        return lambda texts: [pa.array(list(count_rows(texts)), pa.list_(pa.int64()))]

    rows = with_text_columns(web.unionAll(judged), "counts array<long>", make, ("quality",)).toArrow()
    counts = np.array(rows["counts"].to_pylist(), np.int64).reshape(-1, len(COUNTS))
    quality = np.array(rows["quality"].to_pylist(), float)
    weights = tuple(max(1.0, totals.get(q, 0) / fit_rows) for q in (1, 0))
    return train(counts[quality == 1], counts[quality == 0], counts[np.isnan(quality)], weights)


def score(
    docs: DataFrame,
    model: QualityModel,
    carry: tuple[str, ...] = ("doc_id",),
    reject_below: float = REJECT_BELOW,
) -> DataFrame:
    """The ``carry`` columns, score (0 to 1, higher is better) and predicted (1 from ``reject_below`` on).

    Only the text is read for the score; null texts count as empty. Every row is scored by
    itself, so repeated rows get equal scores and an empty table gives an empty one. A
    column of ``carry`` named like a result is left out.
    """

    def make():
        def work(texts):
            scores = model.scores(count_rows(texts))
            return [scores, (scores >= reject_below).astype(np.int32)]

        return work

    return with_text_columns(docs, "score double, predicted int", make, carry)


def keep_good(docs: DataFrame, model: QualityModel, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The documents that `score` predicts as good, all columns as they are."""

    def make():
        def work(batch):
            scores = model.scores(count_rows([x or "" for x in batch["text"].to_pylist()]))
            return batch.filter(pa.array(scores >= reject_below))

        return work

    return map_batches(docs, docs.schema, make)
