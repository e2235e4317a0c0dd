"""Isolation forest on rule statistics of documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import sampled, with_text_columns
from wakeline.llm.textstats import COUNTS, RATIOS, count_text, ratios

#: The statistics that the forest splits on. Repetition is left to the base rule: good documents share passages.
RULES = [RATIOS.index(x) for x in "word_length symbols same_next upper marks pipes".split()]

TREES, TREE_ROWS = 128, 256
#: Rows that calibrate the threshold: about so many labelled ones.
LABELLED_ROWS = 20_000
#: A good document rejected weighs as much as so many bad ones kept, as shares of their class.
GOOD_WEIGHT = 10.0
_GAMMA = 0.5772156649015329

MIN_WORDS = 50


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2 * (np.log(big - 1) + _GAMMA) - 2 * (big - 1) / big))


@dataclass
class Forest:
    """Trees as heaps: node i has children 2i+1 and 2i+2; feature -1 marks a leaf."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    rows: int
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 per row; near 1 for rows that few random splits part from the rest."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.feature.shape[1] + 1)) - 1):
            feature = self.feature[trees, at]
            right = x[row, feature] > self.split[trees, at]
            at = np.where(feature < 0, at, 2 * at + 1 + right)
        return 2.0 ** (-self.path[trees, at].mean(1) / max(float(expected_path(self.rows)), 1e-9))


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    random = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(rows))))
    size = 2 ** (depth + 1) - 1
    feature, split, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    used = min(rows, len(x))
    for t in range(trees):
        members = {0: random.choice(len(x), used, replace=False)} if len(x) else {}
        for node in range(size):
            own = members.pop(node, None)
            if own is None:
                continue
            level = int(np.log2(node + 1))
            low, high = x[own].min(0), x[own].max(0)
            apart = np.flatnonzero(high > low)
            if level == depth or not len(apart):
                path[t, node] = level + expected_path(len(own))
                continue
            f = random.choice(apart)
            cut = random.uniform(low[f], high[f])
            right = x[own, f] > cut
            feature[t, node], split[t, node] = f, cut
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return Forest(feature, split, path, used)


def calibrate(good: np.ndarray, bad: np.ndarray, good_weight: float = GOOD_WEIGHT) -> float:
    """The score that best parts labelled rows, midway between its neighbours; 1 (keep all) without bad rows."""
    if not len(bad):
        return 1.0
    if not len(good):
        return 0.0
    scores = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([(scores[:-1] + scores[1:]) / 2, [1.0]])
    lost = 1 - np.searchsorted(np.sort(good), cuts, "right") / len(good)
    missed = np.searchsorted(np.sort(bad), cuts, "right") / len(bad)
    return float(cuts[np.argmin(missed + good_weight * lost)])


def rule_columns(counts: np.ndarray) -> np.ndarray:
    """The forest's columns; logarithms keep extreme values from stretching the split range."""
    return np.log1p(100 * ratios(counts)[:, RULES])


def base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeated = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (words < MIN_WORDS) | (100 * repeated > 50 * words)


def count_rows(texts: list[str]) -> np.ndarray:
    return np.array([count_text(x) for x in texts], np.int64).reshape(len(texts), len(COUNTS))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    labelled_rows: int = LABELLED_ROWS,
) -> Forest:
    """Grow the trees on about ``trees * tree_rows`` documents and calibrate on about ``labelled_rows`` labelled ones.

    Both samples are chosen by a hash of the id; their counts (not their texts) come to
    the driver. Without documents the forest is one leaf and keeps all; without bad labels
    it keeps all that pass the base rule.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = sampled(known, labelled_rows, known.count())
    unmarked = F.lit(None).cast("int").alias("quality")
    grown_on = sampled(docs, trees * tree_rows, docs.count(), seed=29).select("doc_id", "text", unmarked)
    # the labelled sample has a fixed bound, so its ids are sent to every task
    judged = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "text", "quality")

    def make():
        return lambda texts: [pa.array(list(count_rows(texts)), pa.list_(pa.int64()))]

    rows = with_text_columns(grown_on.unionAll(judged), "counts array<long>", make, ("quality",)).toArrow()
    counts = np.array(rows["counts"].to_pylist(), np.int64).reshape(-1, len(COUNTS))
    quality = np.array(rows["quality"].to_pylist(), float)
    passed = ~base_failed(counts)
    x = rule_columns(counts)
    forest = grow(x[np.isnan(quality)], trees, tree_rows)
    forest.threshold = calibrate(*(forest.scores(x[(quality == q) & passed]) for q in (1, 0)))
    return forest


def judge(docs: DataFrame, forest: Forest, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, the counts, base_failed, anomaly (0 to 1) and kept.

    Null and empty texts have no words and fail the base rule. Every row is judged by
    itself, so repeated rows get equal verdicts and an empty table gives an empty one. A
    column of ``carry`` named like a result is left out.
    """

    def make():
        def work(texts):
            counts = count_rows(texts)
            failed, score = base_failed(counts), forest.scores(rule_columns(counts))
            return [*counts.T.copy(), failed, score, ~failed & (score <= forest.threshold)]

        return work

    ddl = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return with_text_columns(docs, ddl, make, carry)
