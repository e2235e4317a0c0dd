"""Personal data by candidates and gradient-boosted trees.

Strict formats (email, ip, card, phone) are always redacted. Loose generators propose more,
overlapping spans; boosted trees score them from their format and their surroundings, and a
threshold for each kind, calibrated for precision, selects the rest (where a kind has none,
its format test does). The trees learn from
the corpus itself: a loose candidate that a strict format confirms is a positive, one that
its format refutes a negative, and the tests that confirm are not among the features.

All candidates count: three quarters of them for the trees, the others for the thresholds. Figures
keep seven bits, trees know them by their bins, and equal rows of bins are one row with a number.
A level of a tree needs no more than sums by node, feature and bin, in whole numbers, so the
trees do not depend on partitions.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.llm.common import map_batches, whole_texts, with_text_columns
from wakeline.sources.staging import stage

#: Order of kinds in every list of spans.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: What the confirmed and the refuted candidates weigh at most for the trees, in equal parts for each kind.
FIT_CANDIDATES = 20_000
PRECISION = 0.98
#: Distinct rows of bins that the trees learn from on the driver; beyond these, tasks sum them.
IN_PLACE = 50_000
#: Steps of a score in calibration, and of the weights in sums.
SCORE_STEPS, UNIT = 1 << 14, 1 << 36

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive repeats give the same matches as greedy ones here and never back-track
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_BYTES = b"0123456789"

#: Loose generators by the kind they propose.
LOOSE = {
    "email": re.compile(r"[^\s@]{1,64} ?(?:@|\(at\)|\[at\]) ?[^\s@]{1,128}"),
    "ip": re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9]{1,4}(?:\.[0-9]{1,4}){2,5}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,22}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])[(+]?[0-9](?:[ ().-]{0,2}[0-9]){6,15}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])(?:[A-Za-z_]{2,20} ?[=:] ?[\"']?)?[A-Za-z0-9_+/-]{12,}+"),
    "id": re.compile(
        r"(?<![0-9A-Za-z])(?:[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}"
        r"|[A-Z]{1,2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
    ),
}
_ASSIGNED = re.compile(r"(?i)^(?:password|passwd|pwd|token|secret|api_?key|key)\b ?[=:]")
_KEY_LIKE = re.compile(r"^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})$")
_SSN = re.compile(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
_CUES = tuple(
    re.compile(x, re.I)
    for x in (
        r"mail",
        r"\bip\b|host|server",
        r"card|visa|account|konto",
        r"tel|phone|call|fax|mobil",
        r"pass|token|secret|key|auth",
        r"ssn|iban|passport|\bid\b",
    )
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            spans.append((start, last))
        at = text.find("@", last if found else at + 1)
    return spans


def find_ips(text: str) -> list[tuple[int, int]]:
    """Each run of dotted numbers, four numbers at a time from its start."""
    spans = []
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                spans.append((at, end))
            at = end + 1
    return spans


def find_cards(text: str) -> list[tuple[int, int]]:
    spans = []
    for run in _DIGITS.finditer(text):
        digits = run[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(run.span())
    return spans


def find_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def has_digits(raw: bytes) -> bool:
    return len(raw.translate(None, _DIGIT_BYTES)) != len(raw)


def strict_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in order, then start."""
    spans = [("email", *x) for x in find_emails(text)] if "@" in text else []
    if has_digits(text.encode()):
        spans += [("ip", *x) for x in find_ips(text)]
        spans += [("card", *x) for x in find_cards(text)]
        if "+" in text:
            spans += [("phone", *x) for x in find_phones(text)]
    return spans


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the loose generators propose; spans of different kinds may overlap."""
    digits = has_digits(text.encode())
    found = []
    for kind, pattern in LOOSE.items():
        if kind == "email" and not ("@" in text or "at)" in text or "at]" in text):
            continue
        # these formats hold a digit anyway
        if kind in ("card", "phone", "id") and not digits:
            continue
        for m in pattern.finditer(text):
            if kind != "secret" or re.search("[A-Za-z]", m[0]):
                found.append((kind, m.start(), m.end()))
    return found


def confirmed(kind: str, span: str) -> bool:
    """The format test that makes a loose candidate a positive for learning."""
    if kind == "email":
        return find_emails(span) != []
    if kind == "ip":
        return find_ips(span) == [(0, len(span))]
    if kind == "card":
        return find_cards(span) != []
    if kind == "phone":
        return find_phones(span) == [(0, len(span))]
    if kind == "secret":
        return bool(_ASSIGNED.search(span) or _KEY_LIKE.search(span))
    return bool(_SSN.search(span))


def describe(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context figures; none of them is the test of `confirmed`."""
    span = text[start:end]
    before, after = text[max(0, start - 32) : start], text[end : end + 1]
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in span]
    n, times = len(span), Counter(span)
    count = Counter(classes)
    entropy = -sum(v / n * math.log2(v / n) for v in times.values())
    groups = re.findall("[0-9]+", span)
    return [
        KINDS.index(kind),
        n,
        count["d"],
        count["u"],
        count["l"],
        count["s"],
        count["d"] / n,
        count["u"] / n,
        entropy,
        sum(a != b for a, b in zip(classes, classes[1:])),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        *(span.count(c) for c in "-. @(=:+"),
        float(before[-1:].isspace() or not before),
        float(after.isspace() or not after),
        float(before[-1:] in "=:\"'" if before else 0),
        *(float(bool(c.search(before) or c.search(span))) for c in _CUES),
    ]


def grid(x: np.ndarray) -> np.ndarray:
    """Figures to seven bits: whole numbers below 128 stay, and a feature has few distinct values."""
    part, power = np.frexp(x)
    return np.ldexp(np.floor(part * 128) / 128, power)


#: Figures that `describe` gives.
FEATURES = len(describe("email", "a", 0, 1))


@dataclass
class Boosted:
    """Depth-3 trees as heaps of seven splits and eight leaves, over binned features."""

    edges: list[np.ndarray]
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])

    def binned_margins(self, binned: np.ndarray) -> np.ndarray:
        out = np.full(len(binned), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            out += leaf[_place(binned, feature, cut)]
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.binned_margins(self.bins(x))

    def binned_scores(self, binned: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.binned_margins(binned), -30, 30)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.binned_scores(self.bins(x))


_DEPTH, _BINS = 3, 32


def _place(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int = _DEPTH) -> np.ndarray:
    at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for _ in range(depth):
        at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
    return at - (2**depth - 1)


def edges_of(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted quantiles of a feature: a bin ends with each."""
    order = np.argsort(value, kind="stable")
    up_to = weight[order].cumsum()
    at = np.searchsorted(up_to, np.linspace(0, 1, _BINS)[1:-1] * up_to[-1], "left")
    return np.unique(value[order][at])


def sums(margin: np.ndarray, binned: np.ndarray, y: np.ndarray, weight: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """Gradients, their weights and the rows' weights by node, feature and bin, in parts of `UNIT`."""
    p = 1 / (1 + np.exp(-margin))
    out = np.zeros((nodes, binned.shape[1], _BINS, 3), np.int64)
    for i, part in enumerate((weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), weight)):
        whole = np.rint(part * UNIT)
        for j in range(binned.shape[1]):
            out[:, j, :, i] = np.bincount(node * _BINS + binned[:, j], whole, nodes * _BINS).reshape(nodes, _BINS)
    return out


class Rows:
    """Distinct rows of bins on the driver, with the margins that the trees so far give."""

    def __init__(self, binned: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.binned, self.y, self.weight = binned, y, weight
        self.margin, self.trees = None, 0

    def level(self, model: Boosted, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        if self.margin is None:
            self.margin = np.full(len(self.y), model.start)
        for i in range(self.trees, len(model.leaf)):
            self.margin += model.leaf[i][_place(self.binned, model.feature[i], model.cut[i])]
        self.trees = len(model.leaf)
        return sums(self.margin, self.binned, self.y, self.weight, _place(self.binned, feature, cut, depth), 2**depth)


def _rows_of(packed: pa.Array, kind: str | type) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(-1, FEATURES)


def _unpacked(batch: pa.RecordBatch, share: dict[tuple[int, int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, answers and weights of a batch of (bins, kind, y, n)."""
    binned = _rows_of(batch["bins"], np.uint8)
    y, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "n"))
    weight = np.array([share[k] for k in zip(batch["kind"].to_pylist(), y.tolist())])
    return binned, y.astype(float), weight * n


class SharedRows:
    """Distinct rows of bins in a written table; tasks sum them, level by level."""

    def __init__(self, rows: DataFrame, share: dict[tuple[int, int], float], features: int):
        self.rows, self.share, self.features = rows, share, features

    def level(self, model: Boosted, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        share, shape = self.share, (2**depth, self.features, _BINS, 3)

        def add(batches):
            out = np.zeros(shape, np.int64)
            for batch in batches:
                binned, y, weight = _unpacked(batch, share)
                out += sums(model.binned_margins(binned), binned, y, weight, _place(binned, feature, cut, depth), 2**depth)
            flat = out.reshape(-1, 3)
            cell = np.flatnonzero(flat.any(1))
            columns = [cell, *(np.ascontiguousarray(flat[cell, i]) for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cell", "g", "h", "k"])

        made = self.rows.mapInArrow(add, "cell long, g long, h long, k long").groupBy("cell")
        # a row for each node, feature and bin at most
        found = made.agg(*[F.sum(c).alias(c) for c in "ghk"]).toArrow()
        out = np.zeros((math.prod(shape[:3]), 3), np.int64)
        out[found["cell"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in "ghk"])
        return out.reshape(shape)


def grow(rows: Rows | SharedRows, model: Boosted, rounds: int = 60, rate: float = 0.2, least: int = 8, ridge: float = 1.0) -> Boosted:
    """Gradient boosting with logistic loss; splits by second-order gain over the sums that ``rows`` gives."""
    for _ in range(rounds):
        feature, cut = np.zeros(2**_DEPTH - 1, np.int64), np.full(2**_DEPTH - 1, _BINS)
        leaf = np.zeros(2**_DEPTH)
        for depth in range(_DEPTH):
            levels = rows.level(model, feature, cut, depth).cumsum(2) / UNIT
            for i, level in enumerate(levels):
                node, (g, h, k) = 2**depth - 1 + i, np.moveaxis(level, 2, 0)
                of_all = g[:1, -1], h[:1, -1], k[:1, -1]
                if of_all[2] >= 2 * least:
                    gain = g**2 / (h + ridge) + (of_all[0] - g) ** 2 / (of_all[1] - h + ridge) - of_all[0] ** 2 / (of_all[1] + ridge)
                    gain[(k < least) | (of_all[2] - k < least)] = 0
                    if gain.max() > 1e-6:
                        feature[node], cut[node] = np.unravel_index(gain.argmax(), gain.shape)
                if depth + 1 == _DEPTH:
                    at = feature[node], min(cut[node], _BINS - 1)
                    for side, (a, b) in enumerate(((g[at], h[at]), (of_all[0][0] - g[at], of_all[1][0] - h[at]))):
                        leaf[2 * i + side] = -rate * a / (b + ridge)
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def _start(of_one: float, of_all: float) -> float:
    return float(np.log((of_one + 1) / (of_all - of_one + 1)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, weights: np.ndarray | None = None) -> Boosted:
    """Trees from rows in memory."""
    weights = np.ones(len(x)) if weights is None else weights
    edges = [edges_of(x[:, j], weights) for j in range(x.shape[1])]
    model = Boosted(edges, start=_start(weights @ y, weights.sum()))
    return grow(Rows(model.bins(x), y, weights), model, rounds)


def _reach(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts in order, and the furthest end among the spans up to each."""
    ordered = sorted((a, b) for _, a, b in spans)
    return [a for a, _ in ordered], list(accumulate((b for _, b in ordered), max))


@dataclass
class PiiModel:
    trees: Boosted | None
    thresholds: dict[str, float]

    def spans(self, texts: list[str]) -> list[list[dict]]:
        """Redactions of each text: the strict ones, then what the trees select beside them."""
        strict = [strict_spans(x) for x in texts]
        loose = [(i, *c) for i, x in enumerate(texts) for c in candidates(x)]
        judged = [j for j, (_, kind, _, _) in enumerate(loose) if self.trees and kind in self.thresholds]
        # where a kind has no threshold, its format decides
        scores = [float(kind not in self.thresholds and confirmed(kind, texts[i][a:b])) for i, kind, a, b in loose]
        if judged:
            figures = grid(np.array([describe(k, texts[i], a, b) for i, k, a, b in (loose[j] for j in judged)]))
            for j, p in zip(judged, self.trees.scores(figures)):
                scores[j] = p
        taken: dict[int, list[tuple[float, str, int, int]]] = {}
        reach = {i: _reach(own) for i, own in enumerate(strict)}
        for (i, kind, a, b), p in zip(loose, scores):
            # a span inside a strict one adds nothing
            starts, furthest = reach[i]
            at = bisect_right(starts, a)
            if p >= self.thresholds.get(kind, 1.0) and not (at and furthest[at - 1] >= b):
                taken.setdefault(i, []).append((float(p), kind, a, b))
        out = []
        for i, own in enumerate(strict):
            found = [{"kind": k, "start": a, "end": b, "base": True, "score": 1.0} for k, a, b in own]
            chosen: list[tuple[int, int]] = []  # disjoint, by start
            for p, kind, a, b in sorted(taken.get(i, ()), key=lambda x: (-x[0], x[2] - x[3], x[2])):
                at = bisect_right(chosen, (a, b))
                if not (at and chosen[at - 1][1] > a) and not (at < len(chosen) and chosen[at][0] < b):
                    chosen.insert(at, (a, b))
                    found.append({"kind": kind, "start": a, "end": b, "base": False, "score": p})
            out.append(sorted(found, key=lambda x: (KINDS.index(x["kind"]), x["start"], x["end"])))
        return out


def calibrate(kind: np.ndarray, step: np.ndarray, right: np.ndarray, held: np.ndarray, precision: float) -> dict[str, float]:
    """Thresholds by kind, from the confirmed (``right``) and all candidates (``held``) of each kind and step of the score.

    A kind's threshold is the lowest score above which its precision holds (half-way to the
    next one, 0.5 at least); a kind without confirmed rows has none, and its format decides.
    """
    thresholds = {}
    for number, name in enumerate(KINDS):
        own = np.flatnonzero(kind == number)
        own = own[np.argsort(-step[own], kind="stable")]
        up_to = right[own].cumsum()
        good = up_to >= precision * held[own].cumsum() - 1e-9
        if own.size and up_to[-1] and good.any():
            last = np.flatnonzero(good)[-1]
            below = step[own][last + 1] + 1 if last + 1 < len(own) else 0
            thresholds[name] = max(0.5, float((step[own][last] + below) / 2 / SCORE_STEPS))
    return thresholds


def _steps(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * SCORE_STEPS).astype(np.int64)


def train(x: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float = PRECISION, weights: np.ndarray | None = None) -> PiiModel:
    """Trees from three quarters of rows in memory; thresholds from the rest, by kind.

    ``weights``: the candidates that each row stands for, for the precision.
    """
    if not y.any() or y.all():
        return PiiModel(None, {})
    weights = np.ones(len(x)) if weights is None else weights
    rest = np.arange(len(x)) % 4 == 3
    trees = boost(x[~rest], y[~rest])
    cells, at = np.unique(np.column_stack([kind[rest], _steps(trees.scores(x[rest]))]), axis=0, return_inverse=True)
    right, held = (np.bincount(at.ravel(), w, len(cells)) for w in ((weights * y)[rest], weights[rest]))
    return PiiModel(trees, calibrate(cells[:, 0], cells[:, 1], right, held, precision))


def all_figures(docs: DataFrame) -> DataFrame:
    """figures, kind, y, rest and n: how many candidates of all texts have these figures; written once.

    ``y``: the format test confirms; ``rest``: a quarter of the candidates, by a hash of id, place and text.
    """

    def make():
        def work(batch):
            n: Counter = Counter()
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                found = candidates(text)
                packed = grid(np.array([describe(k, text, a, b) for k, a, b in found], float)).astype("<f4")
                for (kind, a, b), x in zip(found, packed):
                    rest = crc32(f"{doc}:{a}:{text[a:b]}".encode(errors="replace")) % 4 == 3
                    n[x.tobytes(), KINDS.index(kind), confirmed(kind, text[a:b]), rest] += 1
            columns = list(zip(*n)) if n else [[]] * 4
            kinds = (pa.binary(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())
            return {c: pa.array(v, t) for c, v, t in zip(("figures", "kind", "y", "rest", "n"), [*columns, list(n.values())], kinds)}

        return work

    schema = T.StructType.fromDDL("figures binary, kind int, y boolean, rest boolean, n long")
    counted = map_batches(whole_texts(docs), schema, make).groupBy("figures", "kind", "y", "rest").agg(F.sum("n").alias("n"))
    return stage(counted, "figures")


def _feature_edges(learned: DataFrame, share: dict[tuple[int, int], float]) -> list[np.ndarray]:
    """Quantiles of each feature over all candidates that the trees learn from."""

    def make():
        def work(batch):
            x = _rows_of(batch["figures"], "<f4")
            weight = np.array([share[k] for k in zip(batch["kind"].to_pylist(), batch["y"].to_pylist())]) * batch["n"].to_numpy()
            whole, out = np.rint(weight * UNIT).astype(np.int64), []
            for j in range(FEATURES):
                value, at = np.unique(x[:, j], return_inverse=True)
                total = np.zeros(len(value), np.int64)
                np.add.at(total, at, whole)
                out.append((np.full(len(value), j), value, total))
            feature, value, weight = (np.concatenate(c) for c in zip(*out))
            return {"feature": pa.array(feature, pa.int32()), "value": pa.array(value, pa.float64()), "weight": pa.array(weight)}

        return work

    made = map_batches(learned, T.StructType.fromDDL("feature int, value double, weight long"), make)
    # seven bits leave 64 values for each doubling
    found = made.groupBy("feature", "value").agg(F.sum("weight").alias("weight")).toArrow()
    feature, value, weight = (found[c].to_numpy() for c in ("feature", "value", "weight"))
    return [edges_of(value[feature == j], weight[feature == j] / UNIT) for j in range(FEATURES)]


def fit(docs: DataFrame, fit_candidates: int = FIT_CANDIDATES) -> PiiModel:
    """Learn from all candidates of all documents.

    For the trees a kind's confirmed and refuted candidates weigh one each, or together
    ``fit_candidates`` over the number of kinds, if there are more; for the thresholds, each counts one.
    Without confirmed and refuted candidates only formats decide.
    """
    counted = all_figures(docs)
    # at most two rows a kind
    totals = {(r["kind"], r["y"]): r["n"] for r in counted.groupBy("kind", "y").agg(F.sum("n").alias("n")).collect()}
    learned = counted.where("NOT rest")
    answers = {r["y"] for r in learned.select("y").distinct().collect()}
    if answers != {False, True}:
        return PiiModel(None, {})
    share = {k: min(1.0, fit_candidates / len(KINDS) / n) for k, n in totals.items()}
    model = Boosted(_feature_edges(learned, share))

    def to_bins():
        def work(batch):
            packed = model.bins(_rows_of(batch["figures"], "<f4")).astype(np.uint8)
            return {"bins": pa.array([b.tobytes() for b in packed], pa.binary()), **{c: batch[c] for c in ("kind", "y", "rest", "n")}}

        return work

    made = map_batches(counted, T.StructType.fromDDL("bins binary, kind int, y boolean, rest boolean, n long"), to_bins)
    binned = stage(made.groupBy("bins", "kind", "y", "rest").agg(F.sum("n").alias("n")), "bins")
    learned = binned.where("NOT rest").select("bins", "kind", "y", "n")
    held = learned.groupBy("kind", "y").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    weighs = {(r["kind"], r["y"]): share[r["kind"], r["y"]] * r["n"] for r in sorted(held)}
    model.start = _start(sum(w for (_, y), w in weighs.items() if y), sum(weighs.values()))
    if sum(r["rows"] for r in held) <= IN_PLACE:
        here = learned.orderBy("bins", "y").toArrow().combine_chunks().to_batches()
        grow(Rows(*_unpacked(here[0], share)), model)
    else:
        grow(SharedRows(learned, share, FEATURES), model)

    def to_steps():
        def work(batch):
            steps = _steps(model.binned_scores(_rows_of(batch["bins"], np.uint8)))
            return {"kind": batch["kind"], "step": pa.array(steps, pa.int32()), "y": batch["y"], "n": batch["n"]}

        return work

    scored = map_batches(binned.where("rest"), T.StructType.fromDDL("kind int, step int, y boolean, n long"), to_steps)
    # a row for each kind and step at most
    steps = scored.groupBy("kind", "step").agg(F.sum(F.col("n") * F.col("y").cast("int")).alias("right"), F.sum("n").alias("held")).toArrow()
    return PiiModel(model, calibrate(*(steps[c].to_numpy() for c in ("kind", "step", "right", "held")), PRECISION))


_SPANS = "array<struct<kind:string, start:int, `end`:int, base:boolean, score:double>>"
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
)


def detect(docs: DataFrame, model: PiiModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and the text's spans, by kind in the order of `KINDS`, then start.

    Offsets are code points, the end exclusive. Null and empty texts have no spans; every
    row is searched by itself, so repeated rows get equal spans and an empty table gives an
    empty one. A column of ``carry`` named ``spans`` is left out.
    """
    return with_text_columns(docs, f"spans {_SPANS}", lambda: lambda texts: [pa.array(model.spans(texts), _ARROW_SPANS)], carry)


def redact_text(text: str, spans: list[dict]) -> str:
    """The text with spans replaced by their kind in brackets; overlapping ones become one."""
    parts, at = [], 0
    for span in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if span["start"] >= at:
            parts += [text[at : span["start"]], f"[{span['kind'].upper()}]"]
        at = max(at, span["end"])
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """All columns of the documents, with redacted ``text`` and, if there is one, its new ``n_chars``.

    Null texts stay null; a text without spans stays as it is, and so does its n_chars.
    """
    sized = "n_chars" in docs.columns

    def make():
        def work(batch):
            texts = batch["text"].to_pylist()
            spans = model.spans([x or "" for x in texts])
            out = {c: batch[c] for c in batch.schema.names}
            out["text"] = pa.array([x and redact_text(x, s) for x, s in zip(texts, spans)], pa.string())
            if sized:
                old = batch["n_chars"].to_pylist()
                new = [len(x) if s else n for n, x, s in zip(old, out["text"].to_pylist(), spans)]
                out["n_chars"] = pa.array(new, batch["n_chars"].type)
            return out

        return work

    return map_batches(docs, docs.schema, make)
