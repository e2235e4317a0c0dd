"""Brown class-based n-gram scores.

P(word | previous word) = P(class | previous class) * P(word | class). Exchange clustering
gives the classes: each unit moves to the class that most raises the likelihood of the
class bigrams, until none moves. Units are all words that are common enough to have contexts of
their own, and for all other words, seen or not, their endings, each of them; so a task knows every word's
class.

1. Words are counted once, exactly, and their table is written.
2. The commonest units are exchanged one by one, on a matrix of bounded size, for a start.
3. Then all units are exchanged in rounds over written bigram counts: Spark sums each unit's
   neighbours by class, and a task moves the units it was given, each to its best class under the
   class counts of the round. A part of the units may move in a round, so that neighbours seldom move
   at once; a round that lowers the likelihood is taken back, and then fewer may move.
4. A text is scored in place but for the counts of rare words, which an equi join with the word
   table brings.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import fields, id_remainder
from wakeline.sources.staging import stage

#: Rows whose id has this remainder are scored but not learned from.
FOLDS, HELD_OUT = 5, 1
ADD = 0.5
#: Words at most whose counts are held in place.
HEAD = 65_536
#: A word is a unit if it is one in so many words, which no more than so many are, and seen at least so often.
UNIT_SHARE, UNIT_SEEN = 65_536, 10
#: Bytes of an ending.
ENDING = 3
#: Words and endings that are exchanged one by one for a start, and bounds of the number of classes.
START_WORDS, START_ENDINGS, LEAST_CLASSES, MOST_CLASSES = 512, 254, 16, 256
#: Steps of a doubling in the histogram of counts.
STEPS = 64
#: Weight of the class unigram in a transition.
BACK_OFF = 5.0
#: Rounds over one matrix; rounds over all units, the groups in which units are moved, and units of a group at most, about.
EXCHANGE_ROUNDS, ROUNDS, GROUPS, GROUP_UNITS = 12, 6, 64, 2_048
WORD_ENDS = r"[\x20\x09-\x0D]+"


def tokens_of(text: str | None) -> list[bytes]:
    """Words, A-Z lowered; the end token is left to the callers."""
    return (text or "").encode().lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word and n of every distinct word of the texts, written once."""
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = docs.select(F.explode(F.split(low, WORD_ENDS)).alias("word")).where("word != ''")
    return stage(words.groupBy("word").agg(F.count("*").alias("n")), "words")


@dataclass
class Units:
    """Unit 0 is the end token, then words, then endings; the last unit has endings that are not among these."""

    words: dict[bytes, int]
    endings: dict[bytes, int]
    head: dict[bytes, int]

    @property
    def n(self) -> int:
        return len(self.words) + len(self.endings) + 2

    def of(self, words: list[bytes]) -> np.ndarray:
        own, ends, other = self.words.get, self.endings.get, self.n - 1
        found = [own(w) or ends(w[-ENDING:], other) for w in words]
        return np.array([0, *found, 0], np.int64)


def make_units(head: list[bytes], endings: list[bytes], common: list[bytes]) -> Units:
    words = {w: i + 1 for i, w in enumerate(common)}
    ends = {e: len(words) + 1 + i for i, e in enumerate(endings)}
    return Units(words, ends, {w: i for i, w in enumerate(head)})


def common_words(words: DataFrame, most: int) -> DataFrame:
    """The words above a count, the lowest count (to about a hundredth) that no more than ``most`` reach.

    A histogram of counts tells it: a sort would send ``most`` rows of every partition on.
    """
    step = F.floor(F.log2("n") * STEPS)
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("words"))
    up_to, lowest = 0, None
    for row in sorted(steps.collect(), reverse=True):  # STEPS rows for each doubling of counts
        up_to += row.words
        if up_to > most:
            break
        lowest = row.step
    return words.where(step >= lowest) if lowest is not None else words.limit(0)


def choose_units(words: DataFrame, head: int, endings: int | None, most: int) -> tuple[Units, np.ndarray, int]:
    """Units, the head words' counts, and the number of words.

    All words common enough are units, ``most`` at most; `UNIT_SHARE` bounds them, as each has its share.
    Without ``endings`` all endings are units: their number is that of the language's, not of its words.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ordered = lambda rows: sorted(rows.collect(), key=lambda r: (-r.n, r.word))
    top = ordered(common_words(words, head))
    common = ordered(words.where((F.col("n") >= UNIT_SEEN) & (F.col("n") * UNIT_SHARE >= total)))[:most]
    ending = F.substring(F.col("word").cast("binary"), -ENDING, ENDING)
    tails = words.groupBy(ending.alias("e")).agg(F.sum("n").alias("n")).collect()
    tails = sorted(tails, key=lambda r: (-r.n, bytes(r.e)))[:endings]
    units = make_units([r.word.encode() for r in top], [bytes(r.e) for r in tails], [r.word.encode() for r in common])
    return units, np.array([r.n for r in top], np.int64), total


def count_bigrams(docs: DataFrame, units: Units) -> DataFrame:
    """a, b and n of all neighbouring units in the texts, the end on both sides; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            each = [own.of(tokens_of(text)) for text in batch["text"].to_pylist()]
            offsets = np.cumsum([0, *(len(at) - 1 for at in each)])
            flat = np.concatenate([at[:-1] << 32 | at[1:] for at in each]) if each else np.empty(0, np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([lists.cast(pa.list_(pa.int64()))], ["pairs"])

    made = docs.select("text").mapInArrow(pairs, "pairs array<long>").select(F.explode("pairs").alias("pair"))
    counted = made.groupBy("pair").agg(F.count("*").alias("n"))
    a, b = F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return stage(counted.select(a.alias("a"), b.alias("b"), "n"), "bigrams")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gain(count: np.ndarray, left: np.ndarray, right: np.ndarray, alone: float) -> np.ndarray:
    """What the likelihood gains by giving a unit to each class; the end's class is closed.

    ``count`` is without the unit, ``left`` and ``right`` its neighbours without itself.
    """
    # classes without a neighbour of the unit add nothing
    l, r = np.flatnonzero(left), np.flatnonzero(right)
    by_left = _xlogx(count[l] + left[l, None]) - _xlogx(count[l])
    by_right = _xlogx(count[:, r] + right[None, r]) - _xlogx(count[:, r])
    diagonal = np.diag(count)
    out, into = count.sum(1), count.sum(0)
    gain = (
        by_left.sum(0) + by_right.sum(1)
        + _xlogx(diagonal + left + right + alone) - _xlogx(diagonal)
        - _xlogx(out + right.sum() + alone) + _xlogx(out) - _xlogx(into + left.sum() + alone) + _xlogx(into)
    )
    gain[l] -= by_left[np.arange(len(l)), l]
    gain[r] -= by_right[r, np.arange(len(r))]
    gain[0] = -np.inf
    return gain


def exchange(pairs: np.ndarray, classes: int, rounds: int = EXCHANGE_ROUNDS) -> np.ndarray:
    """Class of each unit. The end token keeps class 0 to itself; no move lowers the likelihood."""
    n = len(pairs)
    if classes < 2 or n < 2:
        return np.zeros(n, np.int64)
    pairs = pairs.astype(float)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    order = order[order != 0]
    label = np.zeros(n, np.int64)
    label[order] = np.arange(len(order)) % (classes - 1) + 1
    member = np.zeros((n, classes))
    member[np.arange(n), label] = 1
    count = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for u in order:
            own, alone = label[u], pairs[u, u]
            left = np.bincount(label, pairs[:, u], classes)
            right = np.bincount(label, pairs[u], classes)
            left[own] -= alone
            right[own] -= alone
            count[:, own] -= left
            count[own] -= right
            count[own, own] -= alone
            gain = _gain(count, left, right, alone)
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            label[u] = best
            count[:, best] += left
            count[best] += right
            count[best, best] += alone
        if not moved:
            break
    return label


def _matrix(rows: DataFrame, n: int) -> np.ndarray:
    """A square of ``n`` from rows of (a, b, n), all of them below ``n``."""
    table = rows.select("a", "b", "n").toArrow()
    a, b, k = (table[c].to_numpy() for c in ("a", "b", "n"))
    out = np.zeros((n, n))
    np.add.at(out, (a, b), k)
    return out


def likelihood(count: np.ndarray) -> float:
    """What the exchange raises, of class bigram counts."""
    return float(_xlogx(count).sum() - _xlogx(count.sum(0)).sum() - _xlogx(count.sum(1)).sum())


def start_labels(bigrams: DataFrame, units: Units, classes: int, start_words: int) -> np.ndarray:
    """The end, the commonest words and endings exchanged on one matrix.

    Other words start as their ending, and other endings all together.
    """
    first = min(len(units.words), start_words) + 1
    shift = len(units.words) + 1 - first
    last = first + min(len(units.endings), START_ENDINGS)
    kept = lambda c: (F.col(c) < first) | (F.col(c) > len(units.words))
    at = lambda c: F.when(F.col(c) < first, F.col(c)).otherwise(F.least(F.col(c) - shift, F.lit(last))).alias(c)
    summed = bigrams.where(kept("a") & kept("b")).groupBy(at("a"), at("b")).agg(F.sum("n").alias("n"))
    small = exchange(_matrix(summed, last + 1), classes)
    label = np.full(units.n, small[last])
    label[:first] = small[:first]
    label[first + shift : last + shift] = small[first:last]
    for word, unit in units.words.items():
        if unit >= first:
            label[unit] = label[units.endings.get(word[-ENDING:], units.n - 1)]
    return label


def _neighbours(bigrams: DataFrame, label: np.ndarray) -> DataFrame:
    """unit, side (0: what follows, 1: what comes before, 2: itself), class and n; written once."""
    known = bigrams.sparkSession.createDataFrame(pa.table({"unit": pa.array(np.arange(len(label)), pa.int32()), "class": pa.array(label, pa.int32())}))

    def side(number: int, unit: str, other: str) -> DataFrame:
        # a row for each unit, which are bounded
        joined = bigrams.join(F.broadcast(known.withColumnRenamed("unit", other)), other)
        return joined.groupBy(F.col(unit).alias("unit"), F.lit(number).alias("side"), "class").agg(F.sum("n").alias("n"))

    alone = bigrams.where("a = b").select(F.col("a").alias("unit"), F.lit(2).alias("side"), F.lit(0).alias("class"), "n")
    return stage(side(0, "a", "b").unionByName(side(1, "b", "a")).unionByName(alone), "neighbours")


def move_units(at: np.ndarray, left: np.ndarray, right: np.ndarray, alone: np.ndarray, label: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Classes of the units ``at`` after each has moved to its best one, the commonest first.

    ``left`` and ``right`` are the units' neighbours by class (a row each), ``alone`` their own pairs.
    Class counts follow the moves made here; neighbours stay as the round found them.
    """
    found, count = label[at].copy(), count.copy()
    for i in np.argsort(-(left.sum(1) + right.sum(1)), kind="stable"):
        before, after, own, self_pairs = left[i].copy(), right[i].copy(), found[i], alone[i]
        before[own] -= self_pairs
        after[own] -= self_pairs
        count[:, own] = np.maximum(count[:, own] - before, 0)
        count[own] = np.maximum(count[own] - after, 0)
        count[own, own] = max(count[own, own] - self_pairs, 0)
        gain = _gain(count, before, after, self_pairs)
        best = int(gain.argmax())
        if gain[best] <= gain[own] + 1e-9:
            best = own
        found[i] = best
        count[:, best] += before
        count[best] += after
        count[best, best] += self_pairs
    return found


def exchange_all(bigrams: DataFrame, label: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of all units after some rounds; the end token stays alone in class 0.

    Only classes, one number per unit, and class counts pass the driver.
    """
    best, highest, one_in = label, -np.inf, 2
    for turn in range(rounds + 1):
        near = _neighbours(bigrams, label)
        of_unit = bigrams.sparkSession.createDataFrame(
            pa.table({"unit": pa.array(np.arange(len(label)), pa.int32()), "a": pa.array(label, pa.int32())})
        )
        followed = near.where("side = 0").join(F.broadcast(of_unit), "unit")
        count = _matrix(followed.groupBy("a", F.col("class").alias("b")).agg(F.sum("n").alias("n")), classes)
        value = likelihood(count)
        if value > highest:
            best, highest, kept, matrix = label, value, near, count
        else:
            one_in *= 2
        if turn == rounds:
            break
        now, counts = best, matrix

        def move(table: pa.Table) -> pa.Table:
            unit, side, of_class, n = (table[c].to_numpy() for c in ("unit", "side", "class", "n"))
            at, row = np.unique(unit, return_inverse=True)
            sides = np.zeros((3, len(at), classes))
            np.add.at(sides, (side, row, of_class), n)
            moved = move_units(at, sides[1], sides[0], sides[2, :, 0], now, counts)
            return pa.table({"unit": pa.array(at, pa.int32()), "class": pa.array(moved, pa.int32())})

        chosen = kept.where((F.col("unit") != 0) & (F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(one_in)) == 0))
        group = F.pmod(F.xxhash64("unit", F.lit(1)), F.lit(max(GROUPS, len(label) // GROUP_UNITS)))
        moved = chosen.groupBy(group).applyInArrow(move, "unit int, class int").toArrow()
        label = best.copy()
        label[moved["unit"].to_numpy()] = moved["class"].to_numpy()
    return best


@dataclass
class ClassModel:
    units: Units
    label: np.ndarray
    head_counts: np.ndarray
    words: DataFrame
    """word and n of every word learned from."""
    class_tokens: np.ndarray
    class_types: np.ndarray
    transitions: np.ndarray
    training_texts: int

    @property
    def classes(self) -> int:
        return len(self.class_tokens)

    @property
    def tokens(self) -> int:
        return int(self.class_tokens.sum())


def _types(words: DataFrame, units: Units, label: np.ndarray, classes: int) -> np.ndarray:
    """Distinct words of each class."""
    shared = words.sparkSession.sparkContext.broadcast((units, label))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of_unit = shared.value
        for batch in batches:
            at = own.of([w.encode() for w in batch["word"].to_pylist()])[1:-1]
            yield pa.RecordBatch.from_pydict({"class": pa.array(of_unit[at], pa.int32())})

    counted = words.select("word").mapInArrow(classify, "class int").groupBy("class").agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(classes, np.int64)
    out[counted["class"].to_numpy()] = counted["n"].to_numpy()
    return out


def fit(
    docs: DataFrame,
    head: int = HEAD,
    word_units: int = UNIT_SHARE,
    endings: int | None = None,
    classes: int | None = None,
    start_words: int = START_WORDS,
    rounds: int = ROUNDS,
) -> ClassModel:
    """Classes and transitions from all texts of ``docs``; null texts are empty ones.

    ``word_units`` and ``endings`` bound the words and endings that are units, for a smaller model;
    without ``classes`` there are about as many as the root of twice the units.
    """
    words = count_words(docs)
    units, heads, _ = choose_units(words, head, endings, word_units)
    classes = classes or min(MOST_CLASSES, max(LEAST_CLASSES, isqrt(2 * units.n)))
    bigrams = count_bigrams(docs, units)
    label = start_labels(bigrams, units, classes, start_words)
    if len(units.words) > start_words or len(units.endings) > START_ENDINGS:
        label = exchange_all(bigrams, label, classes, rounds)
    spark = docs.sparkSession
    of = lambda c, k: spark.createDataFrame(pa.table({c: pa.array(np.arange(len(label)), pa.int32()), k: pa.array(label, pa.int32())}))
    classed = bigrams.join(F.broadcast(of("a", "x")), "a").join(F.broadcast(of("b", "y")), "b")
    count = _matrix(classed.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("n").alias("n")), classes)
    into = count.sum(0)
    share = (into + ADD) / (into.sum() + ADD * classes)
    transitions = np.log10((count + BACK_OFF * share[None, :]) / (count.sum(1) + BACK_OFF)[:, None])
    types = _types(words, units, label, classes)
    texts = int(into[0])
    types[0] += texts > 0
    return ClassModel(units, label, heads, words, into.astype(np.int64), types, transitions, texts)


def score(docs: DataFrame, model: ClassModel, learn: Column) -> DataFrame:
    """Scores of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``learn`` is a boolean column: true where the text is among those that the model was
    fitted on. Null and empty texts have the end token only. Rows are scored one by one, so
    repeated rows get equal scores; a null doc_id is kept; an empty table gives an empty
    one. Columns besides doc_id and text do not matter, whatever their names.
    """
    figures = "held_out boolean, n_tokens long, n_known long, log_counts double, rest double, rare array<string>, times array<int>"
    below = np.log10(model.class_tokens + ADD * (model.class_types + 1))
    total = float(np.log10(model.tokens + ADD * (model.class_types.sum() + 1)))
    ends = model.training_texts
    parts = (model.units, model.label, model.head_counts, model.transitions, below)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, label, heads, transitions, under = shared.value
        place, log_head = units.head.get, np.log10(heads + ADD)
        for batch in batches:
            made = []
            for text in batch["text"].to_pylist():
                words = tokens_of(text)
                at = label[units.of(words)]
                spots = [place(w) for w in words]
                here = np.array([i for i in spots if i is not None], np.int64)
                rare = Counter(w for w, i in zip(words, spots) if i is None)
                made.append((
                    len(words) + 1,
                    len(here) + (ends > 0),
                    float(log_head[here].sum()) + float(np.log10(ends + ADD)),
                    float(transitions[at[:-1], at[1:]].sum() - under[at[1:]].sum()),
                    [w.decode() for w in rare],
                    list(rare.values()),
                ))
            columns = list(zip(*made)) if made else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *arrays], schema.names)

    schema = fields(docs, figures)
    told = docs.select("doc_id", "text", (~learn).alias("held_out")).mapInArrow(rows, schema)
    told = stage(told.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = told.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = rare.select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # one row per word on this side: its partitions are even, and hold what a task can hash
    counted = rare.join(model.words.hint("shuffle_hash"), "word", "left")
    n = F.coalesce("n", F.lit(0))
    sums = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + F.lit(ADD))).alias("rare_logs"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    zero = F.lit(0.0)
    logs = F.col("log_counts") + F.coalesce("rare_logs", zero)
    value = logs + F.col("rest")
    return told.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * total).alias("base_score"),
        value.alias("score"),
        F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )


def score_corpus(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, **parameters) -> DataFrame:
    """Fit on the rows whose id has another remainder than ``held_out``, and score all rows."""
    learn = id_remainder(folds) != held_out
    return score(docs, fit(docs.where(learn), **parameters), learn)
