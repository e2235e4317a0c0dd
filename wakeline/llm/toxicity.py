"""Toxicity from the nearest labelled examples.

Similarity is the cosine of TF-IDF vectors over all words of the texts; document frequencies
come from all documents. A word that the labelled rows tie to the toxic class weighs more, none
weighs nothing. The examples lie in an inverted index cut into blocks of examples. Lists of
rare words are short and always read; lists of common words are read a block at a time, and
only in blocks where the greatest weights can still reach the k-th best. Blocks are read in
single precision, with an allowance for its error; what may be among the k nearest is summed
once more in double precision, so the k nearest are exact.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wakeline.llm.common import fields, id_remainder, map_batches, sampled, whole_texts, with_text_columns
from wakeline.sources.staging import stage

#: Labelled examples of each class that the index holds at most, about, and bytes of all their texts.
EXAMPLES = 10_000
EXAMPLE_BYTES = 256 << 20
#: Weight of a word without a tie to the toxic class, as a part of what a tie by a factor of e adds.
FLOOR = 0.2
NEIGHBOURS = 15
BLOCK = 128
#: Words in so large a share of the examples are common: their lists are dense rows by block.
COMMON = 1 / 16
#: Blocks of a query that are looked into first, which sets the score that others must reach.
FIRST_BLOCKS = 2
#: Queries that are answered together, and texts and characters that are read together (one text at least).
QUERIES = 256
TEXTS, CHARACTERS = 1 << 12, 6 << 20
#: Queries whose lists of rare words are read together, and words of neighbours that are summed together.
READ, SUMMED = 4, 1 << 20
#: Rows whose id has this remainder are never learned from.
FOLDS, HELD_OUT = 5, 0

@dataclass
class Bags:
    """Words of some texts: text, number and times of each, in that order, and the number of texts."""

    text: np.ndarray
    word: np.ndarray
    times: np.ndarray
    count: int

    def unit_weights(self, weight: np.ndarray) -> np.ndarray:
        # in place, as all examples' words are many
        values = np.log(self.times.astype(float))
        values += 1
        values *= weight[self.word]
        length = np.sqrt(np.bincount(self.text, values**2, self.count))
        values /= length[self.text]
        return values


class Numbers:
    """Places of words, as written, among the known ones; punctuation at their ends is left out."""

    def __init__(self, known: pa.Array):
        self.known = known

    def bags(self, texts: Sequence[str]) -> Iterator[Bags]:
        """Known words of the texts, in pieces of some texts.

        The known words are hashed once a piece, and every spelling of a piece is looked up once.
        """
        piece, size = [], 0
        for i, text in enumerate(texts):
            piece.append(text)
            size += len(text)
            if len(piece) == TEXTS or size > CHARACTERS or i + 1 == len(texts):
                yield self._bag(piece)
                piece, size = [], 0

    def _bag(self, texts: list[str]) -> Bags:
        sizes, parts = [], []
        for start in range(0, len(texts), QUERIES):  # few words are Python strings at a time
            split = [text.lower().split() for text in texts[start : start + QUERIES]]
            sizes += map(len, split)
            parts.append(pa.array(list(chain.from_iterable(split)), pa.string()))
        held = pa.chunked_array(parts, pa.string()).dictionary_encode().combine_chunks()
        spelt = pc.ascii_trim(held.dictionary, string.punctuation)
        number = pc.fill_null(pc.index_in(spelt, value_set=self.known), -1).to_numpy().astype(np.int64)
        word = number[held.indices.to_numpy()]
        known = word >= 0
        words = max(len(self.known), 1)
        cell = np.repeat(np.arange(len(texts)) * words, sizes)[known] + word[known]
        cell.sort()
        first = np.flatnonzero(np.diff(cell, prepend=-1))  # spellings of one word meet
        text, word = np.divmod(cell[first], words)
        return Bags(text, word, np.diff(first, append=len(cell)), len(texts))


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples by word, in blocks of `BLOCK` neighbouring examples."""

    ids: list
    toxic: np.ndarray
    starts: np.ndarray  # first posting of each rare word; one more ends the last
    rows: np.ndarray
    values: np.ndarray
    column: np.ndarray  # number of a common word among these, or -1
    dense: np.ndarray  # [block, common word, example of the block], single precision
    most: np.ndarray  # [common word, block]: greatest weight, rounded up
    first: np.ndarray  # first common word of each example; one more ends the last
    columns: np.ndarray
    weights: np.ndarray
    opened: list[int] = field(default_factory=lambda: [0, 0])  # blocks looked into, and all there were

    @classmethod
    def build(
        cls, ids: list, toxic: np.ndarray, example: np.ndarray, word: np.ndarray, value: np.ndarray, words: int
    ) -> BlockMaxIndex:
        """Of postings (example, word, value), sorted by example."""
        n = len(ids)
        blocks = -(-n // BLOCK)
        held = np.bincount(word, minlength=words)
        common = np.flatnonzero(held >= max(COMMON * n, 1))
        column = np.full(words, -1)
        column[common] = np.arange(len(common))
        # neighbours share their heaviest common word, and weigh it alike, which tightens the bounds
        is_common = column[word] >= 0
        e, w, v = example[is_common], word[is_common], value[is_common]
        sort = np.lexsort((v, e))
        last = np.flatnonzero(np.diff(e[sort], append=-1))
        heavy, weight = np.full(n, -1), np.zeros(n)
        heavy[e[sort][last]], weight[e[sort][last]] = w[sort][last], v[sort][last]
        order = np.lexsort((np.arange(n), weight, heavy))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        dense = np.zeros((blocks, len(common), BLOCK), np.float32)
        dense[place[e] // BLOCK, column[w], place[e] % BLOCK] = v
        most = np.nextafter(dense.max(2), np.float32(np.inf)) if n else np.zeros((0, len(common)))
        sort = np.argsort(place[e], kind="stable")
        first = np.searchsorted(place[e[sort]], np.arange(n + 1))
        columns, weights = column[w[sort]].astype(np.int32), v[sort]
        e, w, v = place[example[~is_common]], word[~is_common], value[~is_common]
        sort = np.lexsort((e, w))
        return cls(
            [ids[i] for i in order],
            np.asarray(toxic, float)[order],
            np.searchsorted(w[sort], np.arange(words + 1)),
            e[sort],
            v[sort],
            column,
            dense,
            most.T.astype(float),
            first,
            columns,
            weights,
        )

    def _read_rare(self, query: np.ndarray, word: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
        """The part of rare words in every cosine, [query, place]."""
        size = len(self.dense) * BLOCK
        out = np.empty((count, size))
        start, length = self.starts[word], self.starts[word + 1] - self.starts[word]
        of = np.searchsorted(query, np.arange(0, count + READ, READ))
        for i, a, b in zip(range(0, count, READ), of, of[1:]):
            many, own = min(READ, count - i), length[a:b]
            at = np.repeat(start[a:b] - (np.cumsum(own) - own), own)
            at += np.arange(len(at))
            cell = np.repeat((query[a:b] - i) * size, own)
            cell += self.rows.take(at)
            values = np.repeat(value[a:b], own)
            values *= self.values.take(at)
            out[i : i + many] = np.bincount(cell, values, many * size).reshape(many, size)
        return out

    def _read_common(self, asked: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The part of common words in the cosine of each pair, in double precision."""
        start, length = self.first[row], self.first[row + 1] - self.first[row]
        total, out = np.cumsum(length), np.zeros(len(row))
        ends = np.searchsorted(total, np.arange(SUMMED, total[-1] if len(row) else 0, SUMMED), "right")
        for part in np.split(np.arange(len(row)), ends):
            own = length[part]
            at = np.arange(own.sum()) + np.repeat(start[part] - (np.cumsum(own) - own), own)
            values = asked[np.repeat(query[part], own), self.columns[at]] * self.weights[at]
            out[part] = np.bincount(np.repeat(np.arange(len(part)), own), values, len(part))
        return out

    def nearest(
        self, query: np.ndarray, word: np.ndarray, value: np.ndarray, count: int, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest with any shared word of each of ``count`` queries; ties by place.

        Words (query, word, value) come in, sorted by query; query, place and cosine of the
        nearest go out, sorted by query, the nearest first.
        """
        blocks = len(self.dense)
        if not blocks or not len(query):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        column = self.column[word]
        rare = column < 0
        cosine = self._read_rare(query[rare], word[rare], value[rare], count).reshape(count, blocks, BLOCK)
        asked = np.zeros((count, self.dense.shape[1]))
        asked[query[~rare], column[~rare]] = value[~rare]
        bound = cosine.max(2) + asked @ self.most
        single = asked.astype(np.float32)
        # a sum of n products in single precision is off by n / 2**24 at most, as no cosine is above 1
        slack = (asked.shape[1] + 8) / 2**23

        opening = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        seen = np.empty((*opening.shape, BLOCK))
        for block in np.unique(opening):
            who, slot = np.nonzero(opening == block)
            seen[who, slot] = cosine[who, block] + single[who] @ self.dense[block]
        flat = seen.reshape(count, -1)
        enough = flat.shape[1] >= k
        floor = np.partition(flat, -k, axis=1)[:, -k] if enough else np.zeros(count)
        # equal bounds are looked into as well: a tie may stand earlier
        least = np.maximum(floor - 2 * slack - 1e-9, 1e-13)
        wanted = bound >= np.maximum(floor - slack - 1e-9, 1e-13)[:, None]
        np.put_along_axis(wanted, opening, False, 1)
        self.opened[0] += int(wanted.sum()) + opening.size
        self.opened[1] += bound.size

        who, slot, at = np.nonzero(seen >= least[:, None, None])
        found = [(who, opening[who, slot] * BLOCK + at, seen[who, slot, at])]
        for block in np.flatnonzero(wanted.any(0)):
            asking = np.flatnonzero(wanted[:, block])
            near = cosine[asking, block] + single[asking] @ self.dense[block]
            who, at = np.nonzero(near >= least[asking, None])
            found.append((asking[who], block * BLOCK + at, near[who, at]))
        who, row, near = (np.concatenate(x) for x in zip(*found))

        # the k-th best of each query that has as many; of the others all are kept
        sort, ends = np.sort(2.0 * who - near), np.cumsum(np.bincount(who, minlength=count))
        last = np.append(0, ends[:-1]) + k - 1
        full = last < ends
        least = np.full(count, -1.0)
        least[full] = 2.0 * np.flatnonzero(full) - sort[last[full]] - 2 * slack - 1e-9
        kept = near >= least[who]
        who, row = who[kept], row[kept]
        near = cosine.reshape(count, -1)[who, row] + self._read_common(asked, who, row)
        who, row, near = (x[near >= 1e-12] for x in (who, row, near))
        order = np.lexsort((row, -np.round(near, 12), who))
        who, row, near = who[order], row[order], near[order]
        kept = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[kept], row[kept], near[kept]


@dataclass
class Examples:
    """What is sent to tasks, in little space: words of the examples and their times. The index is built there."""

    words: pa.Array
    weight: np.ndarray
    ids: list
    toxic: np.ndarray
    sizes: np.ndarray  # words of each example
    word: np.ndarray
    times: np.ndarray

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    @property
    def numbers(self) -> pa.Array:
        """Words in the order of their numbers."""
        return self.words

    @cached_property
    def index(self) -> BlockMaxIndex:
        bags = Bags(np.repeat(np.arange(len(self.ids)), self.sizes), self.word, self.times, len(self.ids))
        return BlockMaxIndex.build(
            self.ids, self.toxic, bags.text, bags.word, bags.unit_weights(self.weight), len(self.words)
        )

    def answers(self, texts: list[str], numbers: Numbers, k: int):
        """For each text the places and cosines of its k nearest examples."""
        for bags in numbers.bags(texts):
            values = bags.unit_weights(self.weight)
            for start in range(0, bags.count, QUERIES):
                count = min(QUERIES, bags.count - start)
                own = slice(*np.searchsorted(bags.text, [start, start + count]))
                who, row, cosine = self.index.nearest(bags.text[own] - start, bags.word[own], values[own], count, k)
                ends = np.searchsorted(who, np.arange(count + 1))
                yield from ((row[a:b], cosine[a:b]) for a, b in zip(ends, ends[1:]))

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Toxic share of the neighbours, each weighing by the inverse of its distance."""
        weight = 1 / (1.05 - np.minimum(cosines, 1))
        return float(weight @ self.index.toxic[rows] / weight.sum())

    def evidence(self, rows: np.ndarray, cosines: np.ndarray) -> list[dict]:
        """The three nearest examples."""
        index = self.index
        return [
            {"doc_id": index.ids[r], "cosine": float(c), "toxic": int(index.toxic[r])} for r, c in zip(rows[:3], cosines[:3])
        ]


@dataclass
class ToxicityModel:
    """``shared`` holds the examples, which are sent to the tasks of fitting and scoring once."""

    shared: Broadcast
    neighbours: int = NEIGHBOURS
    curve: tuple[float, float] = (8.0, -4.0)
    without_words: float = 0.0

    @property
    def examples(self) -> Examples:
        return self.shared.value


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_curve(votes: np.ndarray, toxic: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Weighted logistic curve from vote to probability (Newton steps, a weak pull to a middle curve)."""
    start = np.array([8.0, -4.0])
    x, theta = np.column_stack([votes, np.ones_like(votes)]), start
    weights = weights / max(weights.mean(), 1e-12) if len(weights) else weights
    for _ in range(rounds):
        p = _sigmoid(x @ theta)
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x.T @ (weights * (p - toxic)) + 0.05 * (theta - start))
    return (float(theta[0]), float(theta[1])) if np.isfinite(theta).all() and theta[0] > 0 else tuple(start)


def ties(clean: np.ndarray, toxic: np.ndarray, clean_rows: int, toxic_rows: int) -> np.ndarray:
    """Logarithm of how much commoner each word is in toxic examples; 0 if it is not, or by chance.

    Chance: a likelihood ratio that one in as many words as there are would reach by itself.
    """
    share, n = toxic_rows / (toxic_rows + clean_rows), toxic + clean
    ratio = np.log((toxic + 0.5) / (toxic_rows + 1)) - np.log((clean + 0.5) / (clean_rows + 1))

    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    likelihood = 2 * (part(toxic, n * share) + part(clean, n * (1 - share)))
    return np.where((ratio > 0) & (likelihood >= 2 * np.log(max(len(n), 2))), ratio, 0.0)


def vocabulary(texts: DataFrame) -> pa.Array:
    """Words of the texts, in order."""

    def make():
        def work(batch):
            held = {w.strip(string.punctuation) for text in batch["text"].to_pylist() for w in set(text.lower().split())}
            return {"word": pa.array(held - {""}, pa.string())}

        return work

    # bounded by the bytes of the examples' texts
    found = map_batches(texts, T.StructType.fromDDL("word string"), make).distinct().toArrow()["word"].combine_chunks()
    return found.take(pc.array_sort_indices(found)) if len(found) else pa.array([], pa.string())


def document_frequencies(docs: DataFrame, words: Broadcast) -> tuple[np.ndarray, int]:
    """Documents with each of the words, and the number of all documents."""
    size = len(words.value)

    def make():
        numbers = Numbers(words.value)

        def work(batch):
            # texts with each word; the last number counts all texts
            held = np.zeros(size + 1, np.int64)
            for bags in numbers.bags(batch["text"].to_pylist()):
                held[:size] += np.bincount(bags.word, minlength=size)
            held[size] = batch.num_rows
            number = np.flatnonzero(held)
            return {"number": pa.array(number), "n": pa.array(held[number])}

        return work

    counted = map_batches(whole_texts(docs), T.StructType.fromDDL("number long, n long"), make)
    found = counted.groupBy("number").agg(F.sum("n").alias("n")).toArrow()  # a row per word at most
    out = np.zeros(size + 1)
    out[found["number"].to_numpy()] = found["n"].to_numpy()
    return out[:size], int(out[size])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> ToxicityModel:
    """Index the labelled examples over all their words, weighed over all documents.

    About ``examples`` labelled documents of each class outside the held-out fold, chosen by
    a hash of the id, make the index; fewer, if their texts have more than `EXAMPLE_BYTES`
    together. Null labels are not used; a document with both labels counts as toxic. Equal
    texts of one label are one example. Without examples of both classes every score is the
    toxic share.
    """
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(id_remainder(FOLDS) != HELD_OUT)
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [sampled(known.where(F.col("toxic") == t), examples, totals.get(t, 0)) for t in (0, 1)]
    # the sample has a fixed bound, so its ids are sent to every task
    chosen = whole_texts(docs).join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")
    once = chosen.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id"))
    chosen = stage(once.select("doc_id", "text", "toxic"), "toxicity-examples")
    size = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["bytes"] > EXAMPLE_BYTES:
        chosen = sampled(chosen, int(size["n"] * EXAMPLE_BYTES / size["bytes"]), size["n"], "doc_id", seed=18)

    words = vocabulary(chosen)
    spark = docs.sparkSession.sparkContext
    shared = spark.broadcast(words)

    def make():
        numbers = Numbers(shared.value)

        def work(batch):
            bags = list(numbers.bags(batch["text"].to_pylist()))
            sizes = np.concatenate([np.empty(0, int), *(np.bincount(x.text, minlength=x.count) for x in bags)])
            starts = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            word, times = (np.concatenate([np.empty(0, int), *(getattr(x, c) for x in bags)]) for c in ("word", "times"))
            return {
                "doc_id": batch["doc_id"],
                "toxic": batch["toxic"],
                "words": pa.ListArray.from_arrays(starts, pa.array(word, pa.int32())),
                "times": pa.ListArray.from_arrays(starts, pa.array(times, pa.int32())),
            }

        return work

    # bounded by the number of examples and the bytes of their texts
    rows = map_batches(chosen, fields(chosen, "toxic int, words array<int>, times array<int>"), make).toArrow()
    ids, toxic = rows["doc_id"].to_pylist(), rows["toxic"].to_numpy()
    n = np.bincount(toxic, minlength=2) if len(ids) else np.zeros(2, int)
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    if not n[0] or not n[1]:
        none = np.empty(0, np.int64)
        nobody = Examples(pa.array([], pa.string()), np.empty(0), [], none, none, none, none)
        return ToxicityModel(spark.broadcast(nobody), neighbours, without_words=share)
    # by id, so that places do not depend on how tasks came back
    rows = rows.take(sorted(range(len(ids)), key=lambda i: (str(ids[i]), toxic[i]))).combine_chunks()
    toxic, sizes = rows["toxic"].to_numpy(), pc.list_value_length(rows["words"]).to_numpy()
    word, times = (pc.list_flatten(rows[c]).to_numpy() for c in ("words", "times"))
    frequency, n_docs = document_frequencies(docs, shared)
    shared.unpersist()
    of_toxic = np.repeat(toxic == 1, sizes)
    with_word = [np.bincount(word[of_toxic == t], minlength=len(words)) for t in (False, True)]
    weight = (np.log((1 + n_docs) / (1 + frequency)) + 1) * (FLOOR + ties(*with_word, *n))
    times = times.astype(np.min_scalar_type(times.max(initial=0)))
    held = Examples(words, weight, rows["doc_id"].to_pylist(), toxic, sizes, word, times)
    model = ToxicityModel(spark.broadcast(held), neighbours, without_words=share)
    model.curve = _curve(chosen, model, [totals[t] / n[t] for t in (0, 1)])
    return model


def _curve(chosen: DataFrame, model: ToxicityModel, weight: list[float]) -> tuple[float, float]:
    """The curve of the examples' votes, each without itself; the votes come from tasks."""
    shared, k = model.shared, model.neighbours

    def make():
        examples = shared.value
        numbers = Numbers(examples.numbers)

        def work(batch):
            votes = []
            near = examples.answers(batch["text"].to_pylist(), numbers, k + 1)
            for own, (rows, cosines) in zip(batch["doc_id"].to_pylist(), near):
                itself = [i for i, r in enumerate(rows) if examples.index.ids[r] == own][:1]
                rows, cosines = np.delete(rows, itself)[:k], np.delete(cosines, itself)[:k]
                votes.append(examples.vote(rows, cosines) if len(rows) else None)
            return {"vote": pa.array(votes, pa.float64()), "toxic": batch["toxic"]}

        return work

    # one row per example; sums over votes in one order, whatever order tasks came back in
    made = map_batches(chosen, T.StructType.fromDDL("vote double, toxic int"), make).where("vote IS NOT NULL").toArrow()
    vote, toxic = made["vote"].to_numpy(), made["toxic"].to_numpy().astype(float)
    sort = np.lexsort((vote, toxic))
    return fit_curve(vote[sort], toxic[sort], np.where(toxic[sort] == 1, weight[1], weight[0]))


def score(docs: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The ``carry`` columns, score (0 to 1), predicted (1 from ``threshold`` on) and evidence.

    Only the text is read for the score. Null and empty texts, and texts without any word of
    an example, get the labelled rows' toxic share and no evidence. Every row is scored by
    itself, so repeated rows get equal scores and an empty table gives an empty one. A
    column of ``carry`` named like a result is left out.
    """
    id_type = docs.schema["doc_id"].dataType
    shared, k, (steep, level), without = model.shared, model.neighbours, model.curve, model.without_words

    def make():
        kind = pa.list_(pa.struct([("doc_id", to_arrow_type(id_type)), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        examples = shared.value
        numbers = Numbers(examples.numbers)

        def work(texts):
            near = list(examples.answers(texts, numbers, k))
            scores = np.array([_sigmoid(steep * examples.vote(*x) + level) if len(x[0]) else without for x in near], float)
            return [scores, (scores >= threshold).astype(np.int32), pa.array([examples.evidence(*x) for x in near], kind)]

        return work

    evidence = f"array<struct<doc_id:{id_type.simpleString()}, cosine:double, toxic:int>>"
    return with_text_columns(docs, f"score double, predicted int, evidence {evidence}", make, carry)
