import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from messy import ROWS, corpus, empty, messy
from wakeline.llm import brown
from wakeline.llm.common import id_remainder

SMALL = {"head": 60, "word_units": 20, "endings": 10, "classes": 8}


def objective(pairs, label, classes):
    count = np.zeros((classes, classes))
    np.add.at(count, (label[:, None], label[None, :]), pairs)
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return f(count) - f(count.sum(0)) - f(count.sum(1))


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(2)
    truth = np.array([0] + [1 + i % 3 for i in range(30)])
    chain = np.array([[0, 1, 0, 0], [0.1, 0, 0.9, 0], [0.1, 0, 0, 0.9], [0.1, 0.9, 0, 0]])
    pairs = rng.poisson(200 * chain[truth][:, truth])
    label = brown.exchange(pairs, 4)
    assert label[0] == 0 and all(len({label[i] for i in range(31) if truth[i] == t}) == 1 for t in range(4))
    random = rng.integers(1, 4, 31)
    random[0] = 0
    assert objective(pairs, label, 4) > objective(pairs, random, 4)


def plain_base(rows, learned):
    count = Counter()
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    for i, words in texts:
        if learned(i):
            count.update(words)
    n, v = sum(count.values()), len(count)
    base = [(i, len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in texts]
    return n, base


def test_base_against_plain_counts(spark):
    docs, _ = corpus(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    n, want = plain_base(rows, learned)
    got = brown.score_corpus(docs, **SMALL).collect()
    shape = lambda r: (r[0] is not None, r[0] or 0, r[1], round(r[3], 6))
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=shape)
    assert [shape(r) + (r[2],) for r in have] == [shape(r) + (r[2],) for r in sorted(want, key=shape)]
    assert {r.train_tokens for r in got} == {n}
    assert all(r.held_out == (not learned(r.doc_id)) for r in got)


def test_words_of_a_state_sum_to_one(spark):
    """All known words and one unknown of each class share each transition's probability."""
    docs, _ = corpus(spark, 60)
    learn = id_remainder(brown.FOLDS) != brown.HELD_OUT
    model = brown.fit(docs.where(learn), **SMALL)
    assert np.allclose((10.0**model.transitions).sum(1), 1)
    vocabulary = sorted({w for r in docs.where(learn).collect() for w in brown.tokens_of(r.text)})
    probes = [(i, w.decode()) for i, w in enumerate(vocabulary) if w.decode().isascii() and b"\x00" not in w and b"\x1c" not in w]
    # one-word texts are scored by a model that learned none of them anew
    frame = spark.createDataFrame(probes, "doc_id long, text string")
    both = docs.select("doc_id", "text").where("doc_id IS NOT NULL").selectExpr("doc_id + 1000000 AS doc_id", "text", "true AS old").unionByName(frame.selectExpr("doc_id", "text", "false AS old"))
    learn_old = (id_remainder(brown.FOLDS) != brown.HELD_OUT) & both["old"]
    model = brown.fit(both.where(learn_old), **SMALL)
    rows = brown.score(both, model, learn_old).where("doc_id < 1000000").collect()
    label = {r.doc_id: int(model.label[model.units.of([dict(probes)[r.doc_id].encode()])[1]]) for r in rows}
    for k in set(label.values()):
        step = model.transitions[0, k] + model.transitions[k, 0]
        mass = sum(10.0 ** (r.score - step) for r in rows if label[r.doc_id] == k and r.n_known == 2)
        assert mass < 1.01


def test_classes_help_on_held_out_texts(spark):
    rng = np.random.default_rng(6)
    words = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    texts = [(i, " ".join(words[k % 3][rng.integers(0, 40)] for k in range(rng.integers(20, 60)))) for i in range(300)]
    got = brown.score_corpus(spark.createDataFrame(texts, "doc_id long, text string"), head=200, word_units=130, endings=10, classes=5).where("held_out").collect()
    assert len(got) > 30 and all(r.score > r.base_score for r in got)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_odd_rows_and_tables(spark):
    got = brown.score_corpus(messy(spark), **SMALL).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[2].score == by[4].score
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and by[None].held_out is False
    assert brown.score_corpus(empty(spark), **SMALL).count() == 0
    nothing = brown.score(messy(spark), brown.fit(empty(spark), **SMALL), F.lit(False)).collect()
    assert len(nothing) == len(ROWS) and {r.train_tokens for r in nothing} == {0}
    assert all(abs(r.base_score) < 1e-9 for r in nothing)


def test_score_against_a_plain_class_model(spark):
    """Given the classes, every probability from plain counts over the training texts."""
    docs, _ = corpus(spark, 120)
    learn = id_remainder(brown.FOLDS) != brown.HELD_OUT
    model = brown.fit(docs.where(learn), **SMALL)
    learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    classes = lambda words: model.label[model.units.of(words)].tolist()
    count, step, into = Counter(), Counter(), Counter()
    for i, words in texts:
        if learned(i):
            count.update([*words, None])
            at = classes(words)
            step.update(zip(at, at[1:]))
            into.update(at[1:])
    types = Counter(0 if w is None else classes([w])[1] for w in count)
    n, k = sum(into.values()), model.classes
    share = lambda b: (into[b] + 0.5) / (n + 0.5 * k)
    out = Counter()
    for (a, _), m in step.items():
        out[a] += m
    got = {r.doc_id: r for r in brown.score(docs, model, learn).collect()}
    for i, words in texts:
        at, want = classes(words), 0.0
        for a, b, w in zip(at, at[1:], [*words, None]):
            want += math.log10((step[a, b] + 5 * share(b)) / (out[a] + 5))
            want += math.log10((count[w] + 0.5) / (into[b] + 0.5 * (types[b] + 1)))
        assert abs(got[i].score - want) < 1e-6 * max(1, abs(want))


def test_rounds_over_all_units_find_planted_classes(spark):
    """Nothing but the rounds: one word starts on the matrix, all others with their ending's class."""
    rng = np.random.default_rng(9)
    words = [[f"{c}{i}x{i % 4}zz" for i in range(30)] for c in "abc"]
    texts = [(i, " ".join(words[k % 3][rng.integers(0, 30)] for k in range(rng.integers(60, 120)))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    more = {"endings": 1, "classes": 5}
    start = brown.fit(docs, start_words=1, rounds=0, **more)
    model = brown.fit(docs, start_words=1, rounds=8, **more)
    whole = brown.fit(docs, start_words=1_000, **more)
    bigrams = brown.count_bigrams(docs, model.units)
    pairs = brown._matrix(bigrams, model.units.n)
    found = [objective(pairs, m.label, 5) for m in (start, model, whole)]
    assert found[1] > found[0] + 0.8 * (found[2] - found[0]) and model.label[0] == 0 and (model.label[1:] > 0).all()


def test_words_are_counted_exactly_whatever_the_partitions(spark):
    docs, _ = corpus(spark, 150)
    want = Counter(w for r in docs.collect() for w in (r.text or "").encode().lower().split())
    for parts in (1, 9):
        got = brown.count_words(docs.repartition(parts))
        assert {r.word.encode(): r.n for r in got.collect()} == want


def test_common_words_are_all_above_a_count(spark):
    rows = [(f"w{i}", 1 + i * i % 97) for i in range(300)]
    words = spark.createDataFrame(rows, "word string, n long")
    for most in (0, 1, 50, 299, 300, 1_000):
        got = {r.word: r.n for r in brown.common_words(words, most).collect()}
        assert len(got) <= most and got == {w: n for w, n in rows if got and n >= min(got.values())}
    assert len(got) == 300 and brown.common_words(words.limit(0), 5).count() == 0


def test_no_common_word_and_no_ending_is_left_out(spark):
    """Words as common as these all fall into one step of the histogram, which the head has no place for."""
    rows = [(f"w{i}", 1_000 + i % 3) for i in range(40)] + [(f"{a}{b}{c}", 1) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    words = spark.createDataFrame(rows, "word string, n long")
    units, heads, total = brown.choose_units(words, 30, None, brown.UNIT_SHARE)
    assert set(units.words) == {f"w{i}".encode() for i in range(40)} and total == sum(n for _, n in rows) and len(heads) <= 30
    assert set(units.endings) == {w[-3:].encode() for w, _ in rows} and len(units.endings) > 512
    text = [(i, " ".join([w, f"y{w}", f"z{w}"] * 2)) for i, (w, _) in enumerate(rows[40:])]
    model = brown.fit(spark.createDataFrame(text, "doc_id long, text string"), classes=6, rounds=2)
    assert len(model.label) == model.units.n and len({model.units.of([w.encode()])[1] for w, _ in rows[40:]}) == 512
    assert model.label[0] == 0 and (model.label[1:] > 0).all()


def test_gain_of_few_neighbours_against_all_cells():
    rng = np.random.default_rng(4)
    count = rng.poisson(20, (5, 5)).astype(float)
    left, right, alone = np.array([0, 3.0, 0, 0, 2]), np.array([1, 0, 0, 4.0, 2]), 2.0
    f = lambda x: x * np.log(x)
    out, into, made = count.sum(1), count.sum(0), []
    for c in range(1, 5):
        cells = sum(f(count[a, c] + left[a]) - f(count[a, c]) + f(count[c, a] + right[a]) - f(count[c, a]) for a in range(5) if a != c)
        cells += f(count[c, c] + left[c] + right[c] + alone) - f(count[c, c])
        made.append(cells - f(out[c] + right.sum() + alone) + f(out[c]) - f(into[c] + left.sum() + alone) + f(into[c]))
    assert np.allclose(brown._gain(count, left, right, alone)[1:], made)
