import zlib

import numpy as np
import pyarrow as pa
from messy import ROWS, corpus, empty, messy
from wakeline.llm import toxicity


def random_vectors(rng, count, words, most):
    """Sorted postings (vector, word, value) of unit vectors; word 0 is the commonest."""
    share = 1 / np.arange(1, words + 1)
    held = [np.sort(rng.choice(words, rng.integers(1, most), replace=False, p=share / share.sum())) for _ in range(count)]
    value = [rng.integers(1, 4, len(x)).astype(float) for x in held]
    value = [x / np.sqrt(x @ x) for x in value]
    return np.repeat(np.arange(count), [len(x) for x in held]), np.concatenate(held), np.concatenate(value)


def dense(vector, word, value, shape):
    out = np.zeros(shape)
    out[vector, word] = value
    return out


def test_blocks_find_the_exact_nearest():
    rng = np.random.default_rng(5)
    for examples, words, k in ((700, 60, 15), (20, 30, 15), (300, 25, 200)):
        made = random_vectors(rng, examples, words, 9)
        index = toxicity.BlockMaxIndex.build(list(range(examples)), rng.integers(0, 2, examples), *made, words)
        assert (index.column >= 0).any() and (index.column < 0).any()
        of = dense(*made, (examples, words))[index.ids]
        asked = random_vectors(rng, 50, words, 9)
        cosine = dense(*asked, (50, words)) @ of.T
        who, rows, scores = index.nearest(*asked, 50, k)
        for q in range(50):
            order = np.lexsort((np.arange(examples), -np.round(cosine[q], 12)))[:k]
            assert rows[who == q].tolist() == [i for i in order if cosine[q, i] > 1e-12]
            assert np.allclose(scores[who == q], cosine[q, rows[who == q]])


def test_blocks_that_cannot_reach_are_left_closed():
    rng = np.random.default_rng(6)
    vectors = [(i, w, v) for i in range(1280) for w, v in ((i % 10, 0.8), (10 + rng.integers(0, 20), 0.6))]
    example, word, value = (np.array(x) for x in zip(*vectors))
    index = toxicity.BlockMaxIndex.build(list(range(1280)), np.zeros(1280), example, word, value, 30)
    who, rows, scores = index.nearest(example[:40], word[:40], value[:40], 20, 3)
    assert len(who) == 60 and (scores > 0.99).all()
    assert index.opened[0] < 0.5 * index.opened[1]


def test_lists_of_common_words_are_read_in_single_precision_and_ranked_in_double():
    # the weights of the last word differ by less than single precision holds
    n, step = 400, 1e-10
    last = 0.6 + step * np.random.default_rng(8).permutation(n)
    value = np.column_stack([np.sqrt(1 - last**2), last]).ravel()
    made = (np.repeat(np.arange(n), 2), np.tile([0, 1], n), value)
    index = toxicity.BlockMaxIndex.build(list(range(n)), np.zeros(n), *made, 2)
    assert index.dense.dtype == np.float32 and index.column.tolist() == [0, 1]
    who, rows, scores = index.nearest(np.zeros(1, int), np.ones(1, int), np.ones(1), 1, 20)
    assert [index.ids[r] for r in rows] == np.argsort(-last)[:20].tolist()
    assert (np.abs(scores - np.sort(last)[::-1][:20]) < 1e-14).all()


def test_every_spelling_of_a_piece_is_looked_up_once(monkeypatch):
    known = pa.array(["a", "b", "\u03c3"])
    asked = []
    look_up = toxicity.pc.index_in
    monkeypatch.setattr(toxicity.pc, "index_in", lambda x, **of: asked.append(len(x)) or look_up(x, **of))
    texts = ["A (a) b", "", "b\u2003\u03a3 c\x1ca", "...", *["a b"] * 50]
    bags = list(toxicity.Numbers(known).bags(texts))
    assert asked == [6] and [x.count for x in bags] == [len(texts)]
    got = list(zip(bags[0].text.tolist(), bags[0].word.tolist(), bags[0].times.tolist()))
    assert got[:5] == [(0, 0, 2), (0, 1, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1)] and len(got) == 105
    monkeypatch.setattr(toxicity, "CHARACTERS", 5)
    pieces = list(toxicity.Numbers(known).bags(texts))
    assert len(pieces) > 2 and sum(x.count for x in pieces) == len(texts)
    assert np.concatenate([x.word for x in pieces]).tolist() == bags[0].word.tolist()


def test_ties_do_not_depend_on_shares_of_the_sample():
    clean, toxic = np.zeros(1000), np.zeros(1000)
    toxic[:4], clean[:4] = (1, 9, 9, 900), (0, 0, 90, 9000)
    made = toxicity.ties(clean, toxic, 10_000, 1_000)
    assert made[0] == 0 and made[1] > 2 and made[2] == made[3] == 0


def test_every_example_finds_itself(spark):
    docs, labels = corpus(spark, 400)
    model = toxicity.fit(docs, labels)
    of = dict(zip(model.examples.index.ids, model.examples.index.toxic))
    # also those of clean words only: no example is left out of the index
    usable = {r.doc_id for r in labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(of) == len({(texts[i], i % 8 == 3) for i in usable}) and {0, 1} == set(of.values())
    for r in toxicity.score(docs.where(docs.doc_id.isin(list(of))), model).collect():
        assert abs(r.evidence[0].cosine - 1) < 1e-9 and r.evidence[0].toxic == of[r.doc_id]


def test_examples_are_bounded_by_their_bytes(spark, monkeypatch):
    docs, labels = corpus(spark, 400)
    monkeypatch.setattr(toxicity, "EXAMPLE_BYTES", sum(len(r.text or "") for r in docs.collect()) // 4)
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.examples.index.ids) < 250
    assert toxicity.score(docs, model).count() == docs.count()


def test_neighbours_of_long_and_short_queries_together():
    words = pa.array([f"w{i}" for i in range(500)])
    rng = np.random.default_rng(7)
    made = random_vectors(rng, 200, 500, 40)
    example, word, value = made
    sizes = np.bincount(example, minlength=200)
    examples = toxicity.Examples(words, np.ones(500), list(range(200)), np.zeros(200), sizes, word, np.ones(len(word)))
    texts = ["", "W3, (w3)", "unknown", " ".join(f"w{i}" for i in rng.integers(0, 500, 50_000)), *["w1 w2"] * 200]
    numbers = toxicity.Numbers(examples.numbers)
    near = list(examples.answers(texts, numbers, 15))
    assert len(near) == len(texts) and len(near[0][0]) == len(near[2][0]) == 0 and len(near[3][0]) == 15
    alone = list(examples.answers(["w3 w3"], numbers, 15))[0]
    assert near[1][0].tolist() == alone[0].tolist() and all(x[0].tolist() == near[4][0].tolist() for x in near[4:])


def test_labels_of_held_out_rows(spark):
    docs, labels = corpus(spark, 600)
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(rows[i].predicted == (i % 8 == 3) for i in held) >= 0.97 * len(held)
    near = next(rows[i] for i in held if i % 8 == 3).evidence
    assert near and all(zlib.crc32(str(x.doc_id).encode()) % 5 != 0 for x in near) and near[0].toxic == 1
    odd = toxicity.score(messy(spark), model, ("doc_id", "score", "kept")).collect()
    assert len(odd) == len(ROWS) and odd[0].score == odd[5].score and odd[1].evidence == []
    assert all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(empty(spark), model).count() == 0


def test_one_class_or_none(spark):
    docs, labels = corpus(spark, 40)
    none = toxicity.fit(docs, labels.where("1 = 0"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    clean = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, clean).collect()} == {0}
    assert toxicity.fit(empty(spark), labels).examples.ids == []
