import re
import zlib
from collections import Counter

import numpy as np
from messy import LONG, ROWS, corpus, empty, messy, prose
from wakeline.llm import anomaly, quality
from wakeline.llm.textstats import COUNTS, count_text


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_counts_against_plain_rules():
    texts = [t or "" for _, t in ROWS] + ["a b c a b c", "x\nx\n \n x\nx ", "# a\xa0b   c\x1cd|", LONG + LONG]
    for text in texts:
        got = dict(zip(COUNTS, count_text(text)))
        assert {k: got[k] for k in plain_counts(text)} == plain_counts(text)


def test_forest_judges_every_row(spark):
    docs, labels = corpus(spark)
    forest = anomaly.fit(docs, labels, trees=40, tree_rows=64)
    rows = {r.doc_id: r for r in anomaly.judge(docs, forest, ("doc_id", "source")).collect()}
    kept = {i: rows[i].kept for i in range(240)}
    assert all(kept[i] == (i % 6 != 5) for i in kept)
    assert rows[241].base_failed and not rows[241].kept
    odd = anomaly.judge(messy(spark), forest, ("doc_id", "kept")).collect()
    assert len(odd) == len(ROWS) and odd[0].anomaly == odd[5].anomaly
    for row, (_, text) in zip(odd, ROWS):
        plain = plain_counts(text or "")
        assert row.base_failed == (plain["n_words"] < 50 or 2 * plain["n_repeat_words"] > plain["n_words"])
    assert anomaly.judge(empty(spark), forest).count() == 0
    none = anomaly.fit(empty(spark), labels.where("1 = 0"))
    assert anomaly.judge(docs, none).where("kept = base_failed").count() == 0


def test_path_lengths_part_the_outlier():
    x = np.concatenate([np.random.default_rng(1).normal(size=(500, 3)), [[9, 9, 9]]])
    scores = anomaly.grow(x, trees=60).scores(x)
    assert scores.argmax() == 500 and scores[500] > 0.6 > np.median(scores)
    flat = anomaly.grow(np.ones((50, 3)))
    assert np.allclose(flat.scores(np.ones((2, 3))), flat.scores(np.zeros((2, 3))))


def test_threshold_parts_labelled_rows():
    assert 0.5 < anomaly.calibrate(np.array([0.3, 0.5]), np.array([0.6, 0.9])) < 0.6
    assert anomaly.calibrate(np.array([0.3]), np.array([])) == 1.0 and anomaly.calibrate(np.array([]), np.array([0.3])) == 0.0


def test_positive_unlabelled_learning(spark):
    docs, labels = corpus(spark, 600)
    model = quality.fit(docs, labels)
    assert 0.7 < model.prior < 0.95
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(rows[i].predicted == (i % 6 != 5) for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(docs, model).count() == sum(r.predicted for r in rows.values())
    odd = quality.score(messy(spark), model, ("doc_id", "score", "kept")).collect()
    assert len(odd) == len(ROWS) and odd[0].score == odd[5].score and odd[0].kept is True
    assert quality.score(empty(spark), model).count() == 0


def test_smaller_samples_keep_the_meaning_of_the_score(spark):
    docs, labels = corpus(spark, 2_400)
    # one in five clean documents is labelled bad, so clean ones score about 0.8
    noisy = labels.selectExpr("doc_id", "CASE WHEN floor(doc_id / 6) % 5 = 0 THEN 0 ELSE quality END AS quality")
    whole, part = (
        quality.score(docs, quality.fit(docs, noisy, fit_rows=n)).where("doc_id < 2400 AND doc_id % 6 < 5").collect()
        for n in (20_000, 400)
    )
    assert np.mean([r.predicted for r in whole]) >= 0.9 and np.mean([r.predicted for r in part]) >= 0.6
    assert abs(np.mean([r.score for r in whole]) - 0.8) < 0.02 and abs(np.mean([r.score for r in part]) - 0.8) < 0.06


def test_curve_weighs_rows_and_does_not_overshoot():
    rng = np.random.default_rng(4)
    margin = np.concatenate([rng.normal(9, 1, 4_000), rng.normal(8, 1, 1_000)])
    good = np.arange(5_000) < 4_000
    slope, shift = quality._platt(margin, good, np.ones(5_000))
    assert abs(quality._sigmoid(slope * margin + shift).mean() - 0.8) < 0.01
    some = np.concatenate([np.arange(0, 4_000, 4), np.arange(4_000, 5_000)])
    part = quality._platt(margin[some], good[some], np.where(good[some], 4.0, 1.0))
    assert abs(part[0] * 8.5 + part[1] - slope * 8.5 - shift) < 0.15


def test_held_out_labels_do_not_move_the_model(spark):
    docs, labels = corpus(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    assert np.array_equal(quality.fit(docs, labels).weights, quality.fit(docs, turned).weights)


def test_without_labels_or_documents(spark):
    docs, labels = corpus(spark, 20)
    for d, x in ((docs, labels.where("1 = 0")), (empty(spark), labels)):
        assert {r.score for r in quality.score(docs, quality.fit(d, x)).collect()} == {0.5}


def test_prior_from_two_samples():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(2, 1, 20_000), rng.normal(-2, 1, 20_000)
    assert abs(quality.estimate_prior(good[:10_000], np.concatenate([good[10_000:17_000], bad[:3_000]])) - 0.7) < 0.05
    assert prose(3, 1)


def test_risk_is_as_low_as_with_labels_on_both_sides():
    """Without a bad label, nearly the risk of the best line that a plain search finds with them."""
    rng = np.random.default_rng(3)
    design = lambda x: np.column_stack([np.ones_like(x), x])
    for prior in (0.3, 0.6):
        good, bad = rng.normal(1.5, 1, 6_000), rng.normal(-1.0, 1, 6_000)
        mixed = np.where(rng.random(6_000) < prior, rng.normal(1.5, 1, 6_000), rng.normal(-1.0, 1, 6_000))

        def risk(w):
            loss = lambda x, y: np.log1p(np.exp(-y * (w[0] + w[1] * x))).mean()  # noqa: E731, B023
            return prior * loss(good, 1) + (1 - prior) * loss(bad, -1)

        grid = [(a, b) for a in np.arange(-3, 3.1, 0.25) for b in np.arange(-1, 4.1, 0.25)]
        found = quality.minimise_risk(design(good), design(mixed), prior, rounds=60)
        assert risk(found) <= min(map(risk, grid)) + 0.02
