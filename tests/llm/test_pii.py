import re

import numpy as np
from messy import LONG, ROWS, empty, messy, prose
from wakeline.llm import pii

TEXTS = [
    "mail a.b@c.de, x@y and q@w@e.fr; @a.b %@-.- a@b..c a@b.c.d.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9 01.002.0003.4 1..2.3.4 9.9.9 1.2.3.4.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 0 00 000-0000 0000 000",
    "+1 (668) 555-1911 ge. +49 30 1234567 +1 ++12345678901 +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6 +123 ) +44 20 7946 0958",
    "é漢😀 a@b.cd 😀 +1 668 555 1911 é 192.168.0.1",
]


def plain(text):
    """The contract's patterns, as they are written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_strict_spans_against_plain_patterns():
    rng = np.random.default_rng(8)
    signs = list("0123456789999.. --+()@@ab_%é\n")
    made = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(4_000)]
    for text in [*TEXTS, *made, *((t or "") for _, t in ROWS)]:
        assert pii.strict_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1" + " " * 200_000, "1 " * 150_000, "a@" * 100_000):
        pii.strict_spans(text)
        pii.candidates(text)


def corpus(spark, n=300):
    rows = []
    for i in range(n):
        text = prose(40, i)
        text += (" call +1 (555) 010-%04d now" % i, " from 10.0.%d.7 again" % (i % 250), " version 1.2.%d.x or 4.0" % i, " password=%016xab %s" % (i * 7919**3, "end"), " token %d-%d" % (i, i * 37))[i % 5]
        rows.append((i, text, len(text), "s"))
    return spark.createDataFrame([*rows, *((i, t, None, "s") for i, t in ROWS)], "doc_id long, text string, n_chars long, spans string")


def test_boosted_spans_stand_beside_the_strict_ones(spark):
    docs = corpus(spark)
    model = pii.fit(docs)
    assert model.trees is not None and "secret" in model.thresholds
    for row in pii.detect(docs, model, ("doc_id", "text", "spans")).collect():
        base = [(s.kind, s.start, s.end) for s in row.spans if s.base]
        assert base == plain(row.text or "")
        more = [s for s in row.spans if not s.base]
        if row.doc_id is not None and row.doc_id % 5 == 3 and row.doc_id > 10:
            assert [s.kind for s in more] == ["secret"] and row.text[more[0].start : more[0].end].startswith("password=")
        order = [(pii.KINDS.index(s.kind), s.start) for s in row.spans]
        assert order == sorted(order)


def test_rare_kinds_and_long_values_are_found(spark):
    long = "token=" + "aBcDeFgHiJ" * 40
    rare = [(5_000, "his number is 123-45-6789 indeed", None, "s"), (5_001, f"so {long} it is", None, "s")]
    docs = corpus(spark).unionByName(spark.createDataFrame(rare, "doc_id long, text string, n_chars long, spans string"))
    assert ("secret", 3, 3 + len(long)) in pii.candidates(rare[1][1])
    assert ("secret", 0, 24) in pii.candidates("password=correcthorsebat")
    for model in (pii.fit(docs), pii.fit(docs, fit_candidates=300), pii.PiiModel(None, {})):
        spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.detect(docs, model).where("doc_id >= 5000").collect()}
        assert spans == {5_000: [("id", 14, 25)], 5_001: [("secret", 3, 3 + len(long))]}


def test_weights_count_in_the_precision():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4_000, 3))
    y = (rng.random(4_000) < 1 / (1 + np.exp(-4 * x[:, 0]))).astype(float)
    kind = np.zeros(4_000, int)
    heavy = pii.train(x, y, kind, 0.9, np.where(y == 1, 1.0, 10.0)).thresholds.get("email", 1.0)
    assert heavy > pii.train(x, y, kind, 0.9).thresholds["email"]


def test_redaction_takes_effect(spark):
    docs = corpus(spark)
    out = pii.redact(docs, pii.fit(docs))
    assert out.columns == docs.columns and out.count() == docs.count()
    for row in out.collect():
        assert not plain(row.text or "") and "password=" not in (row.text or "")
        assert row.n_chars is None or row.n_chars == len(row.text)
    assert {r.doc_id for r in out.where("text IS NULL").collect()} == {2}
    assert pii.redact_text("ab cd ef", [{"start": 0, "end": 5, "kind": "card"}, {"start": 3, "end": 8, "kind": "phone"}]) == "[CARD]"


def test_nothing_to_learn_from(spark):
    model = pii.fit(empty(spark))
    assert model.trees is None and pii.detect(empty(spark), model).count() == 0
    assert pii.detect(messy(spark), model).count() == len(ROWS)


def test_trees_learn_a_rule():
    x = np.random.default_rng(1).normal(size=(2_000, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    assert ((pii.boost(x, y).scores(x) > 0.5) == y).mean() > 0.97
    assert len(LONG) > 100_000


def test_all_candidates_are_learned_from(spark, monkeypatch):
    """Not a sample of 60: the counts are whole, and trees are those of all candidates, here or in tasks."""
    docs = corpus(spark)
    want = {}
    rows = [(r.doc_id, r.text or "", *c) for r in docs.collect() for c in pii.candidates(r.text or "")]
    for _, text, kind, a, b in rows:
        key = pii.KINDS.index(kind), pii.confirmed(kind, text[a:b])
        want[key] = want.get(key, 0) + 1
    counted = pii.all_figures(docs).collect()
    assert sum(r.n for r in counted) == len(rows) > 300
    assert all(sum(r.n for r in counted if (r.kind, r.y) == k) == n for k, n in want.items())

    learned = [r for r in counted if not r.rest]
    x = np.array([np.frombuffer(r.figures, "<f4") for r in learned], float)
    weights = np.array([min(1, 60 / 6 / want[r.kind, r.y]) * r.n for r in learned])
    plain_trees = pii.boost(x, np.array([r.y for r in learned], float), weights=weights)
    here = pii.fit(docs, fit_candidates=60)
    assert np.allclose(here.trees.scores(x), plain_trees.scores(x), atol=1e-6)
    assert here.thresholds["secret"] < 1 and sum(r.n for r in learned) > 4 * 60
    monkeypatch.setattr(pii, "IN_PLACE", 0)
    # trees summed in tasks, for a few rounds
    monkeypatch.setattr(pii.grow, "__defaults__", (3, *pii.grow.__defaults__[1:]))
    tasks = pii.fit(docs.repartition(5), fit_candidates=60).trees
    for name in ("feature", "cut", "leaf"):
        assert all(np.array_equal(a, b) for a, b in zip(getattr(tasks, name), getattr(here.trees, name)))
    assert len(tasks.leaf) == 3
