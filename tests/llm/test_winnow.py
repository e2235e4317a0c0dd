import hashlib
import random

import numpy as np
from messy import LONG, ROWS, empty, messy
from wakeline.llm import winnow as w


def plain(text, k, width):
    if not text:
        return []
    k = min(k, len(text))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    hashes = [int(w.gram_hashes(points[i : i + k], k)[0]) for i in range(len(text) - k + 1)]
    width, out = min(width, len(hashes)), []
    for j in range(len(hashes) - width + 1):
        least = min(hashes[j : j + width])
        at = max(i for i in range(j, j + width) if hashes[i] == least)
        if not out or out[-1] != (least, at):
            out.append((least, at))
    return out


def test_minima_and_rightmost_ties():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abあ ") for _ in range(rng.randint(0, 60)))
        k, width = rng.randint(1, 7), rng.randint(1, 9)
        hashes, at = w.winnow(text, k, width)
        assert list(zip(hashes.tolist(), at.tolist())) == plain(text, k, width)


def test_shared_run_is_found():
    rng, k, width = random.Random(2), w.GRAM, w.WINDOW
    for _ in range(50):
        letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
        shared = letters(k + width - 1)
        a, b = (w.winnow(letters(200) + shared + letters(150))[0] for _ in range(2))
        assert set(a.tolist()) & set(b.tolist())


def compare(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    return [tuple(r) for r in w.compare_neighbours(docs, **more).collect()]


def expected(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        own, new, other = (w.winnow(x)[0] for x in (text, changed, following))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), w.hex_of(own), w.hex_of(new), w.likeness(own, new), w.likeness(own, other)))
    return out


def test_neighbours_across_ranges(spark):
    rng = random.Random(3)
    rows = [(i * 3 - 40, LONG[i * 50 : i * 50 + rng.randint(0, 900)]) for i in range(150)]
    rng.shuffle(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    for size in (7, 40, 1_000):
        assert sorted(compare(spark, rows, docs_per_range=size), key=key) == sorted(expected(rows), key=key)


def test_odd_rows_and_tables(spark):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    for size in (2, 100):
        assert sorted(compare(spark, ROWS, docs_per_range=size), key=key) == sorted(expected(ROWS), key=key)
    assert compare(spark, []) == []
    assert compare(spark, [(1, "abcdefgh")]) == expected([(1, "abcdefgh")])
    got = w.fingerprint_documents(messy(spark)).collect()
    assert got[0].hashes == got[5].hashes and got[0].positions and got[1].hashes == []
    assert w.fingerprint_documents(empty(spark)).count() == 0


def test_positions_and_few_ranges(spark, monkeypatch):
    monkeypatch.setattr(w, "MOST_RANGES", 3)
    rows = [(i, LONG[i * 30 : i * 30 + 400]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(w.range_starts(docs, 4)) <= 3
    got = {r.doc_id: r for r in w.compare_neighbours(docs, docs_per_range=4, with_positions=True).collect()}
    for i, text in rows:
        hashes, at = w.winnow(text)
        assert got[i].fingerprint == w.hex_of(hashes) and got[i].positions == at.tolist()
