import random

import numpy as np
import pytest
from messy import ROWS, empty, messy, prose
from wakeline.llm import graph, neardup


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def plain(rows, size=3, percent=85):
    """Least reachable id of each document by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}
    moved = True
    while moved:
        moved = False
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and root[j] < root[i] and (i == j or 100 * len(a & b) >= percent * len(a | b)):
                    root[i], moved = root[j], True
    return {i: (len(s), root[i]) for i, s in sets}


def mutate(text, rng, share):
    words = text.split()
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = f"w{rng.randint(0, 10**6)}"
    return " ".join(words)


def family(n, seed, words=120, share=(0.0, 0.01, 0.03, 0.06)):
    rng = random.Random(seed)
    base = prose(words, seed)
    return [mutate(base, rng, rng.choice(share)) for _ in range(n)]


def near(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, component_id string, id int")
    return neardup.near_duplicates(docs, **more).collect()


@pytest.mark.parametrize("limits", [{}, {"chunk": 16, "leaders": 2}, {"chunk": 7, "leaders": 1}])
def test_components_against_all_pairs(spark, limits):
    texts = [t for s in range(6) for t in family(12, s)] + family(60, 99, 60, (0.0, 0.02, 0.04)) + [prose(50, 500 + i) for i in range(30)] + ["same text"] * 20 + ["Same  TEXT", "one", "", " "]
    random.Random(7).shuffle(texts)
    rows = list(enumerate(texts))
    want = plain(rows)
    got = near(spark, rows, **limits)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_odd_rows_and_tables(spark):
    got = near(spark, ROWS)
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[6].component_id == 1 and not by[6].kept and by[None].component_id is None and by[None].kept
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].kept and by[4].kept
    assert near(spark, []) == []
    assert neardup.keep_one(messy(spark)).columns == messy(spark).columns
    kept = neardup.keep_one(messy(spark)).collect()
    assert len(kept) == len(ROWS) - 1 and any(r.doc_id is None for r in kept)
    assert neardup.keep_one(empty(spark)).count() == 0


def test_texts_of_one_document_join_their_groups(spark):
    a, b = prose(60, 1), prose(60, 2)
    got = near(spark, [(5, a), (9, a), (9, b), (3, b), (7, prose(60, 3))])
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (9, 3), (3, 3), (7, 7)}


def test_other_shingles_and_similarity(spark):
    rows = list(enumerate(t for s in range(5) for t in family(8, 40 + s, 80, (0.0, 0.01, 0.04))))
    got = near(spark, rows, size=5, percent=80, values=3)
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in plain(rows, 5, 80).items()}


def test_tensored_keys_find_pairs_at_the_threshold():
    rng, multipliers, found = np.random.default_rng(4), neardup.band_multipliers(), 0
    for _ in range(400):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        other = base.copy()
        other[:16] = rng.integers(0, 2**63, 16, dtype=np.uint64)  # 184 of 216 shared: 0.852
        a, b = (neardup.band_hashes(np.unique(x), multipliers) for x in (base, other))
        same = a == b
        found += bool(same[: neardup.BANDS].any() and same[neardup.BANDS :].any())
    assert found >= 398


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(1, 1), (None, 4)]
    parent = list(range(1100))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in range(1100) if find(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
