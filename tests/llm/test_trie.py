import hashlib
import random
import zlib

import pytest
from wakeline.llm import trie as t

SCHEMA = "conv_id long, turn int, role string, text string, depth int, id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(rows):
    convs = ordered(rows)
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        hub = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(hub, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, ids in members.items():
        leaves = saved = 0
        waiting = [node]
        while waiting:
            x = waiting.pop()
            waiting += children.get(x, [])
            leaves += x not in children
            saved += (len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        start = c * 3 - 20
        for k in range(rng.randint(0, most)):
            rows.append((start, rng.choice([k, k, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "ünï"])))
    return rows


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_shared_openings_against_plain_trie(spark):
    rows = random_rows(1, 90, 11)
    rows += [(None, 1, "user", "nobody's"), (None, 1, "user", "nobody's"), (500, 1, "user", "a"), (500, 1, "user", "a")]
    rows += [(900 + k, j, "user", "hot " * j) for k in range(40) for j in range(6)]
    same(t.shared_openings(table(spark, rows)), plain(rebuilt(rows)))


@pytest.mark.parametrize("size", [1, 3])
def test_blocks_of_any_size_give_the_same_trie(spark, size):
    convs = {c: [("u", "ab"[(c >> j) & 1]) for j in range(c % 10)] for c in range(64)} | {100: [], 101: []}
    turns = [(c, j, r, x) for c, v in convs.items() for j, (r, x) in enumerate(v)]
    turns = spark.createDataFrame(turns, "conv_id long, pos long, role string, text string")
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    same(t.trie(turns, ids, size), plain(convs))


def test_long_conversation_goes_over_spans(spark):
    convs = {1: [("u", str(j)) for j in range(9_000)], 2: [("u", str(j)) for j in range(4_500)] + [("u", "other")]}
    turns = [(c, j, r, x) for c, v in convs.items() for j, (r, x) in enumerate(v)]
    turns = spark.createDataFrame(turns, "conv_id long, pos long, role string, text string").repartition(7)
    got = {(r.conv_id, r.depth): r for r in t.trie(turns, turns.select("conv_id").distinct()).collect()}
    assert len(got) == 9_002
    shared = [sum(len(str(j)) for j in range(d - 1, 4_500)) for d in (1, 4_500)]
    assert [got[1, d].saved_tokens for d in (1, 4_500, 4_501)] == [*shared, 0]
    assert got[1, 0].n_leaves == got[1, 4_500].n_leaves == got[1, 4_500].n_children == 2 and got[2, 4_501].parent_conv_id == 1


def test_role_and_text_do_not_run_together(spark):
    turns = spark.createDataFrame([(1, 0, "ab", "c"), (2, 0, "a", "bc")], "conv_id long, pos long, role string, text string")
    assert t.trie(turns, turns.select("conv_id")).where("depth = 1").count() == 2


def test_lists_of_many_pieces(spark):
    rows = [("x", i) for i in range(1_000)] + [("y", -5), ("y", 3)]
    ends = spark.createDataFrame(rows, "id string, conv_id long").repartition(5)
    got = {r.id: r.ends_sha256 for r in t.hash_lists(ends, piece=7).collect()}
    want = {"x": ",".join(map(str, range(1_000))), "y": "-5,3"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_empty_table(spark):
    assert t.shared_openings(table(spark, [])).count() == 0
    same(t.shared_openings(table(spark, [(7, 1, None, None)])), plain(rebuilt([(7, 1, None, None)])))
