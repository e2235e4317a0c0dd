import hashlib
import random
import string

import pytest
from messy import ROWS, empty, messy
from pyspark.sql import functions as F
from wakeline.llm import merkle as m


def lowered():
    return F.translate("text", string.ascii_uppercase, string.ascii_lowercase)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def climb(levels, at, now):
    proof = ""
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        left, right = "".join(run[: at % 8]), "".join(run[at % 8 + 1 :])
        now, proof, at = sha(left, now, right), proof + left + right, at // 8
    return now, proof


def plain(rows):
    """rows: doc_id, source, lang, n_chars, text, text now."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), leaf(*r[:4], r[5]), r[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by_lang[x], key=lambda r: r[:3])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, (_, _, old, new, i) in enumerate(sorted(by_lang[x], key=lambda r: r[:3])):
            low, low_proof = climb(trees[x], at, new)
            folded, high_proof = climb(top, k, low)
            out.append((i, old, trees[x][-1][0], top[-1][0], sha(low_proof, high_proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows, tampered):
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, source string, lang string, n_chars int, text string, pos int, leaf string")
    low = lambda t: t if t is None else "".join(c.lower() if c in string.ascii_uppercase else c for c in t)
    hit = lambda i: i is not None and i % 3 == 0
    want = plain([(*r, low(r[4]) if hit(r[0]) and tampered else r[4]) for r in rows])
    now = F.when((F.col("doc_id") % 3 == 0) & F.lit(tampered), lowered()).otherwise(F.col("text"))
    got = m.prove_documents(docs, now).collect()
    assert sorted(map(tuple, got), key=str) == want
    return got


@pytest.mark.parametrize("sizes", [(1,), (9,), (64, 1), (65, 9, 1, 1, 1, 1, 1, 1, 1)])
def test_trees_of_all_shapes(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(i * 31 + k, "s", f"l{k}", i, f"Text {i} " + "A" * rng.randint(0, 3)) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    got = check(spark, rows, True)
    assert any(not r.verified for r in got) == any(r[0] % 3 == 0 for r in rows)


def test_untouched_rows_are_verified(spark):
    assert all(r.verified for r in check(spark, [(i, "s", "ab"[i % 2], i, "T") for i in range(20)], False))


def test_odd_rows(spark):
    rows = [(i, [None, "", "s"][n % 3], [None, "", "en", "ü", "Z"][n % 5], [None, n][n % 2], t) for n, (i, t) in enumerate(ROWS)]
    check(spark, rows + rows[:3] + [(1, None, None, None, None)] * 20, True)


def test_empty_and_clashing_columns(spark):
    docs = messy(spark).withColumn("lang", F.lit("en"))
    assert m.prove_documents(docs, lowered()).count() == len(ROWS)
    assert m.prove_documents(empty(spark).withColumn("lang", F.lit("en")), lowered()).collect() == []


def test_row_limit_of_recursion_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    check(spark, [(3, "s", "en", 1, "T")], True)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
