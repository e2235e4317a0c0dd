import hashlib
import random

import numpy as np
import pytest
from messy import ROWS, empty, messy
from pyspark.sql import functions as F
from wakeline.llm import perfect_hash as p


def digests(n, seed=0):
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}-{i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 500, 2048, 3000])
def test_bucket_is_filled_without_a_gap(n):
    bits, pilots, slots = p.fill_bucket(digests(n, n))
    assert sorted(slots.tolist()) == list(range(n)) and len(pilots) == -(-n // p.GROUP) and bits == 0


def test_other_bits_where_the_first_agree():
    same = digests(2).copy()
    same[1, 7:19] = same[0, 7:19]  # one group, equal displacement numbers
    bits, _, slots = p.fill_bucket(same)
    assert bits == 1 and sorted(slots.tolist()) == [0, 1]
    same[1, 7:27] = same[0, 7:27]
    with pytest.raises(ValueError, match="agree"):
        p.fill_bucket(same)


def texts_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return p.distinct_texts(p.digest_rows(docs))


def test_slots_are_a_bijection_and_strangers_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(p, "BUCKET", 40)
    index = p.build(texts_of(spark, [f"text {i}" for i in range(700)]))
    assert index.n_buckets == 18
    index.save(str(tmp_path / "index"))
    index = p.load(spark, str(tmp_path / "index"))
    assert sorted(r.slot for r in index.slots.collect()) == list(range(700))
    asked = texts_of(spark, [f"text {i}" for i in range(600, 900)])
    placed = p.slot_of(asked, index).collect()
    assert all(0 <= r.slot < 700 for r in placed)
    found = p.look_up(asked, index).collect()
    assert len(found) == 300
    for r in found:
        if r.winner.doc_id < 100:  # texts 600 … 699 are members
            assert r.old_winner.doc_id == r.winner.doc_id + 600 and r.old_rows == 1 and r.slot is not None
        else:
            assert r.slot is None and r.old_winner is None


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("history", ["doc_id % 2 = 0", "false", "doc_id < 300"])
def test_repeats_against_plain_groups(spark, history):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "", None, "ab", f"own {i}", "hot", "hot"])) for i in range(600)]
    rows += ROWS + [(None, "a"), (None, "only null"), (None, "only null"), (7, "hot"), (599, "hot"), (599, "hot")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, slot int, winner string")
    got = p.find_repeats(docs, F.expr(history)).drop("in_history").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_odd_tables(spark):
    got = p.find_repeats(messy(spark), F.col("doc_id") > 4).collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len({t or "" for _, t in ROWS})
    assert p.find_repeats(empty(spark), F.lit(True)).count() == 0
