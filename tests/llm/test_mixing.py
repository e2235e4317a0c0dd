from collections import Counter

import numpy as np
import pytest
from messy import ROWS, corpus, empty, messy
from wakeline.llm import mixing


@pytest.mark.parametrize("weights", [[1], [1, 1], [0.7, 0.2, 0.1], [5, 3, 3, 2, 1, 1, 0.001], list(range(1, 60)), [1e-9, 1]])
def test_every_prefix_is_within_one_block(weights):
    slots = mixing.quotas(weights, 4096)
    assert sum(slots) == 4096 and min(slots) >= 1
    table = mixing.lay_out(slots)
    assert sorted(x for t in table for x in t) == list(range(4096))
    for quota, own in zip(slots, table):
        held = np.zeros(4096)
        held[own] = 1
        assert np.abs(held.cumsum() - quota / 4096 * np.arange(1, 4097)).max() < 1
        for i, at in enumerate(own):
            assert i * 4096 // quota <= at < -(-(i + 1) * 4096 // quota)


def test_stream_follows_the_targets(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 4)) AS source")
    targets = {"hot": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.1}
    rows = mixing.schedule(docs, targets, block_docs=4, period=1000).collect()
    assert len(rows) == 3_000
    blocks = {}
    for r in rows:
        blocks.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(x) == 1 for x in blocks.values())
    sizes = Counter((r.source, r.block) for r in rows)
    count = Counter(r.source for r in rows)
    for source, n in count.items():
        own = [sizes[source, b] for b in range(-(-n // 4))]
        assert all(x == 4 for x in own[:-1]) and sum(own) == n
    # until the first source ends, every prefix holds its share
    last = min(max(r.slot for r in rows if r.source == s) for s in targets)
    for source, share in targets.items():
        held = np.array([any(s == source for s, _ in blocks.get(t, ())) for t in range(last)]).cumsum()
        assert np.abs(held - share * np.arange(1, last + 1)).max() < 1 + 1e-9


def test_rare_sources_keep_weights_of_their_own(spark):
    docs = spark.range(4_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'hot', concat('s', id % 40)) AS source")
    targets = {"hot": 0.4, "s39": 0.3, "s1": 0.1}
    for weights, small in ((targets, {}), (None, {"max_sources": 2, "group_sources": 6}), (targets, {"max_sources": 1, "group_sources": 6})):
        rows = mixing.schedule(docs, weights, block_docs=4, period=4096, **small).collect()
        assert len(rows) == 4_000
        blocks = {}
        for r in rows:
            blocks.setdefault(r.slot, set()).add((r.source, r.block))
        assert all(len(x) == 1 for x in blocks.values())
        count = Counter(r.source for r in rows)
        weigh = {s: weights.get(s, 0.01) if weights else n**mixing.SMOOTHING for s, n in count.items()}
        last = min(max(r.slot for r in rows if r.source == s) for s in count)
        for source, w in weigh.items():
            held = np.array([any(s == source for s, _ in blocks.get(t, ())) for t in range(last)]).cumsum()
            assert np.abs(held - w / sum(weigh.values()) * np.arange(1, last + 1)).max() < 2.1, source


def test_more_sources_than_slots(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('s', id) AS source")
    assert len({r.slot for r in mixing.schedule(docs, block_docs=1, period=64).collect()}) == 300


def test_nothing_is_lost_and_order_takes_effect(spark, tmp_path):
    docs, _ = corpus(spark)
    mixing.interleave(docs).write.parquet(f"{tmp_path}/mixed")
    back = spark.read.parquet(f"{tmp_path}/mixed")
    assert back.columns == docs.columns
    key = lambda rows: sorted(map(str, rows))
    assert key(back.collect()) == key(docs.collect())
    slot = {(r.doc_id, r.source): r.slot for r in mixing.schedule(docs).collect()}
    order = [slot[r.doc_id, r.source] for r in back.coalesce(1).collect()]
    files = sorted(back.inputFiles())
    by_file = [[slot[r.doc_id, r.source] for r in spark.read.parquet(f).coalesce(1).collect()] for f in files]
    assert [x for f in by_file for x in f] == sorted(order)


def test_odd_rows_and_tables(spark):
    got = mixing.schedule(messy(spark)).collect()
    assert len(got) == len(ROWS)  # the row that is there twice has two places
    assert mixing.interleave(messy(spark)).count() == len(ROWS)
    assert mixing.interleave(empty(spark)).count() == 0 and mixing.schedule(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, None), (2, "a")], "doc_id long, source string")
    assert mixing.schedule(nulls, {"a": 0.5, None: 0.5}).count() == 3


def test_copies_have_places_and_columns_any_names(spark):
    rows = [(i % 4, "s", "a", 1, 2, 3, 4) for i in range(40)] + [(9, None, "b", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _own string, _slot int, _id int, _mark int, _row int")
    placed = mixing.schedule(docs, block_docs=4).collect()
    assert len(placed) == 41 and sorted(Counter(r.block for r in placed if r.source).values()) == [4] * 10
    mixed = mixing.interleave(docs, block_docs=4)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
