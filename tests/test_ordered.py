import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows_of
from wakeline.operators import ordered
from wakeline.operators.joins import asof_join, complete, interval_assign

T0 = dt.datetime(2024, 1, 1)


def random_rows(n=400, keys=4, seed=7):
    """Unique (key, time) rows; one key holds a third of them, some keys are NULL."""
    rng = random.Random(seed)
    rows, used = [], set()
    while len(rows) < n:
        key = 0 if rng.random() < 0.34 else rng.choice([None, *range(1, keys)])
        t = rng.randrange(0, 40_000)
        if (key, t) in used:
            continue
        used.add((key, t))
        rows.append((key, T0 + dt.timedelta(seconds=t), rng.choice([None, None, rng.randrange(99)]), len(rows)))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(random_rows(), "k int, ts timestamp_ntz, v int, id int").cache()


@pytest.mark.parametrize("span", [60, 3_600, 86_400])
def test_span_split_operators_equal_plain_windows(events, span):
    args = (["k"], "ts", (), span)
    w = Window.partitionBy("k").orderBy("ts")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    cases = [
        (ordered.locf(events, ["v"], *args), F.last("v", True).over(before)),
        (ordered.nocb(events, ["v"], *args), F.first("v", True).over(after)),
        (ordered.number_rows(events, "v", *args), F.row_number().over(w)),
        (ordered.sessionise(events, F.col("v") > 50, "v", *args),
         F.sum((F.coalesce(F.col("v"), F.lit(0)) > 50).cast("int")).over(before)),
        (ordered.lag_row(events, {"p": "id"}, *args).withColumn("v", F.col("p")), F.lag("id").over(w)),
        (ordered.lead_row(events, {"p": "id"}, *args).withColumn("v", F.col("p")), F.lead("id").over(w)),
    ]
    for got, plain in cases:
        assert rows_of(got, "id", "v") == rows_of(events.withColumn("v", plain), "id", "v")


def test_locf_frame_crosses_keys(table):
    df = table(
        [("a", "2024-01-01 01:00:00", "x"), ("b", "2024-01-01 00:30:00", None),
         ("b", "2024-01-01 02:00:00", "y"), ("c", "2024-01-01 00:00:00", None)],
        "k string, ts timestamp_ntz, v string",
    )
    assert [r.v for r in ordered.locf_frame(df, ["v"], "k", "ts").orderBy("k", "ts").collect()] == ["x", "x", "y", "y"]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_before_key_is_a_running_total_in_key_order(spark, kind):
    keys = spark.range(0, 500).select(
        F.concat(F.lit("device_"), F.lpad("id", 5, "0")).alias("k")
        if kind == "string" else (F.col("id") * 7919 % 100_003).alias("k"),
        (F.col("id") % 5).alias("n"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("l"),
    )
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    want = keys.select("k", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("s"), F.last("l", True).over(w).alias("p"))
    got = ordered.before_key(keys, "k", sums={"s": "n"}, lasts={"p": "l"})
    assert rows_of(got, "k", "s", "p") == rows_of(want)


def test_thinning_golden_and_idempotent(table, events):
    fixes = table([("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 3, 9, 10, 19, 20, 21)], "d string, ts timestamp_ntz")
    kept = ordered.thin_bins(fixes, ["d"], "ts", 10, span_seconds=15)
    assert [r.ts.second for r in kept.orderBy("ts").collect()] == [0, 10, 20]
    once = ordered.thin_bins(events, ["k"], "ts", 600, span_seconds=3_600)
    assert rows_of(ordered.thin_bins(once, ["k"], "ts", 600), "id") == rows_of(once, "id")


def test_fill_from_first_stops_at_an_open_end(table):
    df = table(
        [("a", f"2024-01-01 00:00:0{i}", m, t) for i, (m, t) in enumerate(
            [(0, None), (1, "Initial"), (0, None), (1, None), (0, None)])],
        "d string, ts timestamp_ntz, m int, t string",
    )
    out = ordered.fill_from_first(df, "t", ["Initial"], F.col("m") == 1, ["d"], "ts", span_seconds=1)
    assert [r.t for r in out.orderBy("ts").collect()] == [None, "Initial", "Initial", None, None]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("span", [600, 86_400])
def test_asof_against_brute_force(spark, direction, span):
    left, right = random_rows(200, seed=1), [r for r in random_rows(150, seed=2)]
    ldf = spark.createDataFrame(left, "k int, ts timestamp_ntz, v int, id int")
    rdf = spark.createDataFrame(right, "k int, ts timestamp_ntz, v int, rid int").drop("v")
    got = asof_join(ldf, rdf, "ts", ["k"], direction, span_seconds=span)

    def best(row):
        same = [r for r in right if row[0] is not None and r[0] == row[0]]
        back = max((r for r in same if r[1] <= row[1]), key=lambda r: r[1], default=None)
        ahead = min((r for r in same if r[1] >= row[1]), key=lambda r: r[1], default=None)
        if direction == "nearest" and back and ahead:
            return back if row[1] - back[1] <= ahead[1] - row[1] else ahead
        return {"backward": back, "forward": ahead, "nearest": back or ahead}[direction]

    want = {r[3]: (best(r) or [None] * 4)[3] for r in left}
    assert {r.id: r.rid for r in got.select("id", "matched.rid").collect()} == want


def test_asof_strict_tolerance_and_null_time(table):
    left = table([("a", "2024-01-01 00:00:10"), ("a", None)], "k string, ts timestamp_ntz")
    right = table([("a", "2024-01-01 00:00:10", 2), ("a", "2024-01-01 00:00:01", 1)], "k string, ts timestamp_ntz, n int")
    strict = asof_join(left, right, "ts", ["k"], allow_exact=False)
    assert rows_of(strict.select("matched.n")) == [(1,), (None,)]
    near = asof_join(left, right, "ts", ["k"], allow_exact=False, tolerance_seconds=5)
    assert rows_of(near.select("matched.n")) == [(None,), (None,)]


def test_intervals_against_brute_force(spark):
    rng = random.Random(3)
    pts = [(rng.randrange(3), T0 + dt.timedelta(seconds=rng.randrange(90_000)), i) for i in range(300)]
    ivs = []
    for i in range(60):
        lo = rng.randrange(90_000)
        ivs.append((rng.randrange(3), T0 + dt.timedelta(seconds=lo), T0 + dt.timedelta(seconds=lo + rng.randrange(20_000)), i))
    pdf = spark.createDataFrame(pts, "k int, ts timestamp_ntz, p int")
    idf = spark.createDataFrame(ivs, "k int, lo timestamp_ntz, hi timestamp_ntz, g int")
    got = interval_assign(pdf, idf, ["k"], "ts", "lo", "hi", "left", bin_seconds=1_000)
    want = []
    for k, t, p in pts:
        hit = [g for kk, lo, hi, g in ivs if kk == k and lo <= t <= hi]
        want += [(p, g) for g in hit] or [(p, None)]
    assert rows_of(got, "p", "g") == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_complete(table):
    df = table([("P", 2010, 1), ("Q", 2011, 1)], "pod string, y int, n int")
    assert rows_of(complete(df, ["pod", "y"], {"n": 0})) == [("P", 2010, 1), ("P", 2011, 0), ("Q", 2010, 0), ("Q", 2011, 1)]


def test_intervals_of_very_different_lengths(spark):
    """Seconds to centuries, in one join: copies of points, points without key or time, no action on the way."""
    rng = random.Random(5)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    pts = [(rng.choice([0, 1, 2, None]), rng.choice([None, *[at(rng.randrange(-10**6, 10**8)) for _ in range(5)]]), i // 2) for i in range(300)]
    ivs = []
    for i in range(120):
        lo = rng.randrange(-10**6, 10**8)
        ivs.append((rng.randrange(2), at(lo), at(lo + int(10 ** rng.uniform(0, 9.4))), i))
    ivs += [(0, at(50), at(40), 900), (0, None, at(1), 901), (None, at(0), at(10**8), 902)]
    pdf = spark.createDataFrame(pts, "k int, ts timestamp_ntz, p int")
    idf = spark.createDataFrame(ivs, "k int, lo timestamp_ntz, hi timestamp_ntz, g int")
    hits = {n: [g for kk, lo, hi, g in ivs if kk is not None and kk == k and t and lo and lo <= t <= hi] for n, (k, t, _) in enumerate(pts)}
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = [(p, g) for n, (_, _, p) in enumerate(pts) for g in hits[n]]
    seen = spark.sparkContext.statusTracker()
    before = len(seen.getJobIdsForGroup())
    inner = interval_assign(pdf, idf, ["k"], "ts", "lo", "hi")
    left = interval_assign(pdf, idf, ["k"], "ts", "lo", "hi", "left")
    assert len(seen.getJobIdsForGroup()) == before
    assert rows_of(inner, "p", "g") == sorted(want, key=key)
    alone = [(p, None) for n, (_, _, p) in enumerate(pts) if not hits[n]]
    assert rows_of(left, "p", "g") == sorted(want + alone, key=key) and left.columns == [*pdf.columns, "lo", "hi", "g"]
    nothing = interval_assign(pdf, idf.where("g < 0"), ["k"], "ts", "lo", "hi", "left")
    assert rows_of(nothing, "p", "g") == sorted([(p, None) for _, _, p in pts], key=key)


def test_one_wrong_end_date_costs_few_rows(spark):
    from wakeline.operators.joins import binned

    spans = [(T0, T0 + dt.timedelta(days=d)) for d in (0, 1, 400, 300_000, 2_900_000)]
    rows = binned(spark.createDataFrame(spans, "lo timestamp_ntz, hi timestamp_ntz"), "lo", "hi", 3_600)
    copies = [r.n for r in rows.groupBy("lo", "hi").agg(F.count("*").alias("n")).collect()]
    assert len(copies) == 5 and max(copies) <= 65


def test_grid_of_many_values(spark, monkeypatch):
    from wakeline.operators import joins

    monkeypatch.setattr(joins, "GRID_BUCKET", 16)
    rng = random.Random(6)
    rows = {(rng.randrange(40), f"v{rng.randrange(300)}", rng.choice("xyz")): n for n in range(250)}
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()] + [(7, None, "x", 1), (None, "v1", "x", 1)], "a int, b string, c string, n int")
    got = complete(df, ["a", "b", "c"], {"n": -1})
    values = [{k[i] for k in rows} for i in range(3)]
    want = {(a, b, c): rows.get((a, b, c), -1) for a in values[0] | {7, None} for b in values[1] | {"v1"} for c in values[2] | {"x"}}
    assert {(r.a, r.b, r.c): r.n for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("span", [600, 86_400])
def test_carry_of_several_values_against_brute_force(spark, span):
    rng = random.Random(span)
    rows = [
        (rng.choice(["a", "b", "c", "d"]), T0 + dt.timedelta(seconds=rng.randrange(40) * 97), i, rng.random() < 0.2, rng.choice([None, "I", "F"]), rng.choice([None, None, None, "p", "q"]))
        for i in range(200)
    ]
    rows = [(k, t, i, m, v, None if k == "a" else p) for k, t, i, m, v, p in rows]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, mark boolean, v string, p string")
    carries = {
        "in_force": ordered.Carry(F.col("v"), F.col("mark"), ("id",), after_equal=True),
        "p": ordered.Carry(F.col("p"), F.col("p").isNotNull(), ("id",), over_keys=True),
    }
    got = {r.id: (r.in_force, r.p) for r in ordered.carry_forward(df, carries, "k", "ts", span).collect()}
    for k, t, i, m, v, p in rows:
        marks = [r for r in rows if r[0] == k and r[3] and ((r[1], r[2]) <= (t, i) if m else r[1] <= t)]
        known = [r for r in rows if r[5] and (r[0], r[1], r[2]) <= (k, t, i)]
        want = max(marks, key=lambda r: r[1:3])[4] if marks else None
        assert got[i] == (want, max(known, key=lambda r: r[:3])[5] if known else None)


def test_carry_shuffles_the_rows_once(spark):
    df = spark.range(1_000).selectExpr("id % 3 AS k", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts", "IF(id % 9 = 0, id, NULL) AS v", "IF(id % 7 = 0, id, NULL) AS w")
    carries = {c: ordered.Carry(F.col(c), F.col(c).isNotNull()) for c in ("v", "w")}
    plan = ordered.carry_forward(df, carries, "k", "ts")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 3  # the rows, their cells, and the rows that set something


def test_micros_ignores_session_zone(spark):
    from wakeline.functions.dates import micros

    df = spark.sql("select timestamp_ntz'2024-04-07 02:30:00.25' t")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        got = df.select(micros("t").alias("m")).first().m
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == 1712457000250000


def test_one_key_is_spread_over_tasks(spark):
    """All rows under one key: every ordered operator still uses many tasks."""
    hours = spark.range(0, 960).selectExpr(
        "1 AS k", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts",
        "CASE WHEN id % 100 = 0 THEN id END AS v",
    )
    marks = hours.where("v IS NOT NULL").select("k", "ts", "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df, out in (
            (ordered.locf(hours, ["v"], ["k"], "ts"), "v"),
            (ordered.number_rows(hours, "n", ["k"], "ts"), "n"),
            (ordered.lead_row(hours, {"next": "v"}, ["k"], "ts"), "next"),
            (asof_join(hours.select("k", "ts"), marks, "ts", ["k"]), "matched"),
        ):
            # the output column keeps the optimizer from dropping the operator
            placed = df.select(F.spark_partition_id().alias("p"), F.col(out).isNull().alias("empty"))
            tasks = placed.groupBy("p").agg(F.count("empty").alias("n")).collect()
            assert sum(r.n for r in tasks) == 960
            assert len(tasks) > 1 and max(r.n for r in tasks) < 960 * 0.7
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
