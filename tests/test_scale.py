"""No silent cuts, complete streams, and plans that stay small where keys are odd."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from conftest import rows_of
from test_population import LIFE, caps, person
from wakeline.functions.geo import with_metres
from wakeline.operators.joins import interval_assign
from wakeline.operators.ordered import before_key
from wakeline.operators.skew import attach
from wakeline.plans import capture, photos
from wakeline.sources import staging
from wakeline.streaming import tracks

T0 = dt.datetime(2024, 1, 1)


def test_late_years_count_unless_bounded(table):
    people = table([person("X", birth=2010, first=2010, last=2026)], LIFE)
    seen = caps(table, [("X", f"{y}-01-01", "P") for y in (2003, 2024, 2025, 2026)]).drop("pod")
    assert [r.calfyear for r in capture.census(seen, people).orderBy("calfyear").collect()] == [2003, 2024, 2025, 2026]
    assert [r.calfyear for r in capture.census(seen, people, after=2003, until=2024).collect()] == [2024]
    assert capture.trip_census(seen, people).count() == 4
    assert rows_of(capture.presence_years(seen, people), "calfyear") == [(2024,), (2025,), (2026,)]
    old = caps(table, [("X", "2001-06-01", "P")])
    assert capture.season_flags(old).count() == 1 and capture.season_flags(old, after_year=2005).count() == 0


def test_photo_effort_takes_every_area_and_year(table):
    rows = table(
        [("A", 2025, "ELSEWHERE", "2025-01-01", "f1", "p"), ("B", 2007, "DUSKY", "2007-01-01", "f2", "p")],
        "id_name string, calfyear int, survey_area string, date date, filename string, photographer string",
    )
    assert capture.photo_effort(rows).count() == 2
    assert capture.photo_effort(rows, ["DUSKY"], 2024).count() == 1


def test_interval_of_two_centuries(spark):
    points = spark.createDataFrame([("a", T0, 1), ("a", T0 + dt.timedelta(days=3), 2), ("b", T0, 3)], "k string, ts timestamp_ntz, p int")
    spans = [("a", T0 - dt.timedelta(days=36_500), T0 + dt.timedelta(days=36_500), 10), ("a", T0, T0 + dt.timedelta(hours=1), 11)]
    windows = spark.createDataFrame(spans, "k string, lo timestamp_ntz, hi timestamp_ntz, g int")
    got = interval_assign(points, windows, ["k"], "ts", "lo", "hi", "left")
    assert rows_of(got, "p", "g") == [(1, 10), (1, 11), (2, 10), (3, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan


def test_attach_repeats_neither_side(spark):
    rows = spark.range(1_000).withColumn("k", F.col("id"))
    joined = attach(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.where("n = 1").count() == 1_000


def test_hot_key_is_split_at_run_time(spark):
    """A third of all rows on one key: adaptive handling splits its partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # rows come in several map outputs, between which a partition can be split
        rows = spark.range(0, 120_000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        joined = attach(rows, spark.range(-1, 120_000).select(F.col("id").alias("k"), F.lit(1).alias("n")), ["k"])
        tasks = joined.groupBy(F.spark_partition_id().alias("p"), "n").agg(F.sum((F.col("k") == -1).cast("int")).alias("hot"), F.max("v")).collect()
        assert sum(t.hot for t in tasks) == 40_000 and sum(t.hot > 0 for t in tasks) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_odd_key_leaves_ranges_even(spark):
    keys = [(f"user_{i:06d}", 1) for i in range(1_000)] + [("A", 1), (None, 1)]
    per_key = spark.createDataFrame(keys, "k string, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = before_key(per_key, "k", sums={"before": "n"})
        root = staging.staging_root(spark)
        names = spark._jvm.java.io.File(root).list()
        newest = max((n for n in names if n.startswith("keys-")), key=lambda n: spark._jvm.java.io.File(f"{root}/{n}").lastModified())
        sizes = [r["n"] for r in spark.read.parquet(f"{root}/{newest}").groupBy("__b").agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {k: i for i, k in enumerate(sorted((k for k, _ in keys), key=lambda x: (x is not None, x)))}
    assert {r.k: r.before for r in got.collect()} == want


def test_antipodes_have_no_distance(spark):
    points = spark.createDataFrame([(0.0, 0.0, 179.7, 0.5), (0.0, 0.0, 1.0, 0.0)], "a double, b double, c double, d double")
    far, near = with_metres(points, "m", "a", "b", "c", "d").orderBy("c", ascending=False).collect()
    assert far.m is None and abs(near.m - 111_319.49) < 0.1


def test_duplicates_of_frames_without_names(table):
    rows = table([("f", None, 1), ("f", "", 2), ("g", "", 3), (None, "", 4), ("h", "A", 5), ("h", "", 6)], "frame string, name string, n int")
    got = photos.resolve_duplicates(rows, ["frame"], "name")
    assert rows_of(got, "n") == [(3,), (4,), (5,)]


def _run(spark, tmp_path, batches, schema, build, keys):
    """Feed one file per micro-batch and read the keyed sink."""
    source = tmp_path / uuid.uuid4().hex
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{n}")
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"))
    job = (
        stream.writeStream.outputMode("update")
        .foreachBatch(tracks.update_sink(f"{source}-rows"))
        .option("checkpointLocation", f"{source}-state")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{source}-rows")
    assert rows.select("batch").distinct().count() > 1
    return tracks.newest(rows, keys)


def test_thinned_stream_keeps_its_last_bins(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("d", at(5), 1.0, 1.0), ("d", at(25), 2.0, 2.0)], [("d", at(3), 3.0, 3.0), ("e", at(21), 4.0, 4.0)]]
    got = _run(spark, tmp_path, batches, "device_id string, ts timestamp_ntz, latitude double, longitude double", lambda s: tracks.stream_thin(s, 10), ["device_id", "bin"])
    assert rows_of(got, "device_id", "ts") == [("d", at(3)), ("d", at(25)), ("e", at(21))]


def test_first_seen_takes_the_earliest_of_all_batches(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, n)
    batches = [[("A", day(5)), ("B", day(9))], [("A", day(2)), ("C", day(1))], [("A", day(7))]]
    got = _run(spark, tmp_path, batches, "id_name string, date date", tracks.stream_first_seen, ["id_name"])
    assert rows_of(got, "id_name", "first_date") == [("A", day(2)), ("B", day(9)), ("C", day(1))]


def test_streamed_photos_without_a_window_come_out(spark, tmp_path):
    """Windows of any length, photos of every kind, over several batches; a last row on each side closes the rest."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    shots, windows = f"{tmp_path}/shots", f"{tmp_path}/windows"
    photo_schema, window_schema = "device_id long, ts timestamp_ntz, n int", "device_id long, lo timestamp_ntz, hi timestamp_ntz, sighting_number long"
    spans = [[(1, at(0), at(2), 10), (2, at(-3), at(24 * 40), 20)], [(1, at(1), at(30), 11), (1, at(9), at(8), 12)], [(-1, at(10**5), at(10**5), 0)]]
    photos_in = [[(1, at(1), 1), (2, at(5), 2), (3, at(1), 3), (None, at(1), 4), (1, None, 5)], [(1, at(30), 6), (1, at(31), 7), (2, at(24 * 39), 8), (1, at(2), 9)], [(-1, at(10**5), 0)]]
    for path, batches, schema in ((shots, photos_in, photo_schema), (windows, spans, window_schema)):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")
    read = lambda path, schema: spark.readStream.schema(schema).parquet(f"{path}/*")
    joined = tracks.stream_photo_groups(read(shots, photo_schema), read(windows, window_schema), "1 day", ("device_id",))
    job = joined.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    job.awaitTermination()
    got = spark.read.schema(joined.schema).parquet(f"{tmp_path}/out").where("n > 0")
    want = [(1, 10), (1, 11), (2, 20), (3, None), (4, None), (5, None), (6, 11), (7, None), (8, 20), (9, 10), (9, 11)]
    assert rows_of(got, "n", "sighting_number") == want
