"""Readers, writers and staging."""

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from wakeline.operators.skew import attach
from wakeline.sources import files, staging


def test_sheets_skip_temporary_files_and_merge(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,filename,id_name\n2024-01-01,f1,ADAM\n")
    (tmp_path / "b.csv").write_text("date,filename,id_name\n2024-01-02,f2,\n")
    (tmp_path / "~b.csv").write_text("date,filename,id_name\n2024-01-02,junk,x\n")
    got = files.merge_sheets(spark, str(tmp_path), "date date, filename string, id_name string")
    assert rows_of(got, "filename", "id_name") == [("f1", "ADAM"), ("f2", None)]


def test_photo_listing_reads_names_only(spark, tmp_path):
    folder = tmp_path / "20240105 x"
    folder.mkdir()
    for name in ("A_1.jpg", "B_2.CR2", "notes.txt"):
        (folder / name).write_text("x")
    got = files.list_photos(spark, str(tmp_path))
    assert [(r[0], str(r[1])) for r in rows_of(got, "filename", "date")] == [("A_1", "2024-01-05"), ("B_2", "2024-01-05")]


def test_gpx_segments(spark, tmp_path):
    (tmp_path / "t.gpx").write_text(
        '<?xml version="1.0"?><gpx><trk><trkseg><trkpt lat="-45.5" lon="166.5"><ele>1</ele>'
        "<time>2022-07-13T22:00:00Z</time></trkpt></trkseg><trkseg>"
        '<trkpt lat="-45.2" lon="167.0"><time>2022-07-13T22:30:00.5Z</time></trkpt></trkseg></trk></gpx>'
    )
    got = rows_of(files.read_gpx(spark, str(tmp_path)), "time", "latitude", "longitude")
    assert [str(r[0]) for r in got] == ["2022-07-13 22:00:00", "2022-07-13 22:30:00.500000"] and got[1][1:] == (-45.2, 167.0)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_survey_is_partitioned_by_trip(spark, tmp_path, fmt):
    df = spark.sql("select 'DUSKY' survey_area, '2024_01' trip, 1 n union all select 'NANCY', '2024_02', 2")
    files.write_survey(df, str(tmp_path / "s"), fmt)
    assert (tmp_path / "s" / "survey_area=DUSKY" / "trip=2024_01").is_dir()
    if fmt == "parquet":
        got = files.load_survey(spark, str(tmp_path / "s"), "NANCY", 2024, "02")
        assert [r.n for r in got.collect()] == [2] and "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_writing_a_trip_leaves_the_others(spark, tmp_path, fmt):
    path = str(tmp_path / "s")
    trip = lambda area, month, *ns: spark.createDataFrame([(area, f"2024_{month}", n) for n in ns], "survey_area string, trip string, n int")
    rows = lambda: sorted(map(tuple, spark.read.format(fmt).option("header", True).schema("n int, survey_area string, trip string").load(path).collect()))
    files.write_survey(trip("DUSKY", "01", 1, 2, 3), path, fmt)
    files.write_survey(trip("DUSKY", "02", 4), path, fmt)
    files.write_survey(trip("NANCY", "01", 5), path, fmt)
    kept = [(4, "DUSKY", "2024_02"), (5, "NANCY", "2024_01")]
    assert rows() == [(n, "DUSKY", "2024_01") for n in (1, 2, 3)] + kept
    files.write_survey(trip("DUSKY", "01", 9), path, fmt)
    assert rows() == [*kept, (9, "DUSKY", "2024_01")]
    broken = trip("DUSKY", "02", 6, 7).withColumn("n", F.expr("CASE WHEN n = 7 THEN raise_error('no') ELSE n END").cast("int"))
    with pytest.raises(Exception, match="no"):
        files.write_survey(broken, path, fmt)
    files.write_survey(trip("DUSKY", "02"), path, fmt)  # nothing to write
    assert rows() == [*kept, (9, "DUSKY", "2024_01")]


def test_a_trip_may_be_rewritten_from_itself(spark, tmp_path):
    path = str(tmp_path / "s")
    files.write_survey(spark.sql("select explode(array(1, 2, 2)) n, 'A' survey_area, '2024_01' trip"), path)
    files.write_survey(spark.read.parquet(path).distinct(), path)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 2]


def test_listing_walks_folders_in_tasks(spark, tmp_path):
    made = {}
    for folder in ("20240105 a", "20240106/deep/er", ".hidden", "", "_staged"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for n, name in enumerate(("A_1.jpg", "B_2.NEF", ".C_3.jpg", "notes.txt")):
            (tmp_path / folder / name).write_text("x" * (n + 1))
            if n < 2 and folder[:1] not in (".", "_"):
                made[str(tmp_path / folder / name)] = n + 1
    (tmp_path / "20240107 empty").mkdir()
    for levels in (1, 2, 5):
        got = files.list_photos(spark, str(tmp_path), levels=levels)
        assert {r.path: r.size for r in got.collect()} == made and got.count() == len(made)
    got = files.list_photos(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 4  # the root's own files and one task per folder
    assert {str(r.date) for r in got.collect()} == {"2024-01-05", "2024-01-06", "None"} and got.where("modified IS NULL").count() == 0


def test_stage_reads_back_what_was_written(spark, tmp_path):
    df = spark.sql("select 1 a, timestamp_ntz'2024-01-01 00:00:00' ts, cast(null as string) s")
    back = staging.stage(df, "t")
    assert back.schema.simpleString() == df.schema.simpleString() and rows_of(back) == rows_of(df)
    assert staging.staging_root(spark) in back.inputFiles()[0]


def test_attach_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), "id")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = attach(rows, per_key, ["k"])
    assert got.count() == 3_000
    assert got.where("k IS NULL").select("n").distinct().collect()[0].n == 1_000
