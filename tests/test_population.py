"""Hand-worked life histories, capture histories and reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from wakeline.functions import text
from wakeline.plans import capture, life, photos, reports

LIFE = "pod string, name string, code string, sex string, mom string, first_calf int, birth_year int, inutero date, first_year int, first_date date, death_year int, last_year int, last_date date"


def person(name, pod="DUSKY", sex="F", mom=None, first_calf=None, birth=None, first=None, first_date=None, death=None, last=None, last_date=None):
    return (pod, name, name.lower(), sex, mom, first_calf, birth, None, first, first_date, death, last, last_date)


def classes(table, **kw):
    df = life.age_class(table([person("A", **kw)], LIFE), 2009, 2019)
    return {r.year: r.ageclass for r in df.collect()}


def test_age_class_from_birth(table):
    got = classes(table, birth=2010, first=2010)
    assert got[2009] == "NA" and got[2010] == "C" and got[2011] == got[2012] == "J"
    assert {got[y] for y in range(2013, 2019)} == {"S-A"} and got[2019] == "A"


def test_age_class_from_first_year(table):
    got = classes(table, first=2010)
    assert {got[y] for y in range(2010, 2018)} == {"U"} and got[2018] == "A"


def test_age_class_first_calf_and_death(table):
    got = classes(table, birth=2010, first=2010, first_calf=2016, death=2017)
    assert [got[y] for y in (2015, 2016, 2017, 2018)] == ["S-A", "A", "A", "D"]


def test_pods(table):
    df = table([(n,) for n in (1999, 2000, 3000, 4000)], "entryno int")
    assert [r.pod for r in life.with_pod(df).orderBy("entryno").collect()] == ["DOUBTFUL", "DUSKY", "NORTHERN", None]


def test_life_history_blank_years_first_calf_and_inutero(table):
    raw = table(
        [(2001, "MUM", "m", "F", "", "1990", "1995", ""), (2002, "KID", "k", "M", "MUM", "2010", "2010", ""),
         (2003, "OLD", "o", "F", "MUM", "", "2000", "2009")],
        "entryno int, name string, code string, sex string, mom string, birth_year string, first_year string, death_year string",
    )
    caps = table(
        [("MUM", "2009-01-05", 2009), ("MUM", "2010-02-01", 2010), ("MUM", "2010-03-01", 2010), ("KID", "2010-03-01", 2010), ("OLD", "2000-01-01", 2000)],
        "id_name string, date date, calfyear int",
    )
    got = {r.name: r for r in life.life_history(raw, caps).collect()}
    assert got["MUM"].first_calf == 2010 and got["KID"].inutero == dt.date(2010, 2, 1)
    assert got["OLD"].last_year == 2009 and got["KID"].last_year == 2010 and got["MUM"].inutero is None
    fixed = table([("OLD", "2001-01-01")], "name string, last_date date")
    assert {r.name: r for r in life.life_history(raw, caps, fixed).collect()}["OLD"].last_date == dt.date(2001, 1, 1)


@pytest.mark.parametrize("n, want", [((55, 52, 51), (56, 55, 56)), ((10, 8, 4), (18, 15, 21)), ((5, 5, 0), (35, 9, 60)), ((5, 5, 5), (5, 4, 5))])
def test_two_sample_estimates(spark, n, want):
    n1, n2, m2 = n
    ids = [(i, 1, 1 if i < m2 else 0) for i in range(n1)] + [(n1 + i, 0, 1) for i in range(n2 - m2)]
    flags = spark.createDataFrame(ids, "id int, winter int, spring int").selectExpr(
        "2010 AS year", "'P' AS pod", "cast(id as string) AS id_name", "winter", "spring", "0 AS autumn", "0 AS summer")
    got = capture.two_sample_abundance(flags).first()
    assert (got.n1, got.n2, got.m2) == n and (got.nhat, got.lcl, got.ucl) == want and got.n == n1 + n2 - m2
    wide = capture.two_sample_abundance(flags, ci="normal95").first()
    assert wide.nhat == want[0] and wide.ucl >= wide.nhat >= wide.lcl


def caps(table, rows):
    df = table(rows, "id_name string, date date, pod string")
    return df.withColumns({"trip": F.date_format("date", "yyyy_MM"), "year": F.year("date"), "calfyear": F.year("date") + (F.month("date") >= 9).cast("int")})


def test_seasons_and_unsurveyed(table):
    months = {"2010-02-01": "summer", "2010-03-01": "autumn", "2010-06-01": "winter", "2010-09-01": "spring", "2010-12-01": "summer", "2015-12-01": "spring"}
    flags = capture.season_flags(caps(table, [(f"i{i}", d, "P") for i, d in enumerate(months)], ))
    for i, season in enumerate(months.values()):
        row = flags.where(F.col("id_name") == f"i{i}").first()
        assert [s for s in ("winter", "spring", "autumn", "summer") if row[s]] == [season]
    only = capture.season_captures(flags.where("year = 2015")).first()
    assert (only.winter, only.spring, only.autumn, only.summer, only.both) == (999, 1, 999, 999, 0)
    assert capture.two_sample_abundance(flags.where("year = 2015")).count() == 0


def test_autumn_stands_in_for_winter(table):
    rows = [("A", "2010-04-01", "P"), ("A", "2010-10-01", "P"), ("B", "2010-04-02", "P")]
    flags = capture.season_flags(caps(table, rows))
    got = capture.two_sample_abundance(flags).first()
    assert (got.n1, got.n2, got.m2, got.season) == (2, 1, 1, "Autumn Spring")
    assert rows_of(capture.season_captures(flags), "id_name", "both") == [("A", 1), ("B", 0)]


def test_calf_year_scheme(table):
    rows = [("A", "2009-10-01", "P"), ("A", "2010-04-01", "P"), ("B", "2009-10-02", "P")]
    flags = capture.season_flags(caps(table, rows), "calfyear")
    got = capture.two_sample_abundance(flags, "calfyear").first()
    assert (got.year, got.n1, got.n2, got.m2, got.season, got.subset) == (2010, 2, 1, 1, "999", "Calfyear")


def daily(table, rows):
    return table([(n, d, "F", 2000, 2000, "A") for n, d in rows], "name string, date date, sex string, birth_year int, first_year int, ageclass string")


def test_discovery_curve(table):
    d = [f"2024-01-0{i}" for i in (1, 2, 3, 4)]
    seen = daily(table, [("A", d[0]), ("B", d[0]), ("B", d[1]), ("A", d[3]), ("C", d[3])])
    days = table([(x,) for x in d], "date date")
    rows = capture.discovery_curve(seen, days).orderBy("date").collect()
    assert [[r[c] for r in rows] for c in ("ni", "ui", "vi", "disc")] == [[2, 1, 0, 2], [2, 0, 0, 1], [0, 1, 0, 2], [2, 2, 2, 3]]
    assert rows_of(capture.capture_frequency(seen)) == [(1, 1), (2, 2)]
    wide = capture.capture_matrix(seen, d[:2])
    assert rows_of(wide, "name", d[0], d[1]) == [("A", 1, 0), ("B", 1, 1), ("C", 0, 0)]


def test_matrix_takes_its_days_from_the_trip(table):
    rows = [(n, d, "F", 2000, 2001, "A") for n, d in (("A", "2024-01-05"), ("A", "2024-01-03"), ("B", "2024-01-03"))]
    seen = table(rows, "name string, date date, sex string, birth_year int, first_year int, ageclass string")
    wide = capture.capture_matrix(seen)
    assert wide.columns[-2:] == ["2024-01-03", "2024-01-05"]
    assert rows_of(wide, "name", "2024-01-03", "2024-01-05") == [("A", 1, 1), ("B", 1, 0)]
    with pytest.raises(ValueError, match="more than 1 days"):
        capture.capture_matrix(seen, most=1)


def test_a_mother_of_many_is_listed_short(table):
    rows = [("UNKNOWN", f"c{i:03d}") for i in range(50)] * 2 + [("EVA", "x"), ("EVA", "y"), ("EVA", None), (None, "z"), ("ONE", "x")]
    got = life.calves_of(table(rows, "mom string, name string"), shown=3)
    assert rows_of(got) == [("EVA", "x and y", 2), ("ONE", "x", 1), ("UNKNOWN", "c000, c001, c002 and 47 more", 50)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_uncertain_names_stay_out(table):
    names = ["A", "B?", "CALF", "UNMA", "x_1", "UK7", "CULLED", "", None]
    shots = table([(n, "2024-01-01") for n in names], "id_name string, date date")
    alive = table([person("A", birth=2000, first=2000)], LIFE).withColumn("ageclass", F.lit("A"))
    assert [r.name for r in capture.daily_captures(shots, alive).collect()] == ["A"]


def test_age_sex_table_has_every_column(table):
    rows = table([("A", "F", "A"), ("B", "M", "C")], "name string, sex string, ageclass string")
    got = capture.age_sex_table(rows).orderBy("rank")
    assert [tuple(r)[:4] for r in got.collect()] == [("Adult", 1, 0, 0), ("Calf*", 0, 1, 0)]


def test_gap_filled_census(table):
    people = table([person("X", birth=2010, first=2010, last=2013), person("Y", birth=2010, first=2010, last=2013)], LIFE)
    rows = [("X", "2010-01-01"), ("X", "2013-01-01")] + [("Y", f"{y}-01-01") for y in range(2010, 2014)]
    seen = caps(table, [(n, d, "P") for n, d in rows]).drop("pod")
    filled = capture.gap_filled_census(capture.presence_years(seen, people))
    assert [r.calfyear_ng for r in filled.orderBy("calfyear").collect()] == [2, 2, 2, 2]
    counted = capture.census(seen, people).orderBy("calfyear").collect()
    assert [r.n_calfyear for r in counted] == [2, 1, 1, 2]


def test_census_exclusions(table):
    people = table([person("SUN"), person("D-2011"), person("N", pod="NORTHERN"), person("OK")], LIFE)
    seen = caps(table, [(n, "2010-01-01", "P") for n in ("SUN", "D-2011", "N", "OK")]).drop("pod")
    got = capture.census(seen, people, [("SUN", 2010)]).collect()
    assert [(r.pod, r.n_calfyear, r.n_year) for r in got] == [("DUSKY", 1, 1)]


def test_not_seen_recently(table):
    people = table([person(n, last_date=d) for n, d in (("ab", "2021-06-09"), ("LONG-NAME", "2021-06-10"), ("cd", "2022-06-09"), ("ef", "2022-06-10"))], LIFE)
    alive = people.withColumn("ageclass", F.lit("A"))
    trip = table([("zz",)], "name string")
    gone = capture.not_seen_recently(alive, trip, F.lit("2023-06-10").cast("date"))
    assert rows_of(gone, "name_sex", "last_year") == [("Long-Name (F)", 2021), ("cd (F)", 2022)]
    assert rows_of(capture.not_seen_table(gone)) == [(2021, "Adult", 1, 0, 0), (2022, "Adult", 1, 0, 0)]


def test_births_and_share(table):
    people = table([person("A", pod="P", birth=2010), person("B", pod="Q", birth=2011)], LIFE)
    assert rows_of(life.births(people, 2000)) == [("P", 2010, 1), ("P", 2011, 0), ("Q", 2010, 0), ("Q", 2011, 1)]
    mixed = table([person(n, pod="P", birth=1990 if i else 2010, first=1990 if i else 2010) for i, n in enumerate("ABCD")], LIFE)
    seen = table([(n, 2012) for n in "ABCD"], "id_name string, year int")
    assert rows_of(life.composition(mixed, seen, 2012), "ageclass", "prop") == [("A", 0.75), ("J", 0.25)]


def test_join_words(spark):
    df = spark.sql("select array('A', 'B', 'C') a, array('A') b, array('x', 'y', 'z') c")
    got = df.select(text.join_words(F.col("a")), text.join_words(F.col("b")), reports.place_list(F.col("c"))).first()
    assert tuple(got) == ("A, B and C", "A", "x, y, and z")


def test_photo_groups_keep_unmatched(table):
    windows = table([(1, "2024-01-01 09:00:00", "2024-01-01 09:30:00"), (2, "2024-01-01 10:00:00", "2024-01-01 10:30:00")],
                    "sighting_number int, lo timestamp_ntz, hi timestamp_ntz").withColumn("date", F.to_date("lo"))
    shots = table([(f"2024-01-01 {c}:00", c) for c in ("09:15", "09:45", "10:30", "10:30")], "ts timestamp_ntz, filename string")
    got = photos.photo_groups(shots.withColumn("date", F.to_date("ts")), windows)
    assert rows_of(got, "filename", "group") == [("09:15", 1), ("09:45", None), ("10:30", 2)]


META = "file_name string, source_file string, datetime_original string"


def parsed(table, name, era, folder="/t/BOB x/", **kw):
    df = photos.parse_filenames(table([(name, folder + name, "2007:05:06 07:08:09")], META), era, "Dusky", "2007_05", **kw)
    return rows_of(df, "name", "part", "filename", "comments")


def test_file_names_by_era(table):
    assert parsed(table, "ADAM l IMG_0001.jpg", "post_2008") == [("ADAM", "LD", "IMG_0001", "")]
    both = "ADAM and BOBA l IMG_0002.jpg"
    assert parsed(table, both, "post_2008") == [("ADAM", "LD", "IMG_0002", ""), ("BOBA", "L", "IMG_0002", "")]
    assert parsed(table, both, "post_2008", normalise_part=True)[1][1] == "LD"
    assert parsed(table, "ADAM ' ' l IMG_0001.jpg", "post_2008")[0][3] == "Conditional match"
    assert parsed(table, "D0012 ADAM IMG_L01.jpg", "to_2008") == [("ADAM", "LD", " IMG_L01", "")]
    assert parsed(table, "IMG_0001_Lx.jpg", "in_2006") == [("BOB", "LD", "IMG_0001_Lx.jpg", "")]


def test_photo_table_names_times_and_culls(table):
    sheets = table([("2024-01-01", "a", "EEK 2", "LD"), ("2024-01-01", "b", None, "RD"), ("2024-01-01", "c", "CULL", "RD")],
                   "date date, filename string, id_name string, part string")
    meta = table([("a.jpg", "/t/20240101/a.jpg", "2024:01:01 08:00:00"), ("b.jpg", "/t/20240202/b.jpg", "2024:01:01 09:00:00")], META)
    from wakeline.sources.files import describe_paths

    listed = describe_paths(meta.select(F.col("source_file").alias("path")))
    got = photos.photo_table(sheets, meta, listed, "Dusky")
    assert rows_of(got, "filename", "id_name", "ts", "survey_area") == [
        ("a", "EEK-THE-CAT", dt.datetime(2024, 1, 1, 8), "DUSKY"), ("b", "UNMA", None, "DUSKY")]


def test_duplicate_frames_keep_the_named_one(table):
    rows = table([("2024-01-01 00:00:00", "f", ""), ("2024-01-01 00:00:00", "f", "A"), ("2024-01-01 00:00:00", "g", "")],
                 "ts timestamp_ntz, filename string, name string")
    assert rows_of(photos.resolve_duplicates(rows), "filename", "name") == [("f", "A"), ("g", "")]


def test_report_texts(table):
    est = table([(2021, "Dusky", 121, 120, 122), (2020, "Dusky", 1, 1, 1)], "year int, pod string, est int, lcl int, ucl int")
    assert reports.population_text(est, "Dusky").first().popsent == "2021: 121 (95% CI = 120--122)"
    crew = table([("Ann", "Van Dyk", "Uni")], "first string, last string, organization string")
    assert reports.crew_lines(crew).first().crew_line == "Ann Van Dyk, Uni"


def test_regions(table):
    rows = [(-45.0, 166.5), (-45.2, 166.5), (-45.4, 167.0), (-45.6, 166.5)]
    track = table([(f"2023-01-0{i + 1}", la, lo) for i, (la, lo) in enumerate(rows)], "date date, latitude double, longitude double")
    seen = table([("NANCY", "2023-01-01", "A", 1), ("NANCY", "2023-01-01", "B", 2), ("DUSKY", "2023-02-01", "UNMA", 1)],
                 "survey_area string, date date, id_name string, group int")
    got = reports.regional_report(seen, track, 2023)
    assert rows_of(got, "region", "survey_days", "encounter_days", "sightings") == [("middle", 2, 0, 0), ("northern", 1, 1, 2), ("southern", 2, 0, 0)]
    fixed = reports.regional_report(seen, track, 2023, southern="south")
    assert ("southern", 2) in rows_of(fixed, "region", "survey_days")


def test_photo_metadata_is_made_once(spark, tmp_path):
    """The query's sheets, times and paths read written rows; the line items are not read for each of them."""
    from wakeline.queries import QUERIES, load_all

    load_all()
    rows = [(1, 5, 7, 1, "A", dt.datetime(2024, 1, 2)), (1, 5, 7, 1, "A", dt.datetime(2024, 1, 2)), (2, 40, 7, 3, "R", dt.datetime(2024, 1, 3))]
    items = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_returnflag string, l_shipdate timestamp_ntz")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["photo_table"](spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if "lineitem" in f]
    assert rows_of(got, "id_name", "filename", "ts") == [("ID5 ", "ID5 and KO7 l IMG_0001", dt.datetime(2024, 1, 2))]
