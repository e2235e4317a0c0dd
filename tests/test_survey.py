"""Hand-worked trip tables."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows_of
from wakeline.plans import layers, survey
from wakeline.plans.compiled import compile_survey

DAY = "2024-01-01"
LOG = "device_id string, ts timestamp_ntz, effort string, event_type string, encounter_type string, permit string, species string, platform string"


def at(clock):
    return f"{DAY} {clock}:00"


def log(table, rows):
    """(device, clock, effort, event, type, permit, species, platform) rows."""
    full = [(r[0], at(r[1]), *r[2:], *[""] * (8 - len(r))) for r in rows]
    return table(full, LOG).withColumn("date", F.to_date("ts"))


def fixes(table, rows):
    df = table([(d, at(c), -45.5, 166.5 + i / 100) for i, (d, c) in enumerate(rows)],
               "device_id string, ts timestamp_ntz, latitude double, longitude double")
    return df.withColumn("date", F.to_date("ts"))


def test_nearest_fix_per_device(table):
    tracks = table(
        [("d", "2024-01-01 00:00:00", 1.0, 1.0), ("d", "2024-01-01 00:00:10", 2.0, 2.0)],
        "device_id string, ts timestamp_ntz, latitude double, longitude double",
    )
    times = ["2023-12-31 23:59:55", "2024-01-01 00:00:04", "2024-01-01 00:00:05", "2024-01-01 00:00:06", "2024-01-01 00:01:39"]
    marks = table([("d", x, i) for i, x in enumerate(times)] + [("e", times[0], 9)], "device_id string, ts timestamp_ntz, i int")
    got = survey.locate_sightings(marks, tracks)
    assert rows_of(got, "i", "latitude") == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 2.0), (9, None)]


def test_duplicate_times_keep_one_position(table):
    tracks = table(
        [("d", DAY, "10:00:00", 2.0, 9.0), ("d", DAY, "10:00:00", 1.0, 9.0), ("d", DAY, "10:00:01", 3.0, 9.0)],
        "device_id string, date string, time string, latitude double, longitude double",
    )
    got = survey.clean_tracks(tracks)
    assert rows_of(got, "ts", "latitude") == [(dt.datetime(2024, 1, 1, 10), 1.0), (dt.datetime(2024, 1, 1, 10, 0, 1), 3.0)]


def test_effort_periods_and_clipping(table):
    marks = log(table, [("d", "08:00", "Effort ON"), ("d", "09:00", "Effort OFF"), ("d", "10:00", "Effort ON"), ("d", "11:00", "Effort OFF")])
    tracks = fixes(table, [("d", "08:30"), ("d", "09:30"), ("d", "10:30"), ("d", "12:00")])
    table_ = survey.survey_table(tracks, survey.locate_sightings(marks, tracks))
    periods = survey.effort_periods(table_)
    assert rows_of(periods, "event", "unpaired") == [(1, False), (2, False)]
    kept = survey.on_effort(table_, periods).where("effort IS NULL")
    assert [(r[0].hour, r[1]) for r in rows_of(kept, "ts", "event")] == [(8, 1), (10, 2)]


def test_events_are_numbered_over_devices_and_odd_tail_is_flagged(table):
    rows = [("b", "08:00", "Effort ON"), ("b", "09:00", "Effort OFF"), ("a", "10:00", "Effort ON"),
            ("a", "11:00", "Effort OFF"), ("a", "12:00", "Effort ON")]
    got = survey.effort_periods(log(table, rows))
    assert rows_of(got, "event", "device_id", "unpaired") == [(1, "a", False), (2, "a", True), (3, "b", False)]


def test_encounter_numbers_species_and_state(table):
    rows = [("d", "08:10", "", "Encounter START", "Initial", "DOC permit", "", "Bow"),
            ("d", "08:40", "", "Encounter END & DATA", "", "", "Bottlenose", "")]
    tracks = fixes(table, [("d", "08:20"), ("d", "08:50")])
    marks = log(table, rows)
    full = survey.survey_table(tracks, survey.locate_sightings(marks, tracks))
    enc = survey.encounters(full)
    assert rows_of(enc, "species", "sighting_number") == [("Bottlenose", 1), ("Bottlenose", 1)]
    state = survey.encounter_state(full, enc)
    got = [(r[0].minute, r[1], r[2], r[3]) for r in rows_of(state, "ts", "encounter_type", "sighting_number", "platform")]
    assert got == [(10, "Initial", 1, "Bow"), (20, "Initial", None, "Bow"), (40, None, 1, "Bow"), (50, None, None, "Bow")]


def test_hours_by_distance_and_permit(table):
    start, end = "Encounter START", "Encounter END & DATA"
    rows = []
    for a, z, kind, permit, what in [("08:00", "08:30", "Initial", "DOC permit", "Bottlenose"),
                                     ("09:00", "09:45", "Initial", "DOC permit", "Bottlenose"),
                                     ("10:00", "11:30", "Follow", "Otago permit", "Bottlenose"),
                                     ("12:00", "13:00", "Initial", "DOC permit", "Common")]:
        rows += [("d", a, "", start, kind, permit, ""), ("d", z, "", end, "", "", what)]
    hours = survey.encounter_hours(survey.encounters(log(table, rows)))
    assert rows_of(hours) == [("100–400", 0.0, 1.5, 1.5), ("<100", 1.2, 0.0, 1.2)]


def test_missing_tracks_are_appended_under_their_own_device(table):
    tracks = fixes(table, [("d", "08:00")])
    marks = log(table, [("d", "08:00", "Effort ON")])
    extra = fixes(table, [("x", "15:00"), ("x", "15:10")]).drop("device_id", "date")
    entries = log(table, [("x", "15:09", "Effort OFF")]).drop("device_id", "date")
    full = survey.survey_table(tracks, survey.locate_sightings(marks, tracks), extra, entries)
    got = rows_of(full, "device_id", "effort", "longitude")
    assert ("MISSING", "Effort OFF", 166.51) in got and len(got) == 4


def test_distance_keeps_to_the_band_and_to_events(table):
    rows = [("d", -45.5, 166.5, 1), ("d", -45.6, 166.5, 1), ("d", -45.6, 166.6, 2), ("d", -45.0, 166.6, 2)]
    df = table([(r[0], f"2024-01-01 08:0{i}:00", *r[1:]) for i, r in enumerate(rows)],
               "device_id string, ts timestamp_ntz, latitude double, longitude double, event int")
    df = df.withColumn("date", F.to_date("ts"))
    got = {r.event: r.dist_nm for r in survey.effort_distance(df, "Dusky").collect()}
    assert abs(got[1] - 6.0) < 0.01 and got[2] == 0.0
    assert survey.track_total(survey.effort_distance(df, "Dusky")).first()[0] == 6.0
    other = {r.event: r.n_fixes for r in survey.effort_distance(df, "Other").collect()}
    assert other == {2: 1}


def test_map_layers_and_extract(table):
    rows = [("d", "08:10", "", "Encounter START", "Initial"), ("d", "08:20", "", "", "Initial"), ("d", "08:50", "", "", None)]
    df = log(table, rows).withColumns({"latitude": F.lit(1.0), "longitude": F.lit(2.0)})
    assert rows_of(survey.map_points(df).groupBy("layer").count()) == [("encounter", 2), ("start", 1), ("track", 3)]
    assert survey.map_points(df).first().popup == "2024-01-01 08:10:00<br> 1.0 2.0"
    assert survey.date_extract(df, "2024-01-02", "2024-01-03").count() == 0


def test_gpx_local_time_distance_and_speed(table):
    points = table(
        [("2022-07-13 22:00:00", -45.5, 166.5), ("2022-07-13 22:30:00", -45.2, 167.0), ("2022-01-13 22:00:00", -45.5, 166.5)],
        "time timestamp_ntz, latitude double, longitude double",
    )
    got = layers.gpx_fixes(points).orderBy("ts").collect()
    assert [r.ts.isoformat(" ") for r in got] == ["2022-01-14 11:00:00", "2022-07-14 10:00:00", "2022-07-14 10:30:00"]
    assert abs(got[1].dist_nm - 27.7798) < 1e-4 and abs(got[1].speed_kts - 2 * got[1].dist_nm) < 1e-9
    assert got[0].dist_nm == 0.0 and got[2].dist_nm is None
    cut = layers.gpx_fixes(points, start="2022-07-14 10:00:00", end="2022-07-14 11:00:00").collect()
    assert [r.ts.minute for r in cut] == [30]


def test_layer_vertices(spark):
    layer = spark.sql("""select 'a' feature_id, -50.0D elevation, array(array(named_struct('x', 1.0D, 'y', 2.0D),
      named_struct('x', 3.0D, 'y', 4.0D))) rings union all select 'b', -200.0D, array(array(named_struct('x', 9.0D, 'y', 9.0D)))""")
    got = layers.layer_extract(layer, F.col("elevation") == -50)
    assert rows_of(got, "feature_id", "part", "seq", "x", "y") == [("a", 0, 0, 1.0, 2.0), ("a", 0, 1, 3.0, 4.0)]


def test_compiled_survey_reads_staged_tables(table):
    tracks = fixes(table, [("d", "08:20"), ("d", "08:50")])
    rows = [("d", "08:00", "Effort ON", "Effort"), ("d", "08:10", "", "Encounter START", "Initial"),
            ("d", "08:40", "", "Encounter END & DATA"), ("d", "09:00", "Effort OFF", "Effort")]
    c = compile_survey(tracks, log(table, rows))
    assert c.state.count() == 6 and c.periods.count() == 1 and c.encounters.count() == 2
    assert all("parquet" in f for f in c.state.inputFiles())
