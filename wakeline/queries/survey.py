"""Trip tables: tracks, effort, encounters, photographs, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.plans import capture, layers, life, photos as photo, reports, survey
from wakeline.plans.compiled import compile_survey, compile_to_effort
from wakeline.queries import oracle as o, query
from wakeline.sources import bindings as b, files
from wakeline.sources.staging import stage, stage_together

# The test tables' fixes are hours apart: 72-hour bins thin them about as ten
# seconds thin a real track, and spans of thirty days hold a comparable load.
BIN = 72 * 3_600
SPAN = 30 * 86_400
POS = "round(latitude, 6) AS latitude, round(longitude, 6) AS longitude"


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def positions(df):
    return rounded(df, "latitude", "longitude")


def _survey(t):
    fixes, logs = stage_together(tracks=survey.clean_tracks(b.fixes(t)), sightings=b.log_entries(t))
    located = survey.locate_sightings(logs, fixes, span_seconds=SPAN)
    return survey.survey_table(survey.thin_tracks(fixes, BIN, SPAN), located)


def _effort(t):
    return compile_to_effort(b.fixes(t), b.log_entries(t), BIN, False, SPAN)


def _compiled(t):
    return compile_survey(b.fixes(t), b.log_entries(t), BIN, False, SPAN)


@query("clean_tracks", o.with_(o.FIXES) + f"SELECT device_id, ts, date, {POS} FROM tracks")
def _(t):
    return positions(survey.clean_tracks(b.fixes(t)))


@query(
    "locate_sightings",
    o.with_(o.FIXES, o.LOGS, o.LOCATED)
    + f"SELECT device_id, ts, event_type, coalesce(effort, '') AS effort, {POS} FROM located",
)
def _(t):
    fixes = survey.clean_tracks(b.fixes(t))
    located = survey.locate_sightings(b.log_entries(t), fixes, span_seconds=SPAN)
    return positions(located.select("device_id", "ts", "event_type", "effort", "latitude", "longitude"))


@query(
    "thin_tracks", o.with_(o.FIXES, o.THINNED) + f"SELECT device_id, ts, date, {POS} FROM thinned"
)
def _(t):
    return positions(survey.thin_tracks(survey.clean_tracks(b.fixes(t)), BIN, SPAN))


SURVEY_COLS = [
    "device_id", "ts", "date", "latitude", "longitude", "event_type", "effort", "encounter_type",
    "permit", "species", "platform", "tawaki", "note",
]
SURVEY_SQL = ", ".join(POS if c == "latitude" else c for c in SURVEY_COLS if c != "longitude")


@query("survey_table", o.with_(*o.TRACK_STEPS) + f"SELECT {SURVEY_SQL} FROM survey")
def _(t):
    return positions(_survey(t)).select(*SURVEY_COLS)


@query(
    "effort_periods",
    o.with_(*o.TRACK_STEPS, o.PERIODS)
    + 'SELECT event, device_id, start, "end", start_date, end_date, unpaired FROM periods',
)
def _(t):
    return survey.effort_periods(stage(survey.effort_marks(_survey(t)), "marks"))


@query(
    "on_effort_rows",
    o.with_(*o.EFFORT_STEPS) + f"SELECT {SURVEY_SQL}, event FROM effort_rows",
)
def _(t):
    return positions(_effort(t)[2]).select(*SURVEY_COLS, "event")


@query(
    "effort_clip",
    o.with_(*o.EFFORT_STEPS)
    + """SELECT r.device_id, r.ts, r.event FROM effort_rows r JOIN periods p
      ON r.event = p.event AND r.device_id = p.device_id
      AND r.date IN (p.start_date, p.end_date) AND r.ts BETWEEN p.start AND p."end" """,
)
def _(t):
    from wakeline.operators.joins import clip_to_periods

    _, periods, rows = _effort(t)
    dated = periods.where(~F.col("unpaired")).select(
        "event", "device_id", "start", "end",
        F.explode(F.array_distinct(F.array("start_date", "end_date"))).alias("date"),
    )
    clipped = clip_to_periods(rows, dated, ["event", "device_id", "date"], "ts", "start", "end")
    return clipped.select("device_id", "ts", "event")


@query(
    "encounters",
    o.with_(*o.EFFORT_STEPS, o.ENCOUNTERS)
    + "SELECT device_id, ts, date, event_type, encounter_type, permit, species, sighting_number, event FROM enc",
)
def _(t):
    marks = stage(survey.encounter_marks(_effort(t)[2]), "marks")
    return survey.encounters(marks).select(
        "device_id", "ts", "date", "event_type", "encounter_type", "permit", "species",
        "sighting_number", "event",
    )


@query(
    "encounter_state",
    o.with_(*o.STATE_STEPS)
    + "SELECT device_id, ts, event_type, encounter_type, species, platform, sighting_number, event FROM state",
)
def _(t):
    return _compiled(t).state.select(
        "device_id", "ts", "event_type", "encounter_type", "species", "platform",
        "sighting_number", "event",
    )


@query(
    "taxon_extract",
    o.with_(*o.STATE_STEPS) + f"SELECT ts, date, {POS}, tawaki, note FROM state WHERE tawaki IS NOT NULL",
)
def _(t):
    return positions(survey.observations(_compiled(t).state, "tawaki"))


@query(
    "effort_distance",
    o.with_(*o.EFFORT_STEPS)
    + """, legs AS (SELECT *, lag(latitude) OVER w AS lat2, lag(longitude) OVER w AS lon2
        FROM effort_rows WHERE latitude BETWEEN -45.82 AND -45.48
        WINDOW w AS (PARTITION BY date, event ORDER BY ts, latitude, longitude)), """
    + o.vincenty("legs", "longitude", "latitude", "lon2", "lat2")
    + """SELECT date, event, round(coalesce(sum(dist_m / 1852e0), 0), 4) AS dist_nm, count(*) AS n_fixes
      FROM measured GROUP BY date, event""",
)
def _(t):
    return rounded(survey.effort_distance(_effort(t)[2], "Dusky"), "dist_nm", places=4)


@query(
    "encounter_hours",
    o.with_(*o.EFFORT_STEPS, o.ENCOUNTERS)
    + """, filled AS (SELECT * EXCLUDE (permit, encounter_type),
        last_value(permit IGNORE NULLS) OVER w AS permit,
        last_value(encounter_type IGNORE NULLS) OVER w AS encounter_type FROM enc
        WINDOW w AS (ORDER BY device_id, ts, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      timed AS (SELECT sighting_number, encounter_type, permit,
          (epoch_us(min(ts) FILTER (event_type = 'Encounter END & DATA'))
           - epoch_us(min(ts) FILTER (event_type = 'Encounter START'))) / 6e7 AS minutes
        FROM filled WHERE species = 'Bottlenose' GROUP BY sighting_number, encounter_type, permit),
      hours AS (SELECT CASE WHEN encounter_type = 'Follow' THEN '100–400' ELSE '<100' END AS distance, permit,
          round_even(coalesce(sum(minutes), 0) / 60, 1) AS h FROM timed GROUP BY 1, 2)
      SELECT distance, coalesce(sum(h) FILTER (permit = 'DOC permit'), 0) AS doc,
        coalesce(sum(h) FILTER (permit = 'Otago permit'), 0) AS otago,
        round(coalesce(sum(h) FILTER (permit = 'DOC permit'), 0)
          + coalesce(sum(h) FILTER (permit = 'Otago permit'), 0), 4) AS total_hours
      FROM hours GROUP BY distance""",
)
def _(t):
    marks = stage(survey.encounter_marks(_effort(t)[2]), "marks")
    return rounded(survey.encounter_hours(survey.encounters(marks)), "total_hours", places=4)


@query(
    "map_points",
    o.with_(*o.STATE_STEPS)
    + f"""SELECT layer, date, ts, {POS}, species,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_text
      FROM (SELECT *, unnest(['track']
        || CASE WHEN encounter_type IS NOT NULL OR event_type = 'Encounter END & DATA' THEN ['encounter'] ELSE [] END
        || CASE WHEN event_type = 'Encounter START' AND encounter_type = 'Initial' THEN ['start'] ELSE [] END) AS layer
        FROM state)""",
)
def _(t):
    points = survey.map_points(_compiled(t).state)
    text = F.substring_index("popup", "<", 1)
    return positions(points.withColumn("at_text", text).drop("popup"))


@query(
    "date_extract",
    o.with_(*o.TRACK_STEPS)
    + f"SELECT {SURVEY_SQL} FROM survey WHERE date BETWEEN DATE '2024-01-04' AND DATE '2024-01-14'",
)
def _(t):
    return positions(survey.date_extract(_survey(t), "2024-01-04", "2024-01-14")).select(*SURVEY_COLS)


# --- photographs ---------------------------------------------------------------------------


@query(
    "photo_table",
    o.with_(o.METADATA)
    + """SELECT id_name, part, filename, date, ts, 'DUSKY' AS survey_area FROM (
      SELECT s.filename, s.date, s.part, m.ts,
        CASE WHEN s.id_name LIKE '%EEK%' THEN 'EEK-THE-CAT' WHEN s.id_name LIKE '%JOLLY%' THEN 'JOLLY-GOOD'
             ELSE s.id_name END AS id_name
      FROM (SELECT left(file_name, length(file_name) - 4) AS filename, CAST(ts AS DATE) AS date, part,
              coalesce(id_name, 'UNMA') AS id_name FROM (
              SELECT DISTINCT file_name, ts,
                left(file_name, 2) AS part,
                CASE WHEN file_name LIKE 'ID1%' THEN 'EEK' || left(file_name, 4)
                     WHEN file_name LIKE 'ID2%' THEN 'JOLLY' WHEN file_name LIKE 'ID3%' THEN NULL
                     WHEN file_name LIKE 'ID4%' THEN 'CULL' ELSE left(file_name, 4) END AS id_name
              FROM meta)) s
      LEFT JOIN (SELECT DISTINCT left(file_name, length(file_name) - 4) AS filename, ts,
                 CAST(ts AS DATE) AS date FROM meta) m ON m.filename = s.filename AND m.date = s.date
      WHERE s.id_name <> 'CULL')""",
)
def _(t):
    # sheets, times and paths all come of these rows: filters pushed below the distinct would make it anew for each
    meta = stage(b.photo_metadata(t).distinct(), "photo-metadata")
    name = F.col("file_name")
    sheets = meta.select(
        F.left(name, F.length(name) - 4).alias("filename"),
        F.to_date("datetime_original", photo.CAMERA_TIME).alias("date"),
        F.left(name, F.lit(2)).alias("part"),
        F.when(name.startswith("ID1"), F.concat(F.lit("EEK"), F.left(name, F.lit(4))))
        .when(name.startswith("ID2"), "JOLLY")
        .when(name.startswith("ID3"), F.lit(None).cast("string"))
        .when(name.startswith("ID4"), "CULL")
        .otherwise(F.left(name, F.lit(4)))
        .alias("id_name"),
    )
    listed = files.describe_paths(meta.select(F.col("source_file").alias("path")))
    table = photo.photo_table(sheets, meta, listed, "Dusky")
    return table.select("id_name", "part", "filename", "date", "ts", "survey_area")


WINDOWS_SQL = """, windows AS (
  SELECT device_id, sighting_number, min(ts) AS lo, max(ts) AS hi FROM enc GROUP BY 1, 2),
shots AS (SELECT DISTINCT user_id AS device_id, ts, event_id FROM events WHERE event_type = 'view')
"""


def _shots_and_windows(t):
    marks = stage(survey.encounter_marks(_effort(t)[2]), "marks")
    windows = photo.sighting_windows(survey.encounters(marks), ("device_id",))
    shots = t.events.where("event_type = 'view'").select(
        F.col("user_id").alias("device_id"), "ts", "event_id"
    )
    return shots, stage(windows, "windows")


@query(
    "photo_groups",
    o.with_(*o.EFFORT_STEPS, o.ENCOUNTERS)
    + WINDOWS_SQL
    + """SELECT s.device_id, s.ts, s.event_id, w.sighting_number AS "group" FROM shots s
      LEFT JOIN windows w ON w.device_id = s.device_id AND s.ts BETWEEN w.lo AND w.hi""",
)
def _(t):
    shots, windows = _shots_and_windows(t)
    return photo.photo_groups(shots, windows, ("device_id",), bin_seconds=86_400)


@query(
    "interval_join",
    o.with_(*o.EFFORT_STEPS, o.ENCOUNTERS)
    + WINDOWS_SQL
    + """SELECT s.event_id, w.sighting_number FROM shots s
      JOIN windows w ON w.device_id = s.device_id AND s.ts BETWEEN w.lo AND w.hi""",
)
def _(t):
    from wakeline.operators.joins import interval_assign

    shots, windows = _shots_and_windows(t)
    hit = interval_assign(shots, windows, ["device_id"], "ts", "lo", "hi", bin_seconds=86_400)
    return hit.select("event_id", "sighting_number")


@query(
    "interval_keep_unmatched",
    o.with_(*o.EFFORT_STEPS, o.ENCOUNTERS)
    + WINDOWS_SQL
    + """SELECT w.sighting_number IS NOT NULL AS grouped, count(DISTINCT s.event_id) AS n FROM shots s
      LEFT JOIN windows w ON w.device_id = s.device_id AND s.ts BETWEEN w.lo AND w.hi GROUP BY 1""",
)
def _(t):
    shots, windows = _shots_and_windows(t)
    grouped = photo.photo_groups(shots, windows, ("device_id",), bin_seconds=86_400)
    return grouped.groupBy(F.col("group").isNotNull().alias("grouped")).agg(
        F.countDistinct("event_id").alias("n")
    )


@query(
    "photo_count",
    o.with_(o.PHOTOS) + "SELECT count(DISTINCT filename) AS n_photos FROM photos",
)
def _(t):
    return photo.photo_count(b.photos(t))


PARSED_COLS = ["survey_area", "trip", "date", "filename", "ts", "name", "part", "comments", "file_name"]


@query(
    "parse_filenames",
    o.with_(o.METADATA)
    + """, trimmed AS (SELECT *, regexp_replace(file_name, ' ''', '') AS fn FROM meta),
    pairs AS (SELECT *, regexp_replace(regexp_replace(upper(file_name), 'WITH', 'and'), '&', 'and') AS up FROM meta),
    parsed AS (
      SELECT fn, upper(split_part(fn, ' ', 1)) AS name,
        CASE WHEN fn LIKE '%''%' THEN 'Conditional match' ELSE '' END AS comments, ts FROM trimmed
      UNION ALL
      SELECT regexp_replace(up, ' ''', '') AS fn, upper(split_part(regexp_replace(up, ' ''', ''), ' ', 3)) AS name,
        '' AS comments, ts FROM pairs WHERE lower(up) LIKE '% and %')
    SELECT 'DUSKY' AS survey_area, '2006_10' AS trip, CAST(ts AS DATE) AS date,
      fn[length(fn) - 11:length(fn) - 4] AS filename, ts, name,
      CASE fn[length(fn) - 13] WHEN 'l' THEN 'LD' WHEN 'r' THEN 'RD' ELSE fn[length(fn) - 13] END AS part,
      comments, fn AS file_name FROM parsed""",
)
def _(t):
    rows = photo.parse_filenames(b.photo_metadata(t), "post_2008", "Dusky", "2006_10")
    return rows.select(*PARSED_COLS)


def _older_era_sql(fn: str, name: str, frame: str, part_at: int, frame_of_second: str) -> str:
    """Rows of an older naming era: capital part letters, other places for name and frame."""
    return (
        o.with_(o.METADATA)
        + f""", pairs AS (SELECT *, regexp_replace(regexp_replace(upper(file_name), 'WITH', 'and'), '&', 'and') AS up FROM meta),
        parsed AS (
          SELECT {fn} AS fn, {name} AS name, {frame} AS filename,
            CASE WHEN {fn} LIKE '%''%' THEN 'Conditional match' ELSE '' END AS comments, ts FROM meta
          UNION ALL
          SELECT u AS fn, upper(split_part(u, ' ', 3)), {frame_of_second}, '', ts
          FROM (SELECT ts, up, regexp_replace(up, ' \'\'', '') AS u FROM pairs) WHERE lower(up) LIKE '% and %')
        SELECT 'DUSKY' AS survey_area, '2006_10' AS trip, CAST(ts AS DATE) AS date, filename, ts, name,
          CASE fn[length(fn) - {part_at - 1}] WHEN 'L' THEN 'LD' WHEN 'R' THEN 'RD' ELSE fn[length(fn) - {part_at - 1}] END AS part,
          comments, fn AS file_name FROM parsed"""
    )


_TRIMMED = "regexp_replace(file_name, ' \'\'', '')"


@query(
    "parse_filenames_to_2008",
    _older_era_sql(
        _TRIMMED,
        "upper(split_part(substr(file_name, 7), ' ', 1))",
        f"{_TRIMMED}[length({_TRIMMED}) - 11:length({_TRIMMED}) - 4]",
        7,
        "u[length(u) - 11:length(u) - 4]",
    ),
)
def _(t):
    return photo.parse_filenames(b.photo_metadata(t), "to_2008", "Dusky", "2006_10").select(*PARSED_COLS)


@query("parse_filenames_in_2006", _older_era_sql("file_name", "split_part(file_name, ' ', 1)", "file_name", 6, "NULL"))
def _(t):
    return photo.parse_filenames(b.photo_metadata(t), "in_2006", "Dusky", "2006_10").select(*PARSED_COLS)


@query(
    "survey_outside_band",
    o.with_(*o.EFFORT_STEPS)
    + "SELECT device_id, ts, latitude FROM effort_rows WHERE NOT latitude BETWEEN -45.82 AND -45.48",
)
def _(t):
    return survey.for_later_tables(_effort(t)[2], "Other").select("device_id", "ts", "latitude")


@query(
    "resolve_duplicates",
    """WITH frames AS (SELECT l_shipdate AS ts, l_orderkey || '_' || l_linenumber AS filename,
        CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS name, l_partkey FROM lineitem)
      SELECT ts, filename, name, l_partkey FROM frames
      QUALIFY count(*) OVER (PARTITION BY ts, filename) = 1 OR name <> ''""",
)
def _(t):
    flag = F.col("l_returnflag")
    frames = t.lineitem.select(
        F.col("l_shipdate").alias("ts"),
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("filename"),
        F.when(flag == "N", "").otherwise(flag).alias("name"),
        "l_partkey",
    )
    return photo.resolve_duplicates(frames)


@query(
    "raw_to_jpg_path",
    o.with_(o.METADATA)
    + """SELECT folder || file_name AS source_file,
        replace(folder, 'Original NEF files/', '') || replace(file_name, '.NEF', '.jpg') AS jpg_filename, ts FROM meta""",
)
def _(t):
    return photo.raw_to_jpg(b.photo_metadata(t))


# --- other receivers and layers ---------------------------------------------------------------

ZONE_SQL = "CAST(timezone('Pacific/Auckland', timezone('UTC', ts)) AS TIMESTAMP)"


@query(
    "gpx_fixes",
    "WITH "
    + """pts AS (SELECT user_id, ts, -45.8e0 + (event_id % 3000) / 1e4 AS latitude,
        166.45e0 + (event_id % 5500) / 1e4 AS longitude FROM events),
      legs AS (SELECT *, lead(latitude) OVER w AS lat2, lead(longitude) OVER w AS lon2, lead(ts) OVER w AS t2
        FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY ts, latitude, longitude)), """
    + o.vincenty("legs", "longitude", "latitude", "lon2", "lat2")
    + f""", local AS (SELECT *, {ZONE_SQL} AS lts FROM measured)
      SELECT user_id, lts AS ts, CAST(lts AS DATE) AS date, round(latitude, 6) AS latitude,
        round(longitude, 6) AS longitude, round(dist_m / 1852e0, 5) AS dist_nm,
        round(dist_m / 1852e0 / nullif((epoch_us(t2) - epoch_us(ts)) / 1e6, 0) * 3600, 5) AS speed_kts
      FROM local WHERE lts > TIMESTAMP '2024-01-04 14:00:00' AND lts < TIMESTAMP '2024-01-20 15:30:00'""",
)
def _(t):
    n = F.col("event_id")
    points = t.events.select(
        "user_id",
        F.col("ts").alias("time"),
        (F.lit(-45.8) + (n % 3000) / 10000.0).alias("latitude"),
        (F.lit(166.45) + (n % 5500) / 10000.0).alias("longitude"),
    )
    rows = layers.gpx_fixes(
        points, start="2024-01-04 14:00:00", end="2024-01-20 15:30:00", by=["user_id"], span_seconds=SPAN
    )
    return rounded(positions(rows), "dist_nm", "speed_kts", places=5)


def _layer(t):
    """Parts as map features: a ring of vertices per feature, attributes from the part."""
    ring = F.transform(
        F.sequence(F.lit(0), F.col("p_size") % 5 + 2),
        lambda i: F.struct(
            ((F.col("p_partkey") + i) % 360).cast("double").alias("x"),
            ((F.col("p_size") + i) % 90).cast("double").alias("y"),
        ),
    )
    return t.part.select(
        F.col("p_partkey").alias("feature_id"),
        F.col("p_type").alias("section"),
        (-50 * (1 + F.col("p_size") % 4)).cast("double").alias("elevation"),
        F.array(ring, F.reverse(ring)).alias("rings"),
    )


LAYER_SQL = """WITH verts AS (
  SELECT p_partkey AS feature_id, p_type AS section, CAST(-50 * (1 + p_size % 4) AS DOUBLE) AS elevation,
    unnest(range(0, p_size % 5 + 3)) AS i, p_partkey, p_size, p_size % 5 + 2 AS last FROM part),
allv AS (
  SELECT feature_id, section, elevation, part, CAST(CASE WHEN part = 0 THEN i ELSE last - i END AS INTEGER) AS seq,
    CAST((p_partkey + i) % 360 AS DOUBLE) AS x, CAST((p_size + i) % 90 AS DOUBLE) AS y
  FROM verts, (VALUES (0), (1)) parts(part))
"""


@query("layer_extract", LAYER_SQL + "SELECT * FROM allv WHERE elevation = -50")
def _(t):
    return layers.layer_extract(_layer(t), F.col("elevation") == -50)


@query(
    "vertices", LAYER_SQL + "SELECT feature_id, part, seq, x, y FROM allv"
)
def _(t):
    from wakeline.operators.shape import explode_vertices

    return explode_vertices(_layer(t).select("feature_id", "rings"))


@query(
    "scan_polygons",
    LAYER_SQL
    + "SELECT section, count(*) AS n, round(sum(x), 3) AS sum_x FROM allv WHERE section = 'ECONOMY' GROUP BY section",
)
def _(t):
    layer = stage(_layer(t), "layer").where("section = 'ECONOMY'")
    verts = layers.layer_extract(layer, F.lit(True))
    return verts.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sum_x"))


@query(
    "trip_summary",
    o.with_(*o.STATE_STEPS, *o.LIFE_STEPS, o.PHOTOS, o.DAILY)
    + """, legs AS (SELECT *, lag(latitude) OVER w AS lat2, lag(longitude) OVER w AS lon2
        FROM effort_rows WINDOW w AS (PARTITION BY date, event ORDER BY ts, latitude, longitude)), """
    + o.vincenty("legs", "longitude", "latitude", "lon2", "lat2")
    + """SELECT (SELECT count(DISTINCT date) FROM state) AS survey_days,
      (SELECT count(DISTINCT date) FROM state WHERE event_type LIKE '%Encounter%') AS encounter_days,
      (SELECT max(sighting_number) FROM state) AS sightings,
      (SELECT strftime(min(start_date), '%d %b %Y') FROM periods) AS trip_start,
      (SELECT strftime(max(end_date), '%d %b %Y') FROM periods) AS trip_end,
      (SELECT strftime(max(end_date) - INTERVAL 1 YEAR, '%d %b %Y') FROM periods) AS recent,
      (SELECT strftime(max(end_date) - INTERVAL 2 YEAR, '%d %b %Y') FROM periods) AS older,
      (SELECT count(DISTINCT filename) FROM photos) AS photos,
      (SELECT count(DISTINCT name) FROM daily) AS individuals,
      (SELECT round_even(sum(dist_m / 1852e0), 0) FROM measured
        WHERE NOT (latitude BETWEEN -45.82 AND -45.48)) AS track_dist""",
)
def _(t):
    c = _compiled(t)
    history = life.life_history(b.life_table(t), b.captures(t))
    daily = capture.daily_captures(b.photos(t), life.alive_at(history, 1998))
    distance = stage(survey.effort_distance(c.effort), "distance")
    return reports.trip_summary(c.state, b.photos(t), daily, distance, c.periods)
