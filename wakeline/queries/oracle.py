"""Shared SQL: the test tables as survey tables, written independently of the Spark code."""

from __future__ import annotations

FIXES = """
fixes AS (
  SELECT user_id AS device_id, ts, CAST(ts AS DATE) AS date,
         -45.8e0 + (event_id % 3000) / 1e4 AS latitude,
         166.45e0 + (event_id % 5500) / 1e4 AS longitude
  FROM events WHERE event_type IN ('view', 'click')),
tracks AS (
  SELECT * FROM fixes
  QUALIFY row_number() OVER (PARTITION BY device_id, ts ORDER BY latitude, longitude) = 1)"""

LOGS = """
logs AS (
  SELECT user_id AS device_id, ts, CAST(ts AS DATE) AS date,
    CASE WHEN event_type = 'purchase' AND seq % 2 = 1 THEN 'Encounter START'
         WHEN event_type = 'purchase' THEN 'Encounter END & DATA'
         WHEN event_type = 'signup' THEN 'Effort' ELSE 'Observation' END AS event_type,
    CASE WHEN event_type <> 'signup' THEN NULL
         WHEN seq % 2 = 1 THEN 'Effort ON' ELSE 'Effort OFF' END AS effort,
    CASE WHEN event_type = 'purchase' AND seq % 2 = 1
         THEN ['Initial', 'Repeat', 'Follow'][event_id % 3 + 1] END AS encounter_type,
    CASE WHEN event_type = 'purchase' AND seq % 2 = 1
         THEN ['DOC permit', 'Otago permit'][event_id % 2 + 1] END AS permit,
    CASE WHEN event_type = 'purchase' AND seq % 2 = 0
         THEN ['Other', 'Bottlenose', 'Bottlenose'][event_id % 3 + 1] END AS species,
    CASE WHEN event_type = 'error' AND event_id % 4 < 2
         THEN ['Bow', 'Flybridge'][event_id % 2 + 1] END AS platform,
    CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN '1' END AS tawaki,
    CASE WHEN event_type = 'error' THEN nullif(props, '') END AS note
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seq
        FROM events WHERE event_type IN ('signup', 'purchase', 'error')))"""

LOCATED = """
located AS (
  SELECT l.*,
    CASE WHEN a.ts IS NULL OR l.ts - b.ts <= a.ts - l.ts THEN b.latitude ELSE a.latitude END AS latitude,
    CASE WHEN a.ts IS NULL OR l.ts - b.ts <= a.ts - l.ts THEN b.longitude ELSE a.longitude END AS longitude
  FROM logs l
  ASOF LEFT JOIN tracks b ON l.device_id = b.device_id AND l.ts >= b.ts
  ASOF LEFT JOIN tracks a ON l.device_id = a.device_id AND l.ts <= a.ts)"""

# 72-hour bins: the test tables' fixes are hours apart
THINNED = """
thinned AS (
  SELECT device_id, ts, date, latitude, longitude FROM (
    SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY device_id))) // 259200000000 AS bin
    FROM tracks)
  QUALIFY row_number() OVER (PARTITION BY device_id, bin ORDER BY ts, latitude, longitude) = 1)"""

SURVEY = """
survey AS (
  SELECT coalesce(t.device_id, l.device_id) AS device_id, coalesce(t.ts, l.ts) AS ts,
         coalesce(t.date, l.date) AS date, coalesce(t.latitude, l.latitude) AS latitude,
         coalesce(t.longitude, l.longitude) AS longitude, l.event_type, l.effort, l.encounter_type,
         l.permit, l.species, l.platform, l.tawaki, l.note
  FROM thinned t FULL JOIN located l
    ON t.device_id = l.device_id AND t.ts = l.ts AND t.date = l.date
   AND t.latitude = l.latitude AND t.longitude = l.longitude)"""

PERIODS = """
effort_marks AS (
  SELECT *, (row_number() OVER (PARTITION BY device_id ORDER BY ts) - 1) // 2 + 1 AS pair
  FROM (SELECT DISTINCT device_id, ts, date FROM survey WHERE effort LIKE '%Effort%')),
periods AS (
  SELECT row_number() OVER (ORDER BY device_id, pair) AS event, device_id,
         min(ts) AS start, max(ts) AS "end", min(date) AS start_date, max(date) AS end_date,
         count(*) = 1 AS unpaired
  FROM effort_marks GROUP BY device_id, pair)"""

ON_EFFORT = """
effort_rows AS (
  SELECT s.*, p.event FROM survey s JOIN periods p
    ON s.device_id = p.device_id AND s.ts BETWEEN p.start AND p."end" AND NOT p.unpaired)"""

ENCOUNTERS = """
enc AS (
  SELECT * EXCLUDE (pair, species),
    dense_rank() OVER (ORDER BY device_id, pair) AS sighting_number,
    first_value(species IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY ts, event_type
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS species
  FROM (SELECT *, (row_number() OVER (PARTITION BY device_id ORDER BY ts, event_type) - 1) // 2 + 1 AS pair
        FROM effort_rows WHERE event_type LIKE '%Encounter%'))"""

STATE = """
rest AS (
  SELECT r.device_id, r.ts, r.date, r.latitude, r.longitude, r.event_type, r.effort,
    CASE WHEN m.encounter_type IN ('Initial', 'Repeat', 'Follow') THEN m.encounter_type END AS encounter_type,
    r.permit, CAST(NULL AS VARCHAR) AS species, r.platform, r.tawaki, r.note, r.event,
    CAST(NULL AS BIGINT) AS sighting_number
  FROM effort_rows r ASOF LEFT JOIN enc m ON r.device_id = m.device_id AND r.ts >= m.ts
  WHERE r.event_type IS NULL OR r.event_type NOT LIKE '%Encounter%'),
state AS (
  SELECT * EXCLUDE (platform),
    last_value(platform IGNORE NULLS) OVER (ORDER BY device_id, ts, event_type
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS platform
  FROM (SELECT * FROM rest UNION ALL BY NAME SELECT * FROM enc))"""

CAPTURES = """
captures AS (
  SELECT CASE o_orderstatus WHEN 'O' THEN 'DOUBTFUL' WHEN 'F' THEN 'DUSKY' WHEN 'P' THEN 'NANCY' END AS survey_area,
         strftime(o_orderdate, '%Y_%m') AS trip, CAST(o_orderdate AS DATE) AS date,
         year(o_orderdate) AS year,
         year(o_orderdate) + CASE WHEN month(o_orderdate) >= 9 THEN 1 ELSE 0 END AS calfyear,
         CAST(o_orderkey % 5000 AS VARCHAR) AS filename, o_orderpriority AS photographer,
         CAST(o_custkey AS VARCHAR) AS id_name, o_orderkey % 4 AS "group", o_custkey AS custkey
  FROM orders)"""

SEGMENT_CAPTURES = """
seg AS (SELECT captures.*, c_mktsegment AS pod FROM captures JOIN customer ON custkey = c_custkey)"""

LIFE = """
life_raw AS (
  SELECT CAST((c_custkey * 3) % 4500 AS INTEGER) AS entryno, CAST(c_custkey AS VARCHAR) AS name,
         c_name AS code, ['F', 'M', 'X'][c_nationkey % 3 + 1] AS sex,
         CASE WHEN c_custkey % 6 = 1 THEN CAST(c_custkey // 2 AS VARCHAR) END AS mom,
         CASE WHEN c_custkey % 4 <> 0 THEN CAST(lo - c_custkey % 5 AS INTEGER) END AS birth_year,
         CAST(lo AS INTEGER) AS first_year,
         CASE WHEN c_custkey % 17 = 0 THEN CAST(hi AS INTEGER) END AS death_year,
         ['DOUBTFUL', 'DUSKY', 'NANCY'][c_nationkey % 3 + 1] AS survey_area
  FROM customer JOIN (
    SELECT o_custkey, min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi
    FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
first_calves AS (SELECT mom, min(birth_year) AS first_calf FROM life_raw WHERE mom IS NOT NULL GROUP BY mom),
seen AS (
  SELECT id_name, max(calfyear) AS last_calfyear, max(date) AS last_date, min(date) AS first_date
  FROM captures GROUP BY id_name),
life0 AS (
  SELECT CASE WHEN entryno < 2000 THEN 'DOUBTFUL' WHEN entryno < 3000 THEN 'DUSKY'
              WHEN entryno < 4000 THEN 'NORTHERN' END AS pod,
         l.*, f.first_calf, s.first_date, s.last_date, coalesce(l.death_year, s.last_calfyear) AS last_year
  FROM life_raw l LEFT JOIN first_calves f ON f.mom = l.name LEFT JOIN seen s ON s.id_name = l.name),
inutero AS (
  SELECT l.name, max(c.date) AS inutero FROM life0 l JOIN captures c ON c.id_name = l.mom AND c.date < l.first_date
  GROUP BY l.name),
life AS (SELECT life0.*, inutero.inutero FROM life0 LEFT JOIN inutero USING (name))"""


def age_class(year: str, l: str = "l") -> str:
    """Age class of life-history alias ``l`` in SQL expression ``year``."""
    age, known = f"({year} - {l}.birth_year)", f"({year} - {l}.first_year)"
    return f"""CASE
      WHEN {year} < {l}.first_year OR {year} < {l}.birth_year THEN 'NA'
      WHEN {year} > {l}.death_year THEN 'D'
      WHEN {age} >= 9 OR ({l}.birth_year IS NULL AND {known} >= 8) OR {year} >= {l}.first_calf THEN 'A'
      WHEN {age} BETWEEN 3 AND 8 THEN 'S-A' WHEN {age} BETWEEN 1 AND 2 THEN 'J'
      WHEN {age} = 0 THEN 'C' ELSE 'U' END"""


PHOTOS = """
photos AS (
  SELECT l_orderkey || '_' || l_linenumber AS filename, CAST(l_shipdate AS DATE) AS date, l_shipdate AS ts,
    CASE l_suppkey % 40 WHEN 0 THEN 'UNMA' WHEN 1 THEN 'CALF' WHEN 2 THEN 'UK' || l_partkey
      WHEN 3 THEN (l_partkey % 50) || '?' WHEN 4 THEN NULL
      ELSE CAST(l_partkey % 50 AS VARCHAR) END AS id_name,
    l_returnflag AS part
  FROM lineitem)"""

METADATA = """
meta AS (
  SELECT letters || CASE WHEN l_linenumber = 1 THEN ' and KO' || (l_suppkey % 70) ELSE '' END
      || CASE WHEN l_linenumber = 2 THEN ' ''' ELSE '' END
      || CASE l_returnflag WHEN 'A' THEN ' l ' WHEN 'R' THEN ' r ' ELSE ' u ' END
      || 'IMG_' || lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0') || '.NEF' AS file_name,
    '/trip/' || strftime(l_shipdate, '%Y%m%d') || '/Original NEF files/' || letters || '/' AS folder,
    strftime(l_shipdate, '%Y:%m:%d %H:%M:%S') AS datetime_original, CAST(l_shipdate AS TIMESTAMP) AS ts
  FROM (SELECT *, 'ID' || (l_partkey % 90) AS letters FROM lineitem))"""

# junk identities out, one row per individual and day
DAILY = """
alive AS (
  SELECT * FROM (SELECT l.*, {age} AS ageclass FROM life l) WHERE ageclass NOT IN ('NA', 'D')),
days AS (
  SELECT DISTINCT id_name AS name, date FROM photos
  WHERE id_name NOT IN ('', 'CALF', 'UNMA') AND NOT regexp_matches(id_name, '\\?|_|CULL|^UK')),
daily AS (
  SELECT d.name, d.date, a.sex, a.birth_year, a.first_year, a.ageclass
  FROM days d LEFT JOIN alive a ON a.name = d.name)""".replace("{age}", age_class("1998"))


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


TRACK_STEPS = (FIXES, LOGS, LOCATED, THINNED, SURVEY)
EFFORT_STEPS = (*TRACK_STEPS, PERIODS, ON_EFFORT)
STATE_STEPS = (*EFFORT_STEPS, ENCOUNTERS, STATE)
LIFE_STEPS = (CAPTURES, LIFE)


def vincenty(source: str, lon1: str, lat1: str, lon2: str, lat2: str, rounds: int = 8) -> str:
    """CTEs adding ``dist_m`` to ``source``; the last one is named ``measured``."""
    f, a, b = "(1e0 / 298.257222101e0)", "6378137e0", "6356752.3142e0"
    steps = [
        f"""v0 AS (SELECT *, radians({lon2} - {lon1}) AS dl, radians({lon2} - {lon1}) AS lam,
          atan((1 - {f}) * tan(radians({lat1}))) AS u1, atan((1 - {f}) * tan(radians({lat2}))) AS u2
        FROM {source})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""s{i} AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2)
              + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
              sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v{i})"""
        )
        steps.append(
            f"""t{i} AS (SELECT *, atan2(ss, cs) AS sg, cos(u1) * cos(u2) * sin(lam) / nullif(ss, 0) AS sa FROM s{i})"""
        )
        steps.append(
            f"""w{i} AS (SELECT *, 1 - sa * sa AS ca,
              coalesce(cs - 2 * sin(u1) * sin(u2) / nullif(1 - sa * sa, 0), 0) AS cm FROM t{i})"""
        )
        if i < rounds:
            steps.append(
                f"""v{i + 1} AS (SELECT * EXCLUDE (lam, ss, cs, sg, sa, ca, cm, cc),
                  dl + (1 - cc) * {f} * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam
                FROM (SELECT *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS cc FROM w{i}))"""
            )
    steps.append(
        f"""z AS (SELECT *, ca * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS usq FROM w{rounds})"""
    )
    steps.append(
        f"""y AS (SELECT *, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS ba,
          usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS bb FROM z)"""
    )
    steps.append(
        f"""measured AS (SELECT *, CASE
          WHEN {lon1} = {lon2} AND {lat1} = {lat2} THEN 0e0
          ELSE {b} * ba * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1)
            - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) END AS dist_m FROM y)"""
    )
    return ",\n".join(steps)
