"""Life histories, capture histories, censuses and the yearly reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.plans import capture, life, reports
from wakeline.queries import oracle as o, query
from wakeline.queries.survey import rounded
from wakeline.sources import bindings as b
from wakeline.sources.staging import stage

YEAR = 1998
FIRST, LAST = 1995, 2001


def _history(t):
    """The life history, written once: reports read it several times."""
    return stage(life.life_history(b.life_table(t), b.captures(t)), "life")


def _alive(t, year=YEAR):
    return life.alive_at(_history(t), year)


def _daily(t):
    return capture.daily_captures(b.photos(t), _alive(t))


LIFE = o.with_(*o.LIFE_STEPS)
DAILY = o.with_(*o.LIFE_STEPS, o.PHOTOS, o.DAILY)
LONG = f""", years AS (SELECT unnest(range({FIRST}, {LAST + 1})) AS y),
long AS (SELECT l.*, CAST(y AS INTEGER) AS year, {o.age_class("y")} AS ageclass FROM life l, years)
"""


# --- life history --------------------------------------------------------------------------


@query("pod_of_entry", LIFE + "SELECT name, pod FROM life0")
def _(t):
    return life.with_pod(b.life_table(t)).select("name", "pod")


@query(
    "life_history",
    LIFE
    + """SELECT pod, name, code, sex, mom, first_calf, birth_year, inutero, first_year, first_date,
      death_year, last_year, last_date FROM life""",
)
def _(t):
    return _history(t)


@query("age_class", LIFE + LONG + "SELECT name, year, ageclass FROM long")
def _(t):
    return life.age_class(_history(t), FIRST, LAST).select("name", "year", "ageclass")


@query(
    "age_at_first_calf",
    LIFE
    + """, aged AS (SELECT *, first_calf - birth_year AS primo_age FROM life WHERE first_calf IS NOT NULL AND birth_year IS NOT NULL)
      SELECT name, pod, first_calf, birth_year, inutero, primo_age, round(avg(primo_age) OVER (), 6) AS avg_primo_age,
        min(primo_age) OVER () AS min_primo_age, max(primo_age) OVER () AS max_primo_age FROM aged""",
)
def _(t):
    return rounded(life.primiparity(_history(t)), "avg_primo_age")


@query(
    "last_seen_by_year",
    LIFE
    + LONG
    + """SELECT pod, last_year AS last_seen_year, CASE WHEN ageclass = 'NA' THEN 'C' ELSE ageclass END AS ageclass, n
      FROM (SELECT pod, last_year, ageclass, count(DISTINCT name) AS n FROM long
            WHERE last_year = year AND last_year >= 1996 GROUP BY pod, last_year, ageclass)""",
)
def _(t):
    return life.last_seen(life.age_class(_history(t), FIRST, LAST), 1996)


@query(
    "last_seen_list",
    LIFE
    + LONG
    + f"""SELECT pod, name, sex, {YEAR + 1} - birth_year AS age, {YEAR + 1} - first_year AS at_least_age,
      first_year, last_date, ageclass FROM long WHERE year(last_date) = year AND year = {YEAR}""",
)
def _(t):
    return life.last_seen_list(life.age_class(_history(t), FIRST, LAST), YEAR + 1)


def _composition_sql(by):
    return (
        LIFE
        + f""", who AS (SELECT DISTINCT id_name AS name FROM captures WHERE year = {YEAR}),
      rows AS (SELECT pod, sex, {YEAR} AS year, CASE WHEN cls = 'NA' AND first_year = {YEAR} THEN 'C' ELSE cls END AS ageclass
        FROM (SELECT l.*, {o.age_class(str(YEAR))} AS cls FROM who LEFT JOIN life l USING (name)))
      SELECT pod, year, {by}, n, CAST(sum(n) OVER (PARTITION BY pod) AS BIGINT) AS n_tot,
        round(n / sum(n) OVER (PARTITION BY pod), 6) AS prop
      FROM (SELECT pod, year, {by}, count(*) AS n FROM rows GROUP BY ALL)"""
    )


@query("year_composition", _composition_sql("ageclass"))
def _(t):
    return rounded(life.composition(_history(t), b.captures(t), YEAR), "prop")


@query("share_of_total", _composition_sql("sex"))
def _(t):
    return rounded(life.composition(_history(t), b.captures(t), YEAR, "sex"), "prop")


BIRTHS = """, counted AS (SELECT pod, birth_year, count(DISTINCT name) AS n FROM life WHERE birth_year >= 1994 GROUP BY ALL)
"""


@query(
    "births_per_year",
    LIFE
    + BIRTHS
    + """SELECT p.pod, y.birth_year, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT pod FROM counted) p
      CROSS JOIN (SELECT DISTINCT birth_year FROM counted) y
      LEFT JOIN counted c ON c.pod = p.pod AND c.birth_year = y.birth_year""",
)
def _(t):
    return life.births(_history(t), 1994)


@query(
    "catalogue_size",
    LIFE + f"SELECT survey_area, count(*) AS n FROM life_raw WHERE first_year <= {YEAR} GROUP BY survey_area",
)
def _(t):
    return life.catalogue_size(life.normalise_life(b.life_table(t)), "survey_area", YEAR)


IMAGES = """, images AS (
  SELECT split_part(regexp_extract(path, '[^/]+$'), '_', 1) AS name,
    nullif(regexp_extract(path, '\\b\\w{2}\\b'), '') AS part, nullif(regexp_extract(path, '\\b\\w{5}\\b'), '') AS type, path
  FROM (SELECT DISTINCT '/x/' || CASE l_returnflag WHEN 'A' THEN 'LD' WHEN 'R' THEN 'RD' ELSE 'misc' END
      || '/angle/' || (l_partkey % 400) || '_' || (l_suppkey % 3) || '.jpg' AS path FROM lineitem))
"""


def _images(t):
    side = F.when(F.col("l_returnflag") == "A", "LD").when(F.col("l_returnflag") == "R", "RD").otherwise("misc")
    path = F.concat(
        F.lit("/x/"), side, F.lit("/angle/"), (F.col("l_partkey") % 400).cast("string"),
        F.lit("_"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".jpg"),
    )
    return life.catalogue_images(t.lineitem.select(path.alias("path")).distinct())


@query("catalogue_images", o.with_(*o.LIFE_STEPS) + IMAGES + "SELECT * FROM images")
def _(t):
    return _images(t)


@query(
    "catalogue_cards",
    LIFE
    + IMAGES
    + f""", sides AS (SELECT name,
        min(path) FILTER (part = 'LD' AND type IS NOT NULL) AS left_image,
        count(*) FILTER (part = 'LD' AND type IS NOT NULL) AS n_left,
        min(path) FILTER (part = 'RD' AND type IS NOT NULL) AS right_image,
        count(*) FILTER (part = 'RD' AND type IS NOT NULL) AS n_right FROM images GROUP BY name),
      brood AS (SELECT mom, list(DISTINCT name ORDER BY name) AS c FROM life WHERE mom IS NOT NULL GROUP BY mom)
      SELECT s.name, coalesce(l.code, '') AS code, coalesce(l.sex, '') AS sex,
        CASE WHEN l.name IS NULL THEN '' ELSE {o.age_class(str(YEAR))} END AS ageclass, coalesce(l.mom, '') AS mom,
        coalesce(CAST(l.birth_year AS VARCHAR), '') AS birth_year, coalesce(CAST(l.first_year AS VARCHAR), '') AS first_year,
        coalesce(CAST(l.last_year AS VARCHAR), '') AS last_year,
        CASE WHEN l.sex = 'F' THEN CASE WHEN c IS NULL THEN 'NA' WHEN len(c) = 1 THEN c[1]
          ELSE array_to_string(c[1:len(c) - 1], ', ') || ' and ' || c[len(c)] END ELSE '' END AS calves,
        coalesce(left_image, 'noimageavail.jpg') AS left_image, n_left,
        coalesce(right_image, 'noimageavail.jpg') AS right_image, n_right
      FROM sides s LEFT JOIN life l USING (name) LEFT JOIN brood ON brood.mom = s.name""",
)
def _(t):
    return life.catalogue_cards(_history(t), _images(t), YEAR)


# --- daily captures -------------------------------------------------------------------------


@query(
    "daily_captures",
    DAILY + "SELECT name, date, sex, birth_year, first_year, ageclass FROM daily",
)
def _(t):
    return _daily(t)


@query(
    "capture_matrix",
    DAILY
    + """, trip AS (SELECT name, sex, birth_year, first_year, ageclass, CAST(date AS VARCHAR) AS date
        FROM daily WHERE strftime(date, '%Y_%m') = '1998_06')
      SELECT name, sex, birth_year, first_year, ageclass, COLUMNS('-')::INTEGER FROM (PIVOT trip ON date USING count(*))""",
)
def _(t):
    trip = _daily(t).where("date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30'")
    return capture.capture_matrix(trip)


@query(
    "age_sex_table",
    DAILY
    + """SELECT CASE ageclass WHEN 'A' THEN 'Adult' WHEN 'S-A' THEN 'Sub-Adult' WHEN 'J' THEN 'Juvenile'
        WHEN 'C' THEN 'Calf*' WHEN 'U' THEN 'Unknown' END AS age_class,
      count(*) FILTER (sex = 'F') AS F, count(*) FILTER (sex = 'M') AS M, count(*) FILTER (sex = 'X') AS X,
      coalesce(list_position(['A', 'S-A', 'J', 'C', 'U'], ageclass), 6) AS rank
      FROM (SELECT DISTINCT name, sex, ageclass FROM daily) GROUP BY ageclass""",
)
def _(t):
    return capture.age_sex_table(_daily(t))


DISCO = """, firsts AS (SELECT name, min(date) AS a, max(date) AS z FROM daily GROUP BY name),
all_days AS (SELECT DISTINCT date FROM daily UNION SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders),
per_day AS (SELECT d.date, (SELECT count(*) FROM daily x WHERE x.date = d.date) AS ni,
  (SELECT count(*) FROM firsts WHERE a = d.date) AS ui, (SELECT count(*) FROM firsts WHERE z = d.date) AS vi FROM all_days d)
"""


@query(
    "discovery_curve",
    DAILY
    + DISCO
    + """SELECT date, ni, ui, vi, CAST(sum(ui) OVER (ORDER BY date) AS BIGINT) AS disc, dayofyear(date) AS survey,
      row_number() OVER (ORDER BY date) AS "order", year(date) AS year FROM per_day""",
)
def _(t):
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("date"))
    return capture.discovery_curve(_daily(t), days)


@query("capture_frequency", DAILY + "SELECT times, count(*) AS fi FROM (SELECT name, count(DISTINCT date) AS times FROM daily GROUP BY name) GROUP BY times")
def _(t):
    return capture.capture_frequency(_daily(t))


GONE = """, trip AS (SELECT DISTINCT id_name FROM captures WHERE trip = '2001_06'),
gone AS (SELECT a.*, year(last_date) AS ly,
    (CASE WHEN length(name) > 2 THEN upper(name[1]) || lower(name[2:]) ELSE name END) || ' (' || sex || ')' AS name_sex
  FROM (SELECT l.*, {age} AS ageclass FROM life l) a
  WHERE ageclass NOT IN ('NA', 'D') AND name NOT IN (SELECT id_name FROM trip)
    AND last_date < DATE '2000-06-30' AND last_date >= DATE '1999-06-30')
""".replace("{age}", o.age_class("2001"))


def _gone(t):
    trip = b.captures(t).where("trip = '2001_06'").select(F.col("id_name").alias("name"))
    as_of = F.lit("2001-06-30").cast("date")
    return capture.not_seen_recently(_alive(t, 2001), trip, as_of)


@query("not_seen_recently", LIFE + GONE + "SELECT name, name_sex, ly AS last_year, ageclass, last_date FROM gone")
def _(t):
    return _gone(t).select("name", "name_sex", "last_year", "ageclass", "last_date")


@query(
    "not_seen_table",
    LIFE
    + GONE
    + """SELECT ly AS last_year, CASE ageclass WHEN 'A' THEN 'Adult' WHEN 'S-A' THEN 'Sub-Adult' WHEN 'J' THEN 'Juvenile'
        WHEN 'C' THEN 'Calf*' WHEN 'U' THEN 'Unknown' END AS age_class, count(*) FILTER (sex = 'F') AS F,
      count(*) FILTER (sex = 'M') AS M, count(*) FILTER (sex = 'X') AS X FROM gone GROUP BY ly, ageclass""",
)
def _(t):
    return capture.not_seen_table(_gone(t))


# --- seasons and abundance ------------------------------------------------------------------


def _flags_sql(year):
    return (
        o.with_(o.CAPTURES, o.SEGMENT_CAPTURES)
        + f""", seasons AS (SELECT {year} AS year, pod, id_name,
        CASE WHEN m IN (12, 1, 2) THEN 'SUMMER' WHEN m <= 5 THEN 'AUTUMN' WHEN m <= 8 THEN 'WINTER' ELSE 'SPRING' END AS season
        FROM (SELECT *, CAST(trip[6:7] AS INTEGER) AS m FROM seg) WHERE {year} > 1994),
      flags AS (SELECT year, pod, id_name, max(CAST(season = 'WINTER' AS INTEGER)) AS winter,
        max(CAST(season = 'SPRING' AS INTEGER)) AS spring, max(CAST(season = 'AUTUMN' AS INTEGER)) AS autumn,
        max(CAST(season = 'SUMMER' AS INTEGER)) AS summer FROM seasons GROUP BY ALL),
      has AS (SELECT year, pod, max(winter) AS w, max(spring) AS s, max(autumn) AS a, max(summer) AS u FROM flags GROUP BY ALL),
      ns AS (SELECT f.year, f.pod, f.id_name, CASE WHEN w = 1 THEN winter ELSE 999 END AS winter,
        CASE WHEN s = 1 THEN spring ELSE 999 END AS spring, CASE WHEN a = 1 THEN autumn ELSE 999 END AS autumn,
        CASE WHEN u = 1 THEN summer ELSE 999 END AS summer FROM flags f JOIN has USING (year, pod))
      """
    )


CALENDAR_BOTH = """CASE WHEN winter <> 999 AND spring <> 999 AND winter + spring = 2 THEN 1
  WHEN winter = 999 AND spring <> 999 AND autumn <> 999 AND autumn + spring = 2 THEN 1
  WHEN winter <> 999 AND spring = 999 AND autumn <> 999 AND autumn + winter = 2 THEN 1 ELSE 0 END"""
INITIAL = "CASE WHEN summer = 1 OR (summer = 999 AND spring = 1) THEN 1 ELSE 0 END"
SECOND = "CASE WHEN winter = 1 OR (winter = 999 AND autumn = 1) THEN 1 ELSE 0 END"
SAMPLES = {
    "calendar": f""", counts AS (SELECT year, pod, count(*) AS n,
        CASE WHEN max(winter) <> 999 THEN sum(winter) WHEN max(autumn) <> 999 THEN sum(autumn) END AS n1,
        CASE WHEN max(spring) <> 999 THEN sum(spring) END AS n2, sum({CALENDAR_BOTH}) AS m2,
        CASE WHEN max(winter) <> 999 THEN 'Winter Spring' ELSE 'Autumn Spring' END AS season FROM ns GROUP BY ALL)""",
    "calfyear": f""", counts AS (SELECT year, pod, count(*) AS n, sum({INITIAL}) AS n1, sum({SECOND}) AS n2,
        sum({INITIAL} * {SECOND}) AS m2, '999' AS season FROM ns GROUP BY year, pod)""",
}
Z = {"reference": "-0.9849639845400538", "normal95": "-1.9599639845400538"}


def _estimate_sql(scheme, ci="reference"):
    label = {"calendar": "Calendar", "calfyear": "Calfyear"}[scheme]
    year = {"calendar": "year", "calfyear": "calfyear"}[scheme]
    if ci == "reference":
        spread = "(CASE WHEN m = 0 THEN 'infinity'::DOUBLE ELSE 1 / m END + 0.5e0)"
        upper = "nhat + (nhat - lcl)"
    else:
        spread = "1 / (m + 0.5e0)"
        upper = "f + g * exp(1.9599639845400538e0 * s)"
    return (
        _flags_sql(year)
        + SAMPLES[scheme]
        + f""", d AS (SELECT *, CAST(n1 AS DOUBLE) AS p, CAST(n2 AS DOUBLE) AS q, CAST(m2 AS DOUBLE) AS m FROM counts
          WHERE n1 IS NOT NULL AND n2 IS NOT NULL),
        e AS (SELECT *, (p + 1) * (q + 1) / (m + 1) - 1 AS nhat,
          sqrt({spread} + 1 / (q - m + 0.5e0) + 1 / (p - m + 0.5e0) + (m + 0.5e0) / ((p - m + 0.5e0) * (q - m + 0.5e0))) AS s,
          p + q - m - 0.5e0 AS f, (q - m + 0.5e0) * (p - m + 0.5e0) / (m + 0.5e0) AS g FROM d),
        g1 AS (SELECT *, f + g * exp({Z[ci]}e0 * s) AS lcl FROM e),
        estimates AS (SELECT year, pod, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(m2 AS BIGINT) AS m2,
          CAST(trunc(nhat) AS BIGINT) AS nhat, CAST(trunc(lcl) AS BIGINT) AS lcl, CAST(trunc({upper}) AS BIGINT) AS ucl,
          '{label}' AS subset, season, n FROM g1)
        """
    )


def _flags(t, scheme="calendar"):
    return capture.season_flags(b.captures_by_segment(t), scheme, after_year=1994)


@query("season_captures", _flags_sql("year") + f"SELECT *, {CALENDAR_BOTH} AS both FROM ns")
def _(t):
    return capture.season_captures(_flags(t))


@query(
    "season_captures_calfyear",
    _flags_sql("calfyear") + f"SELECT *, {INITIAL} AS initial, {SECOND} AS second, {INITIAL} * {SECOND} AS both FROM ns",
)
def _(t):
    return capture.season_captures(_flags(t, "calfyear"), "calfyear")


@query("two_sample_abundance", _estimate_sql("calendar") + "SELECT * FROM estimates")
def _(t):
    return capture.two_sample_abundance(_flags(t))


@query("two_sample_calfyear", _estimate_sql("calfyear") + "SELECT * FROM estimates")
def _(t):
    return capture.two_sample_abundance(_flags(t, "calfyear"), "calfyear")


@query("two_sample_normal95", _estimate_sql("calendar", "normal95") + "SELECT * FROM estimates")
def _(t):
    return capture.two_sample_abundance(_flags(t), ci="normal95")


@query(
    "combined_estimates",
    _estimate_sql("calendar")
    + "SELECT DISTINCT * FROM (SELECT * FROM estimates UNION ALL SELECT * FROM estimates WHERE year < 1998) WHERE n IS NOT NULL",
)
def _(t):
    estimates = capture.two_sample_abundance(_flags(t))
    return capture.combine_estimates(estimates, estimates.where("year < 1998"))


@query(
    "abundance_table",
    _estimate_sql("calendar")
    + "SELECT upper(pod[1]) || lower(pod[2:]) AS pod, year, n1, n2, m2, nhat, lcl || '–' || ucl AS ci95, n FROM estimates",
)
def _(t):
    return reports.abundance_table(capture.two_sample_abundance(_flags(t)))


@query(
    "population_text",
    _estimate_sql("calendar")
    + """SELECT year, pod, year || ': ' || nhat || ' (95% CI = ' || lcl || '--' || ucl || ')' AS popsent
      FROM estimates WHERE pod = 'BUILDING' AND year = (SELECT max(year) FROM estimates)""",
)
def _(t):
    estimates = capture.two_sample_abundance(_flags(t)).withColumnRenamed("nhat", "est")
    return reports.population_text(estimates, "BUILDING")


@query(
    "place_list",
    """SELECT n_regionkey, array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] AS places
      FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey) WHERE len(l) > 1""",
)
def _(t):
    named = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return named.where(F.size("l") > 1).select("n_regionkey", reports.place_list(F.col("l")).alias("places"))


@query(
    "crew_lines",
    "SELECT s_suppkey, s_name || ' ' || n_name || ', ' || r_name AS crew_line FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
)
def _(t):
    home = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    crew = t.supplier.join(home, F.col("s_nationkey") == F.col("n_nationkey"))
    crew = crew.selectExpr("s_suppkey", "s_name AS first", "n_name AS last", "r_name AS organization")
    return reports.crew_lines(crew).select("s_suppkey", "crew_line")


# --- censuses -------------------------------------------------------------------------------

# One hand-listed exclusion, as (individual, year).
EXCLUDE = (("7", 1998),)
KNOWN = LIFE + """, known AS (SELECT c.*, l.pod FROM captures c JOIN life l ON l.name = c.id_name
  WHERE l.pod <> 'NORTHERN'),
kept AS (SELECT * FROM known WHERE calfyear BETWEEN 1995 AND 2001 AND NOT (id_name = '7' AND calfyear = 1998))
"""
YEARS = {"after": 1994, "until": 2001}


@query(
    "census",
    KNOWN
    + """, cy AS (SELECT calfyear, pod, count(DISTINCT id_name) AS n_calfyear FROM kept GROUP BY ALL),
      yr AS (SELECT year, pod, count(DISTINCT id_name) AS n_year FROM known
        WHERE year BETWEEN 1995 AND 2001 AND NOT (id_name = '7' AND year = 1998) GROUP BY ALL)
      SELECT cy.calfyear, cy.pod, n_calfyear, n_year FROM cy LEFT JOIN yr ON yr.year = cy.calfyear AND yr.pod = cy.pod""",
)
def _(t):
    return capture.census(b.captures(t), _history(t), EXCLUDE, **YEARS)


@query(
    "trip_census",
    KNOWN + "SELECT pod, year, trip, count(DISTINCT id_name) AS n FROM known WHERE year BETWEEN 1995 AND 2001 GROUP BY ALL",
)
def _(t):
    return capture.trip_census(b.captures(t), _history(t), **YEARS)


@query(
    "adult_census",
    KNOWN
    + f"""SELECT pod, calfyear, count(DISTINCT id_name) AS n FROM (
        SELECT l.pod, c.calfyear, c.id_name, {o.age_class("c.calfyear")} AS ageclass
        FROM kept c JOIN life l ON l.name = c.id_name WHERE NOT (c.survey_area = 'DUSKY' AND c.calfyear = 1997))
      WHERE ageclass IN ('A', 'U') GROUP BY pod, calfyear""",
)
def _(t):
    return capture.adult_census(b.captures(t), _history(t), EXCLUDE, (("DUSKY", 1997),), **YEARS)


GAPS = KNOWN + """, seen_years AS (SELECT DISTINCT id_name, calfyear FROM known WHERE calfyear BETWEEN 1995 AND 2001),
spread AS (SELECT l.*, y.calfyear, coalesce(l.birth_year,
    l.first_year + CASE WHEN month(l.first_date) >= 9 THEN 1 ELSE 0 END) AS first_birth
  FROM life l JOIN (SELECT DISTINCT id_name FROM seen_years) s ON s.id_name = l.name
  CROSS JOIN (SELECT DISTINCT calfyear FROM seen_years) y),
presence AS (SELECT p.* FROM spread p LEFT JOIN seen_years s ON s.id_name = p.name AND s.calfyear = p.calfyear
  WHERE p.calfyear BETWEEN first_birth AND last_year AND p.calfyear <> 2024
    AND NOT (p.name = '7' AND p.calfyear = 1998)
    AND (s.id_name IS NOT NULL OR p.calfyear <> first_birth))
"""


def _presence(t):
    return capture.presence_years(b.captures(t), _history(t), EXCLUDE, **YEARS, drop_years=(2024,))


@query("gap_filled_census", GAPS + "SELECT pod, calfyear, count(*) AS calfyear_ng FROM presence GROUP BY ALL")
def _(t):
    return capture.gap_filled_census(_presence(t))


@query(
    "gap_filled_comparison",
    GAPS
    + """, cy AS (SELECT calfyear, pod, count(DISTINCT id_name) AS n_calfyear FROM kept GROUP BY ALL),
      yr AS (SELECT year, pod, count(DISTINCT id_name) AS n_year FROM known
        WHERE year BETWEEN 1995 AND 2001 AND NOT (id_name = '7' AND year = 1998) GROUP BY ALL)
      SELECT g.pod, g.calfyear, g.calfyear_ng, n_calfyear, n_year
      FROM (SELECT pod, calfyear, count(*) AS calfyear_ng FROM presence GROUP BY ALL) g
      LEFT JOIN cy ON cy.pod = g.pod AND cy.calfyear = g.calfyear
      LEFT JOIN yr ON yr.pod = cy.pod AND yr.year = cy.calfyear""",
)
def _(t):
    counted = capture.census(b.captures(t), _history(t), EXCLUDE, **YEARS)
    return capture.compare_census(capture.gap_filled_census(_presence(t)), counted)


@query(
    "sex_age_gap_census",
    GAPS
    + f"""SELECT pod, CASE WHEN sex = 'F' THEN 'F' ELSE 'M_U' END AS sex_assume, calfyear, ageclass, count(*) AS n
      FROM (SELECT l.*, {o.age_class("l.calfyear")} AS ageclass FROM presence l) WHERE ageclass IN ('A', 'U') GROUP BY ALL""",
)
def _(t):
    return capture.gap_filled_by_sex(_presence(t))


EFFORT = o.with_(o.CAPTURES) + """, shots AS (SELECT DISTINCT survey_area, calfyear, date, filename, photographer FROM captures
  WHERE id_name <> 'CULL' AND calfyear < 2024 AND survey_area IN ('DOUBTFUL', 'DUSKY')
    AND NOT (survey_area = 'DUSKY' AND calfyear = 1997)),
effort AS (SELECT survey_area AS pod, calfyear, count(*) AS n FROM shots GROUP BY ALL)
"""


def _photo_effort(t):
    return capture.photo_effort(b.captures(t), ("DOUBTFUL", "DUSKY"), 2024, (("DUSKY", 1997),))


@query("photo_effort", EFFORT + "SELECT * FROM effort")
def _(t):
    return _photo_effort(t)


@query(
    "photo_effort_range",
    EFFORT + "SELECT pod, min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS mean_n FROM effort GROUP BY pod",
)
def _(t):
    return rounded(capture.photo_effort_range(_photo_effort(t)), "mean_n")


# --- reports --------------------------------------------------------------------------------


def _log(t):
    """Orders as a trip log: a day-month-year start, an end ten days later."""
    text = lambda c: F.date_format(c, "d-M-yyyy")
    day = F.col("o_orderdate").cast("date")
    area = b.area_of_status(F.col("o_orderstatus"))
    return t.orders.select(
        area.alias("fiord"),
        F.year(day).alias("year"),
        F.col("o_orderpriority").alias("season"),
        F.col("o_orderkey").cast("string").alias("folder"),
        text(day).alias("start_date"),
        text(F.date_add(day, 10)).alias("end_date"),
        F.when(F.col("o_orderkey") % 9 == 0, "MISSING").otherwise("").alias("photos"),
        F.when(F.col("o_orderkey") % 11 == 0, "PEMBROKE").otherwise("OTHER").alias("vessel"),
    )


@query(
    "trip_timeline",
    """WITH log AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'DOUBTFUL' WHEN 'F' THEN 'DUSKY' ELSE 'NANCY' END AS fiord,
        year(o_orderdate) AS year, o_orderpriority AS season, CAST(o_orderkey AS VARCHAR) AS folder,
        CASE WHEN o_orderkey % 9 = 0 THEN 'MISSING' ELSE '' END AS photos, CAST(o_orderdate AS DATE) AS d
        FROM orders WHERE o_orderkey % 11 <> 0 AND year(o_orderdate) >= 1996),
      ends AS (SELECT *, 'start_date' AS start_end, d AS date FROM log
        UNION ALL SELECT *, 'end_date', d + 10 FROM log)
      SELECT fiord, year, season, folder, photos, start_end, date, dayofyear(date) AS ordinal, strftime(date, '%d-%b') AS moda,
        fiord || folder AS tripid, year + CASE WHEN month(date) >= 9 THEN 1 ELSE 0 END AS calfyear,
        dayofyear(date) - 244 AS sep_start FROM ends""",
)
def _(t):
    return reports.timeline(_log(t), since=1996, fiords=reports.FIORDS, exclude_vessels=("PEMBROKE",))


@query(
    "effort_table",
    o.with_(o.CAPTURES)
    + f""", days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE year(l_shipdate) = {YEAR}),
      trips AS (SELECT DISTINCT date, survey_area, trip FROM captures),
      effort AS (SELECT survey_area, trip, count(*) AS effort_days,
          strftime(min(date), '%d %b') || '–' || strftime(max(date), '%d %b') AS date_range
        FROM days JOIN trips USING (date) GROUP BY ALL),
      seen AS (SELECT survey_area, trip, count(DISTINCT date) AS sighting_days, count(DISTINCT id_name) AS individuals
        FROM captures WHERE year = {YEAR} GROUP BY ALL)
      SELECT upper(survey_area[1]) || lower(survey_area[2:]) AS survey_area, trip,
        CASE WHEN trip[6:7] IN ('12', '01', '02') THEN 'Summer' WHEN trip[6:7] <= '05' THEN 'Autumn'
             WHEN trip[6:7] <= '08' THEN 'Winter' ELSE 'Spring' END AS season,
        date_range, effort_days, sighting_days, individuals FROM effort LEFT JOIN seen USING (survey_area, trip)""",
)
def _(t):
    caps = b.captures(t)
    days = t.lineitem.select(F.col("l_shipdate").cast("date").alias("date"))
    trips = caps.select("date", "survey_area", "trip").distinct()
    return reports.effort_table(days, trips, caps, YEAR)


@query(
    "area_individuals",
    o.with_(o.CAPTURES) + f"SELECT DISTINCT survey_area, id_name FROM captures WHERE year = {YEAR}",
)
def _(t):
    return reports.individuals(b.captures(t), YEAR)


REGION = f""", ident AS (SELECT *, CASE survey_area WHEN 'NANCY' THEN 'northern' WHEN 'DOUBTFUL' THEN 'middle' ELSE 'southern' END AS region
  FROM captures WHERE year = {YEAR} AND id_name NOT IN ('CULL', 'UNMA', ''))
"""


def _positions(t):
    k = F.col("l_partkey")
    return t.lineitem.select(
        F.col("l_shipdate").cast("date").alias("date"),
        (F.lit(-45.6) + (k % 6000) / 10000.0).alias("latitude"),
        (F.lit(166.45) + (k % 5500) / 10000.0).alias("longitude"),
    )


@query(
    "regional_report",
    o.with_(o.CAPTURES)
    + REGION
    + f""", pos AS (SELECT CAST(l_shipdate AS DATE) AS date, -45.6e0 + (l_partkey % 6000) / 1e4 AS lat,
          166.45e0 + (l_partkey % 5500) / 1e4 AS lon FROM lineitem WHERE year(l_shipdate) = {YEAR}),
      sd AS (SELECT 'northern' AS region, count(DISTINCT date) AS survey_days FROM pos WHERE lat > -45.1062
        UNION ALL SELECT 'middle', count(DISTINCT date) FROM pos WHERE (lat < -45.1851 AND lat > -45.3809)
          OR (lat < -45.3809 AND lat > -45.4835 AND lon > 166.9169)
        UNION ALL SELECT 'southern', count(DISTINCT date) FROM pos WHERE lat > -45.31667),
      ed AS (SELECT region, count(DISTINCT date) AS encounter_days, count(DISTINCT ("group", date)) AS sightings
        FROM ident GROUP BY region)
      SELECT region, coalesce(survey_days, 0) AS survey_days, coalesce(encounter_days, 0) AS encounter_days,
        coalesce(sightings, 0) AS sightings FROM sd FULL JOIN ed USING (region)""",
)
def _(t):
    return reports.regional_report(b.captures(t), _positions(t), YEAR)


@query(
    "regional_demography",
    LIFE
    + REGION
    + f""", who AS (SELECT DISTINCT region, CASE WHEN region <> 'southern' THEN survey_area END AS survey_area, id_name FROM ident),
      rows AS (SELECT w.*, l.pod, l.sex, CASE WHEN l.name IS NOT NULL THEN {o.age_class(str(YEAR))} END AS ageclass
        FROM who w LEFT JOIN life l ON l.name = w.id_name)
      SELECT region, survey_area, pod, 'ageclass' AS kind, ageclass AS value, count(*) AS n FROM rows GROUP BY ALL
      UNION ALL SELECT region, survey_area, pod, 'sex', sex, count(*) FROM rows GROUP BY ALL""",
)
def _(t):
    return reports.regional_demography(b.captures(t), _history(t), YEAR)


PERMIT = (
    LIFE
    + f""", demo AS (SELECT survey_area, name, sex, birth_year, now, nxt FROM (
        SELECT l.*, {o.age_class(str(YEAR))} AS now, {o.age_class(str(YEAR + 1))} AS nxt FROM life l)
        WHERE nxt <> 'NA' AND now <> 'D'),
      rows AS (SELECT c.survey_area, c.year, d.sex,
          CASE WHEN a NOT IN ('A', 'U') THEN 'J' ELSE a END AS ageclass
        FROM (SELECT DISTINCT survey_area, year, id_name FROM captures) c
        LEFT JOIN (SELECT *, CASE WHEN {YEAR} < birth_year THEN nxt ELSE now END AS a FROM demo) d
          ON d.name = c.id_name AND d.survey_area = c.survey_area)
      """
)


def _life_with_area(t):
    return _history(t).join(b.life_table(t).select("name", "survey_area"), "name")


@query(
    "permit_tables",
    PERMIT
    + """SELECT survey_area, year, 'ageclass' AS kind, ageclass AS value, count(*) AS n FROM rows GROUP BY ALL
      UNION ALL SELECT survey_area, year, 'sex', sex, count(*) FROM rows GROUP BY ALL""",
)
def _(t):
    return reports.permit_tables(b.captures(t), _life_with_area(t), YEAR)


# --- operators these tables are built from ---------------------------------------------------


@query("self_join_mother", LIFE + "SELECT name, first_calf FROM life0")
def _(t):
    raw = life.normalise_life(b.life_table(t))
    return life.with_first_calf(raw).select("name", "first_calf")


@query("theta_last_before", LIFE + "SELECT name, inutero FROM inutero")
def _(t):
    raw = life.normalise_life(b.life_table(t))
    dated = raw.join(life.first_last_seen(b.captures(t)), "name", "left")
    return life.inutero_dates(dated, b.captures(t))


@query("first_last_seen", LIFE + "SELECT id_name AS name, first_date, last_date, last_calfyear FROM seen")
def _(t):
    return life.first_last_seen(b.captures(t))


@query(
    "cross_years",
    LIFE + f"SELECT l.name, CAST(y AS INTEGER) AS year FROM life_raw l, (SELECT unnest(range(l2.a, {LAST + 1})) AS y, l2.n FROM (SELECT name AS n, first_year AS a FROM life_raw) l2) WHERE n = l.name",
)
def _(t):
    from wakeline.operators.joins import expand_years

    raw = life.normalise_life(b.life_table(t))
    return expand_years(raw, F.col("first_year"), LAST).select("name", "year")


@query(
    "first_appearance",
    o.with_(o.CAPTURES) + "SELECT id_name, date, date = min(date) OVER (PARTITION BY id_name) AS is_first, date = max(date) OVER (PARTITION BY id_name) AS is_last FROM (SELECT DISTINCT id_name, date FROM captures)",
)
def _(t):
    from wakeline.operators.shape import with_group_stats

    days = b.captures(t).select("id_name", "date").distinct()
    ends = with_group_stats(days, ["id_name"], {"a": F.min("date"), "z": F.max("date")})
    flags = {"is_first": F.col("date") == F.col("a"), "is_last": F.col("date") == F.col("z")}
    return ends.withColumns(flags).drop("a", "z")


@query(
    "split_apply",
    _flags_sql("year")
    + """SELECT year, pod, count(*) AS n, CAST(sum(winter) AS BIGINT) AS winter, CAST(sum(spring) AS BIGINT) AS spring,
      CAST(sum(winter * spring) AS BIGINT) AS recaptured FROM flags GROUP BY year, pod""",
)
def _(t):
    total = lambda c: F.sum(c).cast("bigint")
    return _flags(t).groupBy("year", "pod").agg(
        F.count(F.lit(1)).alias("n"),
        total("winter").alias("winter"),
        total("spring").alias("spring"),
        total(F.col("winter") * F.col("spring")).alias("recaptured"),
    )


@query(
    "season_of_month",
    o.with_(o.CAPTURES)
    + """SELECT trip, CASE WHEN trip IN ('1999_12', '1996_12') THEN 'SPRING' WHEN trip[6:7] IN ('12', '01', '02') THEN 'SUMMER'
      WHEN trip[6:7] <= '05' THEN 'AUTUMN' WHEN trip[6:7] <= '08' THEN 'WINTER' ELSE 'SPRING' END AS season,
      count(*) AS n FROM captures GROUP BY ALL""",
)
def _(t):
    from wakeline.functions.dates import season, trip_month

    special = ((1996, 12, "SPRING"), (1999, 12, "SPRING"))
    name = season(trip_month("trip"), "year", special)
    return b.captures(t).groupBy("trip", name.alias("season")).agg(F.count(F.lit(1)).alias("n"))

