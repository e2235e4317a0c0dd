"""The table verbs behind the survey tables, one short query each.

Plain verbs are Spark's own; only the composites (as-of, thinning, pairing, locf,
completion) come from ``wakeline.operators``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import dates, geo, text
from wakeline.operators import joins, ordered, shape
from wakeline.plans import life, reports, survey
from wakeline.queries import oracle as o, query
from wakeline.sources import bindings as b, files
from wakeline.sources.staging import staging_root

MONTH = 30 * 86_400


def _count():
    return F.count(F.lit(1))


# All event types and order years of the test tables: the columns of two pivots.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
ORDER_YEARS = range(1995, 2002)


def _scratch(t, name):
    import uuid

    return f"{staging_root(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------


@query("scan_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = _scratch(t, "csv")
    t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    return files.read_csv(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("merge_sheets", "SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def _(t):
    root = _scratch(t, "sheets")
    sheets = {"first": ("supplier", "s_suppkey", "s_name"), "second": ("customer", "c_custkey", "c_name")}
    for folder, (table, key, name) in sheets.items():
        rows = getattr(t, table).select(F.col(key).alias("key"), F.col(name).alias("name"))
        rows.write.option("header", True).csv(f"{root}/{folder}")
    return files.merge_sheets(t.spark, [f"{root}/{f}" for f in sheets], "key bigint, name string")


@query(
    "scan_tracks",
    o.with_(o.FIXES)
    + """SELECT device_id, ts, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
      CASE WHEN device_id % 2 = 1 THEN 14.5e0 END AS depth FROM fixes""",
)
def _(t):
    root = _scratch(t, "tracks")
    fixes = b.fixes(t).select("device_id", "ts", "latitude", "longitude")
    even = fixes.where("device_id % 2 = 0").withColumnsRenamed({"latitude": "LAT", "longitude": "LON"})
    odd = fixes.where("device_id % 2 = 1").withColumn("depth", F.lit("14.5"))
    even.write.parquet(f"{root}/first")
    odd.write.parquet(f"{root}/second")
    merged = files.read_tracks(t.spark, [f"{root}/first", f"{root}/second"])
    return merged.withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


@query(
    "scan_gpx",
    o.with_(o.FIXES)
    + "SELECT ts AS time, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM fixes",
)
def _(t):
    path = _scratch(t, "gpx")
    points = b.fixes(t).select(
        F.round("latitude", 6).alias("_lat"),
        F.round("longitude", 6).alias("_lon"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
    )
    points.write.format("xml").option("rootTag", "trkseg").option("rowTag", "trkpt").save(path)
    return files.read_gpx(t.spark, path)


@query(
    "list_files",
    o.with_(o.METADATA)
    + """SELECT date_trunc('month', ts)::DATE AS date, count(*) FILTER (file_name LIKE 'ID1%') > 0 AS marked,
      sum(strlen(file_name) + 1)::BIGINT AS n_bytes FROM meta GROUP BY 1""",
)
def _(t):
    """Writes a folder of photo lists per month, a file for the marked animals and one for the rest, and lists it."""
    root = _scratch(t, "folders")
    names = b.photo_metadata(t).select(
        F.concat(F.substring(F.regexp_replace("datetime_original", ":", ""), 1, 6), F.lit("01")).alias("day"),
        F.when(F.col("file_name").startswith("ID1"), "marked").otherwise("other").alias("kind"),
        F.col("file_name").alias("value"),
    )
    names.repartition("day", "kind").write.partitionBy("day", "kind").text(root)
    listed = files.list_photos(t.spark, root, ["*.txt"])
    marked = F.col("path").contains("kind=marked")
    return listed.groupBy("date").agg(F.bool_or(marked).alias("marked"), F.sum("size").alias("n_bytes"))


@query(
    "describe_paths",
    o.with_(o.METADATA)
    + """SELECT folder || file_name AS path, left(file_name, length(file_name) - 4) AS filename,
      CAST(ts AS DATE) AS date FROM meta""",
)
def _(t):
    return files.describe_paths(b.photo_metadata(t).select(F.col("source_file").alias("path")))


@query(
    "photo_metadata",
    o.with_(o.METADATA)
    + "SELECT left(file_name, length(file_name) - 4) AS filename, ts, CAST(ts AS DATE) AS date FROM meta",
)
def _(t):
    from wakeline.plans.photos import photo_times

    return photo_times(b.photo_metadata(t))


@query(
    "load_final",
    o.with_(o.CAPTURES)
    + "SELECT id_name, date FROM captures WHERE survey_area = 'DUSKY' AND trip = '1998_06'",
)
def _(t):
    path = _scratch(t, "final")
    files.write_survey(b.captures(t), path)
    return files.load_survey(t.spark, path, "DUSKY", 1998, "06").select("id_name", "date")


@query(
    "sink_table",
    o.with_(o.CAPTURES) + "SELECT survey_area, year, count(*) AS n FROM captures GROUP BY ALL",
)
def _(t):
    path = _scratch(t, "sink")
    yearly = b.captures(t).withColumn("trip", F.col("year").cast("string"))
    # all years but one, one of them twice over; the second write brings that one right and adds the other
    files.write_survey(yearly.where("year != 1997").unionAll(yearly.where("year = 1996")), path)
    files.write_survey(yearly.where("year IN (1996, 1997)"), path)
    return t.spark.read.parquet(path).groupBy("survey_area", "year").agg(_count().alias("n"))


@query("sink_snapshot", o.with_(o.CAPTURES) + "SELECT DISTINCT survey_area, id_name FROM captures WHERE year = 1998")
def _(t):
    root = _scratch(t, "snapshots")
    files.snapshot(reports.individuals(b.captures(t), 1998), root, "individuals", "2024-01-31")
    return t.spark.read.parquet(f"{root}/individuals").where("date = '2024-01-31'").drop("date")


@query(
    "trip_partition",
    o.with_(o.CAPTURES)
    + "SELECT id_name, date, photographer FROM captures WHERE survey_area = 'NANCY' AND trip = '1998_07'",
)
def _(t):
    path = _scratch(t, "trips")
    captures = b.captures(t)
    files.write_survey(captures.where("trip != '1998_07'"), path)
    for month in ("07", "08"):  # each trip is written by itself, and leaves the others
        files.write_survey(captures.where(F.col("trip") == f"1998_{month}"), path)
    return files.load_survey(t.spark, path, "NANCY", 1998, "07").select("id_name", "date", "photographer")


@query(
    "literal_table",
    o.with_(o.CAPTURES)
    + """SELECT label, count(*) AS n FROM captures JOIN (VALUES ('DOUBTFUL', 'Patea'), ('DUSKY', 'Tamatea')) v(area, label)
      ON area = survey_area GROUP BY label""",
)
def _(t):
    labels = t.spark.createDataFrame([("DOUBTFUL", "Patea"), ("DUSKY", "Tamatea")], "survey_area string, label string")
    return b.captures(t).join(F.broadcast(labels), "survey_area").groupBy("label").agg(_count().alias("n"))


# --- projections, predicates, cleaning ------------------------------------------------------


@query("project", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_quantity")


@query("rename", "SELECT p_partkey AS part_id, p_name AS part_name FROM part")
def _(t):
    names = {"p_partkey": "part_id", "p_name": "part_name", "absent": "never"}
    return t.part.select("p_partkey", "p_name").withColumnsRenamed(names)


LIFE = o.with_(*o.LIFE_STEPS)


def _history(t):
    return life.life_history(b.life_table(t), b.captures(t))


@query("last_col_rename", LIFE + f"SELECT name, {o.age_class('2001')} AS ageclass FROM life l")
def _(t):
    return life.age_class_at(_history(t), 2001).select("name", "ageclass")


@query(
    "dynamic_select",
    LIFE + f"SELECT name, {o.age_class('1998')} AS now, {o.age_class('1999')} AS next FROM life l",
)
def _(t):
    history = _history(t)
    classes = {n: life.age_class_of(y) for n, y in (("now", 1998), ("next", 1999))}
    return history.withColumns(classes).select("name", *classes)


@query("derive", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def _(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", net.alias("net"))


@query(
    "case_map",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'partial' END AS state FROM orders""",
)
def _(t):
    s = F.col("o_orderstatus")
    state = F.when(s == "O", "open").when(s == "F", "done").otherwise("partial")
    return t.orders.select("o_orderkey", state.alias("state"))


@query(
    "filter_eq_in",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 20 AND NOT l_linestatus = 'O'",
)
def _(t):
    keep = F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(10, 20)
    return t.lineitem.where(keep & (F.col("l_linestatus") != "O")).select("l_orderkey", "l_linenumber")


@query(
    "filter_regex",
    r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '\.org/') AND NOT coalesce(regexp_matches(url, '#top$'), FALSE)",
)
def _(t):
    url = F.col("url")
    return t.pages.where(text.contains(url, r"\.org/") & ~text.contains(url, "#top$")).select("page_id", "url")


@query(
    "bbox_filter",
    o.with_(o.FIXES) + "SELECT device_id, ts FROM fixes WHERE latitude BETWEEN -45.82 AND -45.48",
)
def _(t):
    return b.fixes(t).where(geo.in_band(F.col("latitude"), "Dusky")).select("device_id", "ts")


@query(
    "time_window_extract",
    "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00'",
)
def _(t):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 06:00:00", "2024-01-09 18:30:00"))
    return t.events.where(F.col("ts").between(lo, hi)).select("event_id", "ts")


@query("blank_to_null", "SELECT event_id, nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS kind FROM events")
def _(t):
    kind = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return shape.blank_to_null(t.events.select("event_id", kind.alias("kind")))


@query(
    "fill_null",
    "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").fillna(0, ["quality", "toxic"])


@query("ensure_columns", "SELECT n_nationkey, n_name, 0 AS x, 999 AS winter FROM nation")
def _(t):
    named = shape.ensure_columns(t.nation.select("n_nationkey", "n_name"), ["n_name", "x"], 0)
    return shape.ensure_columns(named, ["winter"], 999)


@query("drop_na_rows", "SELECT d.doc_id, quality FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL")
def _(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.dropna()


@query(
    "normalise_schema",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer",
)
def _(t):
    raw = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_nationkey").cast("string"))
    drifted = t.customer.select("c_custkey", raw.alias("NAT"))
    return shape.normalise_schema(drifted, {"NAT": "nation", "NATION": "nation"}, {"nation": "int"})


@query("drop_if_present", "SELECT r_regionkey FROM region")
def _(t):
    return t.region.drop("r_name", "group")


@query(
    "recode_values",
    """SELECT c_custkey, CASE WHEN c_mktsegment LIKE '%HOLD%' THEN 'HOME' WHEN c_mktsegment LIKE 'AUTO%' THEN 'CAR'
      ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def _(t):
    rules = {"HOLD": "HOME", "^AUTO": "CAR"}
    return shape.recode(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", rules)


# --- joins -----------------------------------------------------------------------------------


@query("left_join", "SELECT doc_id, lang, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")


@query(
    "full_join_survey",
    o.with_(*o.TRACK_STEPS)
    + "SELECT (event_type IS NULL) AS fix_only, (platform IS NULL) AS no_platform, count(*) AS n FROM survey GROUP BY ALL",
)
def _(t):
    from wakeline.queries.survey import _survey

    empty = {"fix_only": F.col("event_type").isNull(), "no_platform": F.col("platform").isNull()}
    return _survey(t).withColumns(empty).groupBy(*empty).agg(_count().alias("n"))


@query("right_join", "SELECT doc_id, source, quality FROM labels RIGHT JOIN documents USING (doc_id)")
def _(t):
    return t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "source"), "doc_id", "right")


@query("anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query(
    "asof_nearest",
    o.with_(o.FIXES, o.LOGS, o.LOCATED)
    + """SELECT l.device_id, l.ts, CASE WHEN a.ts IS NULL OR l.ts - b.ts <= a.ts - l.ts THEN b.ts ELSE a.ts END AS fix_ts
      FROM (SELECT * FROM logs WHERE event_type = 'Observation') l
      ASOF LEFT JOIN tracks b ON l.device_id = b.device_id AND l.ts >= b.ts
      ASOF LEFT JOIN tracks a ON l.device_id = a.device_id AND l.ts <= a.ts""",
)
def _(t):
    left = t.events.where("event_type = 'error'").select(F.col("user_id").alias("device_id"), "ts")
    right = survey.clean_tracks(b.fixes(t)).select("device_id", "ts")
    found = joins.asof_join(left, right, "ts", ["device_id"], "nearest", span_seconds=MONTH)
    return found.select("device_id", "ts", F.col("matched.ts").alias("fix_ts"))


@query("natural_join", "SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels")
def _(t):
    docs = t.documents.select("doc_id", "lang")
    shared = [c for c in docs.columns if c in t.labels.columns]
    return docs.join(t.labels, shared).select("doc_id", "lang", "quality")


@query(
    "cross_complete",
    """WITH c AS (SELECT user_id AS u, event_type AS e, count(*) AS n FROM events GROUP BY ALL)
      SELECT a.u, b.e, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT u FROM c) a CROSS JOIN (SELECT DISTINCT e FROM c) b
      LEFT JOIN c ON c.u = a.u AND c.e = b.e""",
)
def _(t):
    counted = t.events.groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("e")).agg(_count().alias("n"))
    return joins.complete(counted, ["u", "e"], {"n": 0})


@query("lookup_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    docs = t.documents.select("doc_id")
    return joins.lookup(docs, t.labels.select("doc_id", "quality"), ["doc_id"], {"quality": -1})


@query(
    "dim_lookup_latest",
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y FROM orders)
      WHERE y = (SELECT max(year(o_orderdate)) FROM orders)""",
)
def _(t):
    yearly = t.orders.select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    return joins.latest_by(yearly, "y").select("o_custkey", "o_orderkey")


# --- aggregations ------------------------------------------------------------------------------


@query("group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(_count().alias("n"))


@query("distinct_then_count", "SELECT year(o_orderdate) AS year, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL")
def _(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.countDistinct("o_custkey").alias("n"))


@query("group_sum", "SELECT l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"))


@query(
    "min_max_mean",
    "SELECT p_type, min(p_retailprice) AS lo, max(p_retailprice) AS hi, round(avg(p_size), 6) AS size FROM part GROUP BY ALL",
)
def _(t):
    return t.part.groupBy("p_type").agg(
        F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.round(F.avg("p_size"), 6).alias("size")
    )


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "pivot_count",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F,
      count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY ALL""",
)
def _(t):
    return shape.pivot_counts(t.orders, ["o_orderpriority"], "o_orderstatus", ["O", "F", "P"])


@query(
    "pivot_first",
    "SELECT user_id, "
    + ", ".join(f"min(ts) FILTER (event_type = '{e}') AS {e}" for e in EVENT_TYPES)
    + " FROM events GROUP BY user_id",
)
def _(t):
    return t.events.groupBy("user_id").pivot("event_type", list(EVENT_TYPES)).agg(F.min("ts"))


@query(
    "pivot_sum",
    """SELECT l_linestatus, round(coalesce(sum(l_tax) FILTER (l_returnflag = 'A'), 0), 4) AS A,
      round(coalesce(sum(l_tax) FILTER (l_returnflag = 'N'), 0), 4) AS N,
      round(coalesce(sum(l_tax) FILTER (l_returnflag = 'R'), 0), 4) AS R FROM lineitem GROUP BY ALL""",
)
def _(t):
    wide = t.lineitem.groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_tax"), 4))
    return wide.fillna(0)


@query(
    "pivot_presence",
    o.with_(o.CAPTURES)
    + "SELECT id_name, "
    + ", ".join(f"max(CAST(year = {y} AS INTEGER)) AS y{y}" for y in ORDER_YEARS)
    + " FROM captures GROUP BY id_name",
)
def _(t):
    years = {f"y{y}": F.max((F.col("year") == y).cast("int")) for y in ORDER_YEARS}
    return b.captures(t).groupBy("id_name").agg(*[c.alias(n) for n, c in years.items()])


@query(
    "string_agg",
    """SELECT n_regionkey, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END AS names
      FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey)""",
)
def _(t):
    grouped = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return grouped.select("n_regionkey", text.join_words(F.col("l")).alias("names"))


@query(
    "two_rollups",
    """SELECT l_linestatus, l_returnflag, CAST(NULL AS INTEGER) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL
      UNION ALL SELECT l_linestatus, NULL, l_linenumber, count(*) FROM lineitem GROUP BY ALL""",
)
def _(t):
    a, r, n = (F.col(c) for c in ("l_linestatus", "l_returnflag", "l_linenumber"))
    return t.lineitem.groupingSets([[a, r], [a, n]], a, r, n).agg(_count().alias("n"))


@query(
    "max_filter",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM orders
      QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)""",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return joins.latest_by(rows, "o_orderdate", ["o_custkey"])


# --- windows -----------------------------------------------------------------------------------


@query(
    "dedupe_first",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1""",
)
def _(t):
    first = ordered.dedupe_first(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "thin_bins",
    """SELECT event_id, user_id FROM (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 21600000000 AS bin FROM events)
      QUALIFY row_number() OVER (PARTITION BY user_id, bin ORDER BY ts, event_id) = 1""",
)
def _(t):
    thin = ordered.thin_bins(t.events, ["user_id"], "ts", 6 * 3_600, ("event_id",), MONTH)
    return thin.select("event_id", "user_id")


NUMBERED = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("sequence_number", f"SELECT event_id, {NUMBERED} AS n FROM events WHERE event_type = 'signup'")
def _(t):
    marks = t.events.where("event_type = 'signup'")
    return ordered.number_rows(marks, "n", ["user_id"], "ts", ("event_id",), MONTH).select("event_id", "n")


@query(
    "pair_marks",
    f"""SELECT user_id, pair, min(ts) AS start, max(ts) AS "end" FROM (
      SELECT *, ({NUMBERED} - 1) // 2 + 1 AS pair FROM events WHERE event_type = 'purchase') GROUP BY user_id, pair""",
)
def _(t):
    marks = t.events.where("event_type = 'purchase'")
    paired = ordered.pair_marks(marks, ["user_id"], "ts", ("event_id",), MONTH)
    return paired.groupBy("user_id", "pair").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


FRAME = "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN"


def _purchases(t):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return t.events.select("event_id", "user_id", "ts", value.alias("v"))


def _filled_sql(fn, frame):
    return f"""SELECT event_id, {fn}(v IGNORE NULLS) OVER ({FRAME} {frame}) AS v
      FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)"""


@query("locf", _filled_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def _(t):
    return ordered.locf(_purchases(t), ["v"], ["user_id"], "ts", ("event_id",), MONTH).select("event_id", "v")


@query("nocb", _filled_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def _(t):
    return ordered.nocb(_purchases(t), ["v"], ["user_id"], "ts", ("event_id",), MONTH).select("event_id", "v")


@query(
    "locf_frame",
    """SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY user_id, ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
      FROM (SELECT *, CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN value END AS v FROM events)""",
)
def _(t):
    rows = _purchases(t).withColumn("v", F.when(F.col("user_id") % 3 == 0, F.col("v")))
    return ordered.locf_frame(rows, ["v"], "user_id", "ts", ("event_id",), MONTH).select("event_id", "v")


@query("lag_pair", "SELECT event_id, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return ordered.lag_row(t.events, {"before": "value"}, ["user_id"], "ts", ("event_id",), MONTH).select("event_id", "before")


@query("lead_pair", "SELECT event_id, lead(value) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return ordered.lead_row(t.events, {"after": "value"}, ["user_id"], "ts", ("event_id",), MONTH).select("event_id", "after")


SESSION = f"CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({FRAME} UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)"


@query("session_cumsum", f"SELECT event_id, {SESSION} AS grp FROM events")
def _(t):
    starts = F.col("event_type") == "signup"
    return ordered.sessionise(t.events, starts, "grp", ["user_id"], "ts", ("event_id",), MONTH).select("event_id", "grp")


@query(
    "group_first_fill",
    f"""WITH s AS (SELECT *, {SESSION} AS grp,
        CASE WHEN event_type = 'signup' THEN ['Initial', 'Other', NULL][event_id % 3 + 1] ELSE 'own' END AS kind FROM events),
      f AS (SELECT *, first_value(kind) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS opened FROM s)
      SELECT event_id, CASE WHEN grp > 0 AND opened = 'Initial' THEN 'Initial' ELSE kind END AS kind FROM f""",
)
def _(t):
    n, starts = F.col("event_id") % 3, F.col("event_type") == "signup"
    opening = F.when(n == 0, "Initial").when(n == 1, "Other")
    rows = t.events.withColumn("kind", F.when(starts, opening).otherwise("own"))
    filled = ordered.fill_from_first(rows, "kind", ["Initial"], starts, ["user_id"], "ts", ("event_id",), MONTH)
    return filled.select("event_id", "kind")


@query(
    "group_minmax_rows",
    "SELECT o_orderkey, min(o_orderdate) OVER (PARTITION BY o_custkey) AS lo, max(o_orderdate) OVER (PARTITION BY o_custkey) AS hi FROM orders",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    ends = {"lo": F.min("o_orderdate"), "hi": F.max("o_orderdate")}
    return shape.with_group_stats(rows, ["o_custkey"], ends).drop("o_custkey", "o_orderdate")


@query(
    "group_total_rows",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(l_quantity) OVER (PARTITION BY l_partkey) AS DOUBLE) AS total FROM lineitem",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return shape.with_group_stats(rows, ["l_partkey"], {"total": F.sum("l_quantity")}).drop("l_quantity")


DAYS = "(SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)"


def _days(t):
    from pyspark.sql import Window

    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(_count().alias("n"))
    return days, Window.orderBy("date")  # one row per calendar day


@query("cumulative_new", f"SELECT date, CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS total FROM {DAYS}")
def _(t):
    days, by_day = _days(t)
    return days.select("date", F.sum("n").over(by_day).alias("total"))


@query("row_order", f'SELECT date, row_number() OVER (ORDER BY date) AS "order" FROM {DAYS}')
def _(t):
    days, by_day = _days(t)
    return days.select("date", F.row_number().over(by_day).alias("order"))


@query(
    "dup_count_rows",
    "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return shape.with_group_stats(rows, ["l_orderkey", "l_linenumber"], {"n": _count()})


# --- sort, limit, set operations, reshape -----------------------------------------------------


@query("sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def _(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query(
    "sort_by_level",
    "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS rank FROM orders",
)
def _(t):
    rank = shape.level_rank(F.col("o_orderstatus"), ["P", "O"])
    rows = t.orders.select("o_orderkey", "o_orderstatus", rank.alias("rank"))
    return rows.orderBy("rank", "o_orderkey")


@query("sort_columns", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
def _(t):
    return t.nation.select(sorted(t.nation.columns, reverse=True)).select(sorted(t.nation.columns))


@query("head_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(6)


@query(
    "union_by_name",
    "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier",
)
def _(t):
    customers = t.customer.selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    suppliers = t.supplier.selectExpr("s_name AS name", "s_suppkey AS key")
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query("union_positional", "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return t.customer.selectExpr("c_custkey AS key", "c_name AS name").union(t.supplier.select("s_suppkey", "s_name"))


@query("except_columns", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("union_distinct", "SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer")
def _(t):
    ordered_by = t.orders.select(F.col("o_custkey").alias("key"))
    return ordered_by.union(t.customer.select("c_custkey")).distinct()


@query(
    "pivot_wider",
    """SELECT year(o_orderdate) AS year, coalesce(max(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS F,
      coalesce(max(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS O,
      coalesce(max(o_totalprice) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY ALL""",
)
def _(t):
    wide = t.orders.groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"])
    return wide.agg(F.max("o_totalprice")).fillna(0)


@query(
    "pivot_longer",
    """SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount AS value FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""",
)
def _(t):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "measure", "value")


@query(
    "zero_days",
    """SELECT d.date, coalesce(n, 0) AS n FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) d
      LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) USING (date)""",
)
def _(t):
    days = t.lineitem.select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    counted = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("date"))
    return days.join(counted.agg(_count().alias("n")), "date", "left").fillna(0)


# --- scalar functions ---------------------------------------------------------------------------


@query(
    "parse_dt",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS TIMESTAMP) AS dmy_hms, CAST(l_shipdate AS DATE) AS ymd,
      CAST(NULL AS TIMESTAMP) AS junk FROM lineitem""",
)
def _(t):
    dmy = F.date_format("l_shipdate", "dd/MM/yyyy HH:mm:ss")
    ymd = F.date_format("l_shipdate", "yyyy-MM-dd")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        dates.parse_ts(dmy, "dd/MM/yyyy HH:mm:ss").alias("dmy_hms"),
        F.try_to_date(ymd, "yyyy-MM-dd").alias("ymd"),
        dates.parse_ts(ymd, "dd/MM/yyyy HH:mm:ss").alias("junk"),
    )


@query("tz_convert", "SELECT event_id, CAST(timezone('Pacific/Auckland', timezone('UTC', ts)) AS TIMESTAMP) AS local FROM events")
def _(t):
    local = F.convert_timezone(F.lit("UTC"), F.lit("Pacific/Auckland"), F.col("ts"))
    return t.events.select("event_id", local.alias("local"))


@query("date_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofyear(o_orderdate) AS d FROM orders")
def _(t):
    d = "o_orderdate"
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofyear(d).alias("d"))


@query(
    "date_format",
    "SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS a, strftime(o_orderdate, '%d-%b') AS b FROM orders",
)
def _(t):
    d = "o_orderdate"
    return t.orders.select("o_orderkey", F.date_format(d, "dd MMM yyyy").alias("a"), F.date_format(d, "dd-MMM").alias("b"))


@query("date_shift", "SELECT o_orderkey, CAST(o_orderdate - INTERVAL 2 YEAR AS DATE) AS older FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.shift_years(F.col("o_orderdate").cast("date"), -2).alias("older"))


@query(
    "diff_minutes",
    """SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 6) AS minutes FROM events GROUP BY user_id""",
)
def _(t):
    ends = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return ends.select("user_id", F.round(dates.minutes_between("a", "z"), 6).alias("minutes"))


@query("calf_year", "SELECT o_orderkey, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 9 THEN 1 ELSE 0 END AS calfyear FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.calf_year(F.col("o_orderdate")).alias("calfyear"))


@query(
    "date_range_text",
    "SELECT o_custkey, strftime(min(o_orderdate), '%d %b') || '–' || strftime(max(o_orderdate), '%d %b') AS span FROM orders GROUP BY o_custkey",
)
def _(t):
    d = "o_orderdate"
    return t.orders.groupBy("o_custkey").agg(dates.date_range_text(F.min(d), F.max(d)).alias("span"))


@query("substr", "SELECT c_custkey, c_name[1:4] AS head, right(c_name, 4) AS tail FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.substring("c_name", 1, 4).alias("head"), F.substring("c_name", -4, 4).alias("tail"))


@query("regex_extract", r"SELECT page_id, regexp_extract(url, '\b\d{3}\b') AS number FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("url", r"\b\d{3}\b", 0).alias("number"))


@query("regex_replace", "SELECT page_id, regexp_replace(url, '[aeiou]', '_') AS url FROM pages")
def _(t):
    return t.pages.select("page_id", text.replace_first(F.col("url"), "[aeiou]", "_").alias("url"))


@query("basename", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages")
def _(t):
    return t.pages.select("page_id", text.basename(F.col("url")).alias("name"))


@query(
    "case_title",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low,
      (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ') FROM (SELECT unnest(string_split(p_name, ' ')) AS w)) AS title FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), text.title_case(F.col("p_name")).alias("title")
    )


@query("word_n", "SELECT p_partkey, nullif(split_part(p_name, ' ', 2), '') AS second FROM part")
def _(t):
    return t.part.select("p_partkey", text.word(F.col("p_name"), 2).alias("second"))


@query("concat", "SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS label FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("label"))


@query("length", "SELECT doc_id, length(text) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("n"))


@query(
    "round_trunc",
    "SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS DOUBLE) AS nearest, CAST(trunc(o_totalprice / 7) AS BIGINT) AS whole FROM orders",
)
def _(t):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.bround(price, 0).alias("nearest"), (price / 7).cast("bigint").alias("whole"))


@query(
    "math",
    "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(exp(-o_totalprice / 1e5), 6) AS decay FROM orders",
)
def _(t):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(F.sqrt(price), 6).alias("root"), F.round(F.exp(-price / 1e5), 6).alias("decay"))


@query(
    "vincenty",
    """WITH pts AS (SELECT event_id, -45.8e0 + (event_id % 3000) / 1e4 AS lat1, 166.45e0 + (event_id % 5500) / 1e4 AS lon1,
        -45.8e0 + (event_id % 700) / 1e3 AS lat2, 166.45e0 + (event_id % 900) / 1e3 AS lon2 FROM events), """
    + o.vincenty("pts", "lon1", "lat1", "lon2", "lat2")
    + "SELECT event_id, round(dist_m, 3) AS metres FROM measured",
)
def _(t):
    n = F.col("event_id")
    pairs = t.events.select(
        "event_id",
        (F.lit(166.45) + (n % 5500) / 10000.0).alias("lon1"),
        (F.lit(-45.8) + (n % 3000) / 10000.0).alias("lat1"),
        (F.lit(166.45) + (n % 900) / 1000.0).alias("lon2"),
        (F.lit(-45.8) + (n % 700) / 1000.0).alias("lat2"),
    )
    measured = geo.with_metres(pairs, "metres", "lon1", "lat1", "lon2", "lat2")
    return measured.select("event_id", F.round("metres", 3).alias("metres"))


@query(
    "speed_knots",
    "SELECT event_id, round(value / nullif(event_id % 50, 0) * 3600, 6) AS knots FROM events",
)
def _(t):
    knots = geo.speed_kts(F.col("value"), F.col("event_id") % 50)
    return t.events.select("event_id", F.round(knots, 6).alias("knots"))


@query("cast_num", "SELECT event_id, TRY_CAST(regexp_extract(props, '\\d+') AS INTEGER) AS n, TRY_CAST(event_type AS INTEGER) AS junk FROM events")
def _(t):
    digits = F.regexp_extract("props", r"\d+", 0)
    return t.events.select("event_id", digits.try_cast("int").alias("n"), F.col("event_type").try_cast("int").alias("junk"))


@query(
    "null_tests",
    "SELECT doc_id, quality IS NULL AS unlabelled, nullif(lang, 'en') AS other FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", F.col("quality").isNull().alias("unlabelled"), F.nullif(F.col("lang"), F.lit("en")).alias("other"))


@query("membership", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS pressing FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("pressing"))
