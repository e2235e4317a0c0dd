"""The star-schema test tables read as survey tables.

Events stand in for GPS fixes and log entries, orders for captures, customers for
individuals, line items for photographs. Only column expressions and the ordered
operators are used, so everything below scales with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakeline.functions.dates import calf_year, trip_code
from wakeline.operators.ordered import number_rows
from wakeline.plans.survey import END_MARK, START_MARK

# Areas, sexes and encounter types the codes of the test tables stand for.
AREA_OF_STATUS = {"O": "DOUBTFUL", "F": "DUSKY", "P": "NANCY"}
AREAS = ("DOUBTFUL", "DUSKY", "NANCY")
SEX_CODES = ("F", "M", "X")
TYPE_CODES = ("Initial", "Repeat", "Follow")
PERMIT_CODES = ("DOC permit", "Otago permit")
SPECIES_CODES = ("Other", "Bottlenose", "Bottlenose")
PLATFORM_CODES = ("Bow", "Flybridge")


class Tables:
    """Lazily opened test tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)  # one schema read per table
        return table


def _pick(code: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (code + 1).cast("int"))


def fixes(t: Tables) -> DataFrame:
    rows = t.events.where(F.col("event_type").isin("view", "click"))
    return rows.select(
        F.col("user_id").alias("device_id"),
        "ts",
        F.col("ts").cast("date").alias("date"),
        (F.lit(-45.8) + (F.col("event_id") % 3000) / 10000.0).alias("latitude"),
        (F.lit(166.45) + (F.col("event_id") % 5500) / 10000.0).alias("longitude"),
    )


def log_entries(t: Tables) -> DataFrame:
    """Effort marks (sign-ups), encounter marks (purchases), other entries (errors)."""
    rows = t.events.where(F.col("event_type").isin("signup", "purchase", "error"))
    rows = number_rows(rows, "seq", ["user_id", "event_type"], "ts", ("event_id",))
    n, kind, odd = F.col("event_id"), F.col("event_type"), F.col("seq") % 2 == 1
    opens = (kind == "purchase") & odd
    blank = F.lit("")
    return rows.select(
        F.col("user_id").alias("device_id"),
        "ts",
        F.col("ts").cast("date").alias("date"),
        F.when(opens, START_MARK)
        .when(kind == "purchase", END_MARK)
        .when(kind == "signup", "Effort")
        .otherwise("Observation")
        .alias("event_type"),
        F.when((kind == "signup") & odd, "Effort ON")
        .when(kind == "signup", "Effort OFF")
        .otherwise(blank)
        .alias("effort"),
        F.when(opens, _pick(n % 3, TYPE_CODES)).otherwise(blank).alias("encounter_type"),
        F.when(opens, _pick(n % 2, PERMIT_CODES)).otherwise(blank).alias("permit"),
        F.when((kind == "purchase") & ~odd, _pick(n % 3, SPECIES_CODES))
        .otherwise(blank)
        .alias("species"),
        F.when((kind == "error") & (n % 4 < 2), _pick(n % 2, PLATFORM_CODES))
        .otherwise(blank)
        .alias("platform"),
        F.when((kind == "error") & (n % 5 == 0), "1").otherwise(blank).alias("tawaki"),
        F.when(kind == "error", F.col("props")).otherwise(blank).alias("note"),
    )


def area_of_status(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in AREA_OF_STATUS.items() for x in kv])[status]


def captures(t: Tables) -> DataFrame:
    date = F.col("o_orderdate").cast("date")
    return t.orders.select(
        area_of_status(F.col("o_orderstatus")).alias("survey_area"),
        trip_code(date).alias("trip"),
        date.alias("date"),
        F.year(date).alias("year"),
        calf_year(date).alias("calfyear"),
        (F.col("o_orderkey") % 5000).cast("string").alias("filename"),
        F.col("o_orderpriority").alias("photographer"),
        F.col("o_custkey").cast("string").alias("id_name"),
        (F.col("o_orderkey") % 4).alias("group"),
        F.col("o_custkey").alias("custkey"),
    )


def captures_by_segment(t: Tables) -> DataFrame:
    """Captures with the customer's market segment as pod."""
    pods = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("pod"))
    return captures(t).join(pods, "custkey")


def life_table(t: Tables) -> DataFrame:
    """Raw life history with text years, blank where unknown."""
    year = F.year("o_orderdate")
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(year).alias("lo"), F.max(year).alias("hi")
    )
    k, blank = F.col("c_custkey"), F.lit("")
    return t.customer.join(seen, "c_custkey").select(
        ((k * 3) % 4500).cast("int").alias("entryno"),
        k.cast("string").alias("name"),
        F.col("c_name").alias("code"),
        _pick(F.col("c_nationkey") % 3, SEX_CODES).alias("sex"),
        F.when(k % 6 == 1, F.floor(k / 2).cast("string")).otherwise(blank).alias("mom"),
        F.when(k % 4 == 0, blank)
        .otherwise((F.col("lo") - k % 5).cast("string"))
        .alias("birth_year"),
        F.col("lo").cast("string").alias("first_year"),
        F.when(k % 17 == 0, F.col("hi").cast("string")).otherwise(blank).alias("death_year"),
        _pick(F.col("c_nationkey") % 3, AREAS).alias("survey_area"),
    )


def photos(t: Tables) -> DataFrame:
    """Line items as photographs; some carry uncertain or missing identities."""
    k, n = F.col("l_partkey"), F.col("l_suppkey") % 40
    name = (
        F.when(n == 0, "UNMA")
        .when(n == 1, "CALF")
        .when(n == 2, F.concat(F.lit("UK"), k.cast("string")))
        .when(n == 3, F.concat((k % 50).cast("string"), F.lit("?")))
        .when(n == 4, F.lit(None).cast("string"))
        .otherwise((k % 50).cast("string"))
    )
    return t.lineitem.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("filename"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_shipdate").alias("ts"),
        name.alias("id_name"),
        F.col("l_returnflag").alias("part"),
    )


def photo_metadata(t: Tables) -> DataFrame:
    """Line items as camera metadata of name-coded files."""
    k = F.col("l_partkey") % 90
    letters = F.concat(F.lit("ID"), k.cast("string"))
    other = F.concat(F.lit("KO"), (F.col("l_suppkey") % 70).cast("string"))
    frame = F.concat(F.lit("IMG_"), F.lpad((F.col("l_orderkey") % 10000).cast("string"), 4, "0"))
    joined = F.when(F.col("l_linenumber") == 1, F.concat(letters, F.lit(" and "), other)).otherwise(letters)
    mark = F.when(F.col("l_linenumber") == 2, F.lit(" '")).otherwise(F.lit(""))
    side = F.when(F.col("l_returnflag") == "A", "l").when(F.col("l_returnflag") == "R", "r").otherwise("u")
    name = F.concat(joined, mark, F.lit(" "), side, F.lit(" "), frame, F.lit(".NEF"))
    day = F.date_format("l_shipdate", "yyyyMMdd")
    return t.lineitem.select(
        name.alias("file_name"),
        F.concat(F.lit("/trip/"), day, F.lit("/Original NEF files/"), letters, F.lit("/"), name).alias("source_file"),
        F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss").alias("datetime_original"),
    )
