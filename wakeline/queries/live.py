"""The streaming forms, driven over the tables' files until they are read up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from wakeline.plans import photos as photo, survey
from wakeline.queries import oracle as o, query
from wakeline.queries.survey import WINDOWS_SQL, _effort
from wakeline.sources.bindings import Tables
from wakeline.sources.staging import staging_root
from wakeline.streaming import tracks


def _stream(t: Tables, name: str) -> DataFrame:
    schema = getattr(t, name).schema
    # a glob takes a table that is one file as well as a folder of files
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}.parquet*")


def _drain(t: Tables, stream: DataFrame) -> DataFrame:
    """Run a stream over everything available into a parquet sink and open the sink."""
    root = f"{staging_root(t.spark)}/stream-{uuid.uuid4().hex}"
    job = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start(f"{root}/rows")
    )
    job.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/rows")


def _drain_updates(t: Tables, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream in update mode over everything available; the last update of each key."""
    root = f"{staging_root(t.spark)}/stream-{uuid.uuid4().hex}"
    job = (
        stream.writeStream.outputMode("update")
        .foreachBatch(tracks.update_sink(f"{root}/rows"))
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    rows = t.spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{root}/rows")
    return tracks.newest(rows, keys)


@query(
    "stream_thin",
    "SELECT user_id AS device_id, min(ts) AS ts FROM events GROUP BY user_id, epoch_us(ts) // 21600000000",
)
def _(t):
    n = F.col("event_id")
    fixes = _stream(t, "events").select(
        F.col("user_id").alias("device_id"),
        "ts",
        (F.lit(-45.8) + (n % 3000) / 10000.0).alias("latitude"),
        (F.lit(166.45) + (n % 5500) / 10000.0).alias("longitude"),
    )
    thinned = tracks.stream_thin(fixes, 6 * 3_600)
    return _drain_updates(t, thinned, ["device_id", "bin"]).select("device_id", "ts")


def _windows(t: Tables) -> str:
    """Folder of the sighting windows."""
    marks = survey.encounter_marks(_effort(t)[2])
    windows = photo.sighting_windows(survey.encounters(marks), ("device_id",))
    path = f"{staging_root(t.spark)}/windows-{uuid.uuid4().hex}"
    windows.write.parquet(path)
    return path


def _shots(t: Tables) -> DataFrame:
    shots = _stream(t, "events").where("event_type = 'view'")
    return shots.select(F.col("user_id").alias("device_id"), "ts", "event_id")


@query(
    "stream_photo_groups",
    o.with_(*o.EFFORT_STEPS, o.ENCOUNTERS)
    + WINDOWS_SQL
    + """SELECT s.event_id, w.sighting_number FROM shots s
      LEFT JOIN windows w ON w.device_id = s.device_id AND s.ts BETWEEN w.lo AND w.hi""",
)
def _(t):
    windows, shots = _windows(t), _shots(t)
    # a row of no real device on each side, late enough to close everything before it
    end = f"{windows}-end"
    last = "-1L AS device_id, TIMESTAMP_NTZ '2200-01-01 00:00:00'"
    t.spark.sql(f"SELECT {last} AS ts, CAST(NULL AS BIGINT) AS event_id").write.parquet(end)
    schema = t.spark.read.parquet(windows).schema
    t.spark.sql(f"SELECT {last} AS lo, TIMESTAMP_NTZ '2200-01-01 00:00:00' AS hi, CAST(NULL AS BIGINT) AS sighting_number").select(
        *[F.col(f.name).cast(f.dataType) for f in schema]
    ).write.mode("append").parquet(windows)
    arriving = t.spark.readStream.schema(schema).parquet(windows)
    closing = t.spark.readStream.schema(shots.schema).parquet(end)
    joined = tracks.stream_photo_groups(shots.unionByName(closing), arriving, "60 days", ("device_id",))
    return _drain(t, joined).where("event_id IS NOT NULL").select("event_id", "sighting_number")


@query(
    "stream_photo_lookup",
    o.with_(*o.EFFORT_STEPS, o.ENCOUNTERS)
    + WINDOWS_SQL
    + """SELECT s.event_id, w.sighting_number FROM shots s
      LEFT JOIN windows w ON w.device_id = s.device_id AND s.ts BETWEEN w.lo AND w.hi""",
)
def _(t):
    found = tracks.stream_photo_lookup(_shots(t), t.spark.read.parquet(_windows(t)), ("device_id",), 86_400)
    return _drain(t, found).select("event_id", "sighting_number")


@query(
    "stream_first_seen",
    """SELECT CAST(o_custkey AS VARCHAR) AS id_name, CAST(min(o_orderdate) AS DATE) AS first_date
      FROM orders GROUP BY o_custkey""",
)
def _(t):
    day = F.col("o_orderdate").cast("date").alias("date")
    captures = _stream(t, "orders").select(F.col("o_custkey").cast("string").alias("id_name"), day)
    return _drain_updates(t, tracks.stream_first_seen(captures), ["id_name"])
