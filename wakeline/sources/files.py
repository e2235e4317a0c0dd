"""Reading and writing survey files. Thin by intent: the work is Spark's own sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.functions.text import basename, drop_extension, folder_date
from wakeline.operators.shape import normalise_schema
from wakeline.sources.listing import FileListing
from wakeline.schemas import TRACK_ALIASES, TRACK_CASTS

# Photograph extensions that are listed.
PHOTO_PATTERNS = ("*.jpg", "*.JPG", "*.CR2", "*.NEF")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Headed CSV with a declared schema; no inference pass over the data."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("header", True).csv(paths)


def merge_sheets(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Append per-photographer sheets, leaving out editors' temporary ``~`` files."""
    sheets = read_csv(spark, path, schema).withColumn("__file", F.col("_metadata.file_name"))
    return sheets.where(~F.col("__file").contains("~")).drop("__file")


def read_tracks(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Track layers of one or more devices, names and types harmonised before the append."""
    merged = None
    for path in paths:
        reader = spark.read.format(fmt)
        layer = (reader.option("header", True) if fmt == "csv" else reader).load(path)
        layer = normalise_schema(
            layer, TRACK_ALIASES, {**TRACK_CASTS, "latitude": "double", "longitude": "double"}
        )
        merged = layer if merged is None else merged.unionByName(layer, allowMissingColumns=True)
    return merged


def read_gpx(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Track points of GPX files as (time in UTC, latitude, longitude)."""
    schema = "_lat double, _lon double, time string"
    points = spark.read.format("xml").option("rowTag", "trkpt").schema(schema).load(path)
    utc = F.to_timestamp_ntz(F.regexp_replace("time", "Z$", ""))
    return points.select(
        utc.alias("time"), F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude")
    )


def list_photos(
    spark: SparkSession, root: str, patterns: Sequence[str] = PHOTO_PATTERNS, levels: int = 1
) -> DataFrame:
    """Photo files below ``root``: path, base name, folder date, size and time of change.

    Folders are listed first, each in a task (see `FileListing`); contents are not read.
    """
    spark.dataSource.register(FileListing)
    reader = spark.read.format("file_listing").option("patterns", ",".join(patterns)).option("levels", levels)
    return describe_paths(reader.load(root))


def describe_paths(files: DataFrame) -> DataFrame:
    """Adds base name and folder date to paths; further columns stay behind them."""
    path = F.col("path")
    return files.select(
        "path",
        drop_extension(basename(path)).alias("filename"),
        folder_date(path).alias("date"),
        *[c for c in files.columns if c != "path"],
    )


def write_survey(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Survey table partitioned by area and trip, so a trip reads only its own folder.

    Trips that ``df`` has are replaced whole, trips that it does not have stay. Rows are first
    written to a hidden folder beside the trips, and folders change places when the whole job is
    done: a job that fails leaves every trip as it was, and ``df`` may be read from ``path``.
    Rebalancing gathers a trip into few files and still splits an oversized one.
    """
    rows = df.hint("rebalance", "survey_area", "trip")
    writer = rows.write.mode("overwrite").partitionBy("survey_area", "trip").format(fmt)
    writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.option("header", True).option("nullValue", "") if fmt == "csv" else writer).save(path)


def snapshot(df: DataFrame, root: str, name: str, date: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/date={date}")


def load_survey(spark: SparkSession, path: str, area: str, year: int, month: str) -> DataFrame:
    """One compiled trip; the filter prunes partitions."""
    table = spark.read.parquet(path)
    return table.where((F.col("survey_area") == area) & (F.col("trip") == f"{year}_{month}"))


def referenced_metadata(metadata: DataFrame, files: DataFrame, sheets: DataFrame) -> DataFrame:
    """Metadata rows of the files that some sheet row names (file name and date)."""
    wanted = files.join(sheets.select("filename", "date"), ["filename", "date"], "left_semi")
    return metadata.join(wanted, metadata["source_file"] == wanted["path"], "left_semi")


