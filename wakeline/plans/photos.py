"""Photo-identification tables and structured file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.functions.dates import parse_ts
from wakeline.functions.text import (
    basename,
    drop_extension,
    parent_folder,
    replace_first_text,
    word,
)
from wakeline.operators.joins import interval_assign
from wakeline.operators.shape import recode
from wakeline.operators.skew import key_struct
from wakeline.sources.files import referenced_metadata

# Camera clock format, placeholder identities, canonical names.
CAMERA_TIME = "yyyy:MM:dd HH:mm:ss"
UNMARKED, CULLED = "UNMA", "CULL"
NAME_RULES = {"EEK": "EEK-THE-CAT", "JOLLY": "JOLLY-GOOD"}
CONDITIONAL = "Conditional match"
ERAS = ("post_2008", "to_2008", "in_2006")


def photo_times(metadata: DataFrame) -> DataFrame:
    """(filename, date, ts) from camera metadata."""
    ts = parse_ts(F.col("datetime_original"), CAMERA_TIME)
    return metadata.select(
        drop_extension(basename(F.col("file_name"))).alias("filename"), ts.alias("ts")
    ).withColumn("date", F.col("ts").cast("date"))


def photo_table(
    sheets: DataFrame, metadata: DataFrame, files: DataFrame | None = None, area: str = "Other"
) -> DataFrame:
    """Sheet rows with capture times, canonical names and survey area; culled rows leave."""
    named = sheets.withColumn("id_name", F.coalesce("id_name", F.lit(UNMARKED)))
    named = named.where(F.col("id_name") != CULLED)
    if files is not None:
        metadata = referenced_metadata(metadata, files, named)
    # copies of a metadata row say the same; without this they would multiply the sheets
    times = photo_times(metadata).distinct()
    timed = named.join(times, ["filename", "date"], "left")
    area_name = "" if area == "Other" else area.upper()
    return recode(timed, "id_name", NAME_RULES).withColumn("survey_area", F.lit(area_name))


def sighting_windows(survey: DataFrame, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """First and last time of every numbered sighting, one row per date (or ``by``) it touches."""
    marks = survey.where(F.col("sighting_number").isNotNull())
    span = marks.groupBy("sighting_number").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    touched = marks.select("sighting_number", *by).distinct()
    return touched.join(span, "sighting_number")


def photo_groups(
    photos: DataFrame,
    windows: DataFrame,
    by: tuple[str, ...] = ("date",),
    bin_seconds: int = 3_600,
) -> DataFrame:
    """Sighting number of each photo; photos outside every sighting stay, ungrouped."""
    group = F.col("sighting_number").alias("group")
    intervals = windows.select(*by, "lo", "hi", group).distinct()
    rows = photos.drop("group").distinct()
    return interval_assign(rows, intervals, by, "ts", "lo", "hi", "left", bin_seconds).drop("lo", "hi")


def photo_count(photos: DataFrame) -> DataFrame:
    return photos.agg(F.countDistinct("filename").alias("n_photos"))


def _first_word(text: Column) -> Column:
    return F.upper(F.substring_index(text, " ", 1))


def parse_filenames(
    metadata: DataFrame, era: str, area: str, trip: str, normalise_part: bool = False
) -> DataFrame:
    """Structured capture rows from photo file names, by naming era.

    A name joining two animals gives a second row named from its third word. Those
    second rows keep upper-case part letters in the newest era unless
    ``normalise_part`` is set.
    """
    if era not in ERAS:
        raise ValueError(f"era must be one of {ERAS}, not {era!r}")
    raw, source = F.col("file_name"), F.col("source_file")
    both = replace_first_text(replace_first_text(F.upper(raw), "WITH", "and"), "&", "and")
    in_2006 = era == "in_2006"
    rows = metadata.withColumns(
        {"__file": raw if in_2006 else replace_first_text(raw, " '", ""), "__both": both}
    )
    two = F.lower("__both").contains(" and ")
    rows = rows.withColumn("__row", F.explode(F.when(two, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    first = F.col("__row") == 1
    file = F.when(first, F.col("__file")).otherwise(replace_first_text(F.col("__both"), " '", ""))
    rows = rows.withColumn("__name", file)

    shown = F.col("__name")
    if era == "post_2008":
        name, from_end = _first_word(shown), 14
    elif era == "to_2008":
        name, from_end = _first_word(F.substring(raw, 7, 2**31 - 1)), 7
    else:
        name, from_end = _first_word(parent_folder(source)), 6
    quoted = first & F.coalesce(shown.contains("'"), F.lit(False))
    frame = F.when(first, basename(source)) if in_2006 else F.substring(shown, -12, 8)

    part = F.substring(shown, -from_end, 1)
    lower = era == "post_2008" and not normalise_part
    side = F.upper(part) if normalise_part else part
    recoded = (
        F.when(side == ("l" if lower else "L"), "LD")
        .when(side == ("r" if lower else "R"), "RD")
        .otherwise(part)
    )
    ts = parse_ts(F.col("datetime_original"), CAMERA_TIME)
    return rows.select(
        F.lit(area.upper()).alias("survey_area"),
        F.lit(trip).alias("trip"),
        ts.cast("date").alias("date"),
        frame.alias("filename"),
        ts.alias("ts"),
        F.when(first, name).otherwise(F.upper(word(shown, 3))).alias("name"),
        recoded.alias("part"),
        F.lit("").alias("group"),
        F.lit("").alias("photographer"),
        F.when(quoted, CONDITIONAL).otherwise("").alias("comments"),
        "source_file",
        shown.alias("file_name"),
        "datetime_original",
    )


def resolve_duplicates(
    rows: DataFrame, by: tuple[str, ...] = ("ts", "filename"), name: str = "name"
) -> DataFrame:
    """Of several rows for one frame drop the unnamed ones.

    Named rows stay as they are; an unnamed row stays when its frame has one row.
    Frames are counted with one hash aggregation that combines map-side, so a frame repeated
    in a third of the rows costs one row per task; only unnamed rows are joined with it.
    """
    named = F.coalesce(F.col(name) != "", F.lit(False))
    single = rows.groupBy(key_struct(by).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1")
    unnamed = rows.where(~named).withColumn("__k", key_struct(by))
    alone = unnamed.join(single, F.col("__k") == F.col("__g"), "left_semi").drop("__k")
    return rows.where(named).unionByName(alone)


def raw_to_jpg(metadata: DataFrame) -> DataFrame:
    """Path of the jpg made from a raw file, with its local capture time."""
    jpg = replace_first_text(F.col("source_file"), ".NEF", ".jpg")
    jpg = replace_first_text(jpg, "Original NEF files/", "")
    return metadata.select(
        "source_file",
        jpg.alias("jpg_filename"),
        parse_ts(F.col("datetime_original"), CAMERA_TIME).alias("ts"),
    )
