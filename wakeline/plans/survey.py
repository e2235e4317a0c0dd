"""From tracks and sighting logs to effort, encounters, distances and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.dates import minutes_between, parse_ts
from wakeline.functions.geo import AREA_BANDS, with_nautical_miles
from wakeline.functions.text import contains
from wakeline.operators.joins import asof_join
from wakeline.operators.ordered import (
    Carry,
    before_key,
    carry_forward,
    dedupe_first,
    locf_frame,
    nocb,
    pair_marks,
    thin_bins,
)
from wakeline.operators.shape import blank_to_null, ensure_columns
from wakeline.operators.skew import attach

# Log entries and permit names.
ENCOUNTER_TYPES = ("Initial", "Repeat", "Follow")
START_MARK = "Encounter START"
END_MARK = "Encounter END & DATA"
PERMITS = {"DOC permit": "doc", "Otago permit": "otago"}
NEAR, FAR = "<100", "100–400"

# Device label of hand-entered rows, which carry no device of their own.
NO_DEVICE = "MISSING"

# Track fixes are seconds apart; hour-long spans keep a cell at a few thousand rows.
TRACK_SPAN = 3_600


def clean_tracks(tracks: DataFrame) -> DataFrame:
    """Timestamp, then one fix per device and time (lowest position wins)."""
    if "ts" not in tracks.columns:
        text = F.concat_ws(" ", F.col("date").cast("string"), F.col("time"))
        tracks = tracks.withColumn("ts", parse_ts(text, "yyyy-MM-dd HH:mm:ss"))
    tracks = tracks.withColumn("date", F.col("ts").cast("date"))
    return dedupe_first(tracks, ["device_id", "ts"], ["latitude", "longitude"])


def locate_sightings(
    sightings: DataFrame, tracks: DataFrame, by: tuple[str, ...] = ("device_id",), **asof
) -> DataFrame:
    """Give each sighting the position of the nearest fix of the same device."""
    spots = tracks.select(*by, "ts", "latitude", "longitude")
    rows = sightings.drop("latitude", "longitude")
    asof.setdefault("span_seconds", TRACK_SPAN)
    located = asof_join(rows, spots, "ts", by, "nearest", **asof)
    return located.withColumns(
        {c: F.col(f"matched.{c}") for c in ("latitude", "longitude")}
    ).drop("matched")


def thin_tracks(
    tracks: DataFrame, seconds: int = 10, span_seconds: int = TRACK_SPAN
) -> DataFrame:
    """First fix of every ``seconds`` per device."""
    return thin_bins(tracks, ["device_id"], "ts", seconds, ("latitude", "longitude"), span_seconds)


def _interleave(tracks: DataFrame, sightings: DataFrame) -> DataFrame:
    keys = ["device_id", "ts", "date", "latitude", "longitude"]
    shared = [c for c in tracks.columns if c in sightings.columns and c not in keys]
    left = tracks.withColumnsRenamed({c: f"__t_{c}" for c in [*keys, *shared]})
    same = None
    for k in keys:
        hit = F.col(f"__t_{k}").eqNullSafe(F.col(k))
        same = hit if same is None else same & hit
    joined = left.join(sightings, same, "full")
    merged = joined.withColumns({c: F.coalesce(c, f"__t_{c}") for c in [*keys, *shared]})
    return merged.drop(*[f"__t_{c}" for c in [*keys, *shared]])


def survey_table(
    tracks: DataFrame,
    sightings: DataFrame,
    missing_tracks: DataFrame | None = None,
    missing_sightings: DataFrame | None = None,
    seconds: int = 10,
) -> DataFrame:
    """Interleave thinned fixes with located sightings; blanks become NULL.

    Hand-entered fixes and sightings have no device: they are located and thinned
    among themselves and appended under one device label.
    """
    table = _interleave(tracks, sightings)
    if missing_tracks is not None and missing_sightings is not None:
        extra = missing_tracks.withColumn("device_id", F.lit(NO_DEVICE))
        marks = missing_sightings.withColumn("device_id", F.lit(NO_DEVICE))
        extra, marks = (d.withColumn("date", F.col("ts").cast("date")) for d in (extra, marks))
        marks = locate_sightings(marks, extra)
        table = table.unionByName(
            _interleave(thin_tracks(extra, seconds), marks), allowMissingColumns=True
        )
    return blank_to_null(table)


def _numbered_pairs(paired: DataFrame, marks: DataFrame, out: str) -> DataFrame:
    """Number pairs over all devices in device order.

    A device with n marks has ceil(n / 2) pairs, so the offsets need mark counts only.
    """
    pairs = F.floor((F.count(F.lit(1)) + 1) / 2).alias("__n")
    per_device = marks.groupBy("device_id").agg(pairs)
    offsets = before_key(per_device, "device_id", sums={"__before": "__n"})
    joined = attach(paired, offsets, ["device_id"])
    return joined.withColumn(out, F.col("pair") + F.col("__before")).drop("__before")


def effort_marks(survey: DataFrame) -> DataFrame:
    """The few rows that switch effort on or off."""
    return survey.where(contains(F.col("effort"), "Effort") & F.col("ts").isNotNull())


def encounter_marks(survey: DataFrame) -> DataFrame:
    """The few rows that start or end an encounter."""
    return survey.where(contains(F.col("event_type"), "Encounter"))


def effort_periods(survey: DataFrame) -> DataFrame:
    """One row per ON/OFF pair, numbered over devices; an odd last mark is ``unpaired``.

    Takes the survey table or its ``effort_marks``.
    """
    marks = effort_marks(survey).select("device_id", "ts", "date").distinct()
    pairs = (
        pair_marks(marks, ["device_id"], "ts")
        .groupBy("device_id", "pair")
        .agg(
            F.min("ts").alias("start"),
            F.max("ts").alias("end"),
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            (F.count(F.lit(1)) == 1).alias("unpaired"),
        )
    )
    return _numbered_pairs(pairs, marks, "event").select(
        "event", "device_id", "start", "end", "start_date", "end_date", "unpaired"
    )


def on_effort(
    survey: DataFrame, periods: DataFrame, same_date: bool = True, span_seconds: int = TRACK_SPAN
) -> DataFrame:
    """Keep rows inside an effort period of their device and add its ``event`` number.

    Periods of a device do not overlap, so the last one opened at or before a row
    is the only candidate: an as-of lookup, not a range join. ``same_date`` keeps
    only rows dated like one of the period's two marks.
    """
    opened = periods.where(~F.col("unpaired")).select(
        "device_id", F.col("start").alias("ts"), "end", "start_date", "end_date", "event"
    )
    rows = asof_join(survey, opened, "ts", ["device_id"], span_seconds=span_seconds)
    inside = F.col("ts") <= F.col("matched.end")
    if same_date:
        inside = inside & F.col("date").isin(
            F.col("matched.start_date"), F.col("matched.end_date")
        )
    return rows.where(inside).withColumn("event", F.col("matched.event")).drop("matched")


def encounters(survey: DataFrame) -> DataFrame:
    """START/END rows numbered in pairs, with the species logged at END carried back.

    Takes the survey table or its ``encounter_marks``.
    """
    marks = blank_to_null(encounter_marks(survey))
    paired = pair_marks(marks, ["device_id"], "ts", ("event_type",))
    numbered = _numbered_pairs(paired, marks, "sighting_number").drop("pair")
    return nocb(numbered, ["species"], ["device_id"], "ts", ("event_type",))


def encounter_state(
    survey: DataFrame, enc: DataFrame, span_seconds: int = TRACK_SPAN
) -> DataFrame:
    """Survey rows with the encounter type in force and the platform carried forward.

    A row takes the type of the last mark before it when that is a named type; an
    END mark without a type closes the encounter. Mark and platform go through one pass.
    """
    blank = {"encounter_type": F.lit(None).cast("string"), "species": F.lit(None).cast("string")}
    rest = survey.where(~contains(F.col("event_type"), "Encounter")).withColumns(blank)
    table = enc.withColumn("__mark", F.lit(True)).unionByName(rest, allowMissingColumns=True)
    table = table.withColumn("__kind", F.col("encounter_type"))
    is_mark, platform = F.col("__mark").isNotNull(), F.col("platform")
    carries = {
        "__kind": Carry(F.col("__kind"), is_mark & F.col("device_id").isNotNull() & F.col("ts").isNotNull(), ("event_type", "encounter_type"), after_equal=True),
        "platform": Carry(platform, platform.isNotNull(), ("event_type",), over_keys=True),
    }
    table = carry_forward(table, carries, "device_id", "ts", span_seconds)
    kind = F.when(F.col("__kind").isin(*ENCOUNTER_TYPES), F.col("__kind"))
    own = F.when(is_mark, F.col("encounter_type")).otherwise(kind)
    return table.withColumn("encounter_type", own).drop("__mark", "__kind")


def observations(survey: DataFrame, col: str) -> DataFrame:
    """Rows with a side observation in ``col``."""
    rows = survey.where(F.col(col).isNotNull())
    return rows.select("ts", "date", "latitude", "longitude", col, "note")


def effort_distance(survey: DataFrame, area: str = "Other") -> DataFrame:
    """Nautical miles on effort per (date, event) inside the area's latitude band.

    A (date, event) is at most one day of one device; thinned at ten seconds that is
    under nine thousand fixes, so a plain window is bounded here. For ``Other`` the
    Dusky band is taken out after the step lengths are known.
    """
    inside = F.col("latitude").isNotNull() if area == "Other" else _in_band(area)
    rows = survey.where(inside)
    leg = Window.partitionBy("date", "event").orderBy("ts", "latitude", "longitude")
    legs = rows.withColumns(
        {"__lat": F.lag("latitude").over(leg), "__lon": F.lag("longitude").over(leg)}
    )
    if area == "Other":
        legs = legs.where(~_in_band("Dusky"))
    steps = with_nautical_miles(legs, "__nm", "longitude", "latitude", "__lon", "__lat")
    return steps.groupBy("date", "event").agg(
        F.coalesce(F.sum("__nm"), F.lit(0.0)).alias("dist_nm"), F.count(F.lit(1)).alias("n_fixes")
    )


def for_later_tables(survey: DataFrame, area: str) -> DataFrame:
    """The survey rows that summaries, layers and photo windows use once distances are known.

    For ``Other`` the Dusky band goes, and with it rows without a latitude.
    """
    return survey.where(~_in_band("Dusky")) if area == "Other" else survey


def _in_band(area: str) -> Column:
    south, north = AREA_BANDS[area]
    return F.col("latitude").between(south, north)


def track_total(distance: DataFrame) -> DataFrame:
    """Trip total in whole nautical miles."""
    return distance.agg(F.bround(F.sum("dist_nm"), 0).alias("track_dist"))


def encounter_hours(enc: DataFrame, species: str = "Bottlenose") -> DataFrame:
    """Hours with animals by distance class and permit.

    Permit and type carry forward over the marks; times are paired per sighting and
    summed in minutes, rounded half-even to a tenth of an hour per cell.
    """
    marks = blank_to_null(enc, ["permit", "encounter_type"])
    marks = locf_frame(marks, ["permit", "encounter_type"], "device_id", "ts", ("event_type",))
    mark_time = {
        "__start": F.min(F.when(F.col("event_type") == START_MARK, F.col("ts"))),
        "__end": F.min(F.when(F.col("event_type") == END_MARK, F.col("ts"))),
    }
    sightings = (
        marks.where(F.col("species") == species)
        .groupBy("sighting_number", "encounter_type", "permit")
        .agg(*[c.alias(n) for n, c in mark_time.items()])
    )
    distance = F.when(F.col("encounter_type") == "Follow", FAR).otherwise(NEAR)
    hours = (
        sightings.groupBy(distance.alias("distance"), "permit")
        .agg(F.sum(minutes_between("__start", "__end")).alias("__minutes"))
        .withColumn("__hours", F.bround(F.coalesce("__minutes", F.lit(0.0)) / 60, 1))
    )
    cells = [
        F.coalesce(F.sum(F.when(F.col("permit") == p, F.col("__hours"))), F.lit(0.0)).alias(c)
        for p, c in PERMITS.items()
    ]
    table = hours.groupBy("distance").agg(*cells)
    return table.withColumn("total_hours", sum(F.col(c) for c in PERMITS.values()))


def map_points(survey: DataFrame) -> DataFrame:
    """Rows of the map layers (a row may be in several), with pop-up text; one scan."""
    start = (F.col("event_type") == START_MARK) & (F.col("encounter_type") == "Initial")
    during = F.col("encounter_type").isNotNull() | (F.col("event_type") == END_MARK)
    layers = F.array_compact(
        F.array(F.lit("track"), F.when(during, "encounter"), F.when(start, "start"))
    )
    popup = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.lit("<br> "),
        F.col("latitude").cast("string"),
        F.lit(" "),
        F.col("longitude").cast("string"),
    )
    rows = survey.withColumns({"layer": F.explode(layers), "popup": popup})
    rows = ensure_columns(rows, ["species"], None)
    return rows.select("layer", "date", "ts", "latitude", "longitude", "species", "popup")


def date_extract(survey: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of a date range; the predicate reaches the scan."""
    return survey.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
