"""Live forms of track thinning, photo grouping and first sightings.

Each returns a streaming DataFrame; starting the query, its trigger, sink and
checkpoint stay with the caller. Watermarks need instants, so clock times are read
in the session time zone, which should be UTC, and given back as clock times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wakeline.operators.joins import bin_of, binned


def _instants(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


def stream_thin(fixes: DataFrame, seconds: int = 10, late: str = "10 minutes") -> DataFrame:
    """First fix per device and time bin. Bins are aligned to the epoch, unlike the batch
    operator's, because a stream does not know a device's first fix in advance.

    Run it in update mode and read the sink with `newest` by (device_id, bin): every bin is
    there as soon as it has a fix, the last ones included. Fixes that arrive more than
    ``late`` behind the newest one are dropped once their bin has left the state.
    """
    point = F.struct("ts", "latitude", "longitude")
    return (
        _instants(fixes, "ts")
        .withWatermark("ts", late)
        .groupBy("device_id", F.window("ts", f"{seconds} seconds"))
        .agg(F.min(point).alias("p"))
        .select(
            "device_id",
            F.col("window.start").cast("timestamp_ntz").alias("bin"),
            F.col("p.ts").cast("timestamp_ntz").alias("ts"),
            "p.latitude",
            "p.longitude",
        )
    )


def stream_photo_groups(
    photos: DataFrame,
    windows: DataFrame,
    piece: str = "1 day",
    by: Sequence[str] = ("date",),
    late: str = "1 hour",
) -> DataFrame:
    """Photos with the sighting windows (``by``, lo, hi, sighting_number) holding them, NULL for none.

    Both sides arrive, in append mode. A window is cut on arrival into pieces of ``piece``, of
    which a photo can only be in one, so sightings may be of any length while both sides' state
    goes back no further than ``piece`` and ``late``. A photo in no window comes out, with NULL,
    once both watermarks have passed it; what arrives more than ``late`` behind is dropped. A photo
    without a time comes out at once.
    """
    shots = _instants(photos, "ts")
    columns = [c for c in windows.columns if c not in by]
    spans = _instants(windows, "lo", "hi").where("lo <= hi").withColumnsRenamed({k: f"__{k}" for k in by})
    pieces = spans.withColumn("__from", F.explode(F.expr(f"sequence(lo, hi, INTERVAL {piece})")))
    inside = F.expr(f"ts >= __from AND ts < __from + INTERVAL {piece} AND ts <= hi")
    for k in by:
        inside = inside & (F.col(k) == F.col(f"__{k}"))
    timed = shots.where("ts IS NOT NULL").withWatermark("ts", late)
    joined = timed.join(pieces.withWatermark("__from", late), inside, "left").select(*photos.columns, *columns)
    joined = joined.unionByName(shots.where("ts IS NULL"), allowMissingColumns=True)
    return joined.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "lo", "hi")})


def stream_photo_lookup(photos: DataFrame, windows: DataFrame, by: Sequence[str] = ("date",), bin_seconds: int = 3_600) -> DataFrame:
    """Arriving photos with the number of the known sighting window that holds them, else NULL.

    ``windows`` is a table that is complete for the photos' time: no state is kept, and photos
    outside every sighting stay. The levels of its windows (see `binned`), a handful, are read
    when the stream is defined; each is a join of its own.
    """
    right = binned(windows.withColumnsRenamed({k: f"__{k}" for k in by}), "lo", "hi", bin_seconds)
    levels = sorted(r[0] for r in right.select("__level").distinct().collect()) or [0]
    helpers = ["lo", "hi", "__at", "__level", "__cell", *[f"__{k}" for k in by]]

    def matched(rows: DataFrame, level: int, how: str) -> DataFrame:
        same = (F.col("__at") == F.col("__cell")) & F.col("ts").between(F.col("lo"), F.col("hi"))
        for k in by:
            same = same & (F.col(k) == F.col(f"__{k}"))
        looking = rows.withColumn("__at", bin_of("ts", F.lit(level), bin_seconds))
        return looking.join(right.where(F.col("__level") == level), same, how).drop(*helpers)

    if len(levels) == 1:
        return matched(photos, levels[0], "left")
    found = reduce(DataFrame.unionByName, (matched(photos, n, "inner") for n in levels))
    alone = reduce(lambda rows, n: matched(rows, n, "left_anti"), levels, photos)
    return found.unionByName(alone, allowMissingColumns=True)


def stream_first_seen(captures: DataFrame, date: str = "date") -> DataFrame:
    """First date of every individual; state is one row per individual.

    Run it in update mode and read the sink with `newest` by id_name.
    """
    return captures.groupBy("id_name").agg(F.min(date).alias("first_date"))


def update_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` in update mode: each batch's rows beside its number.

    A batch that is run again replaces what it wrote before.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last update of each key of a sink that `update_sink` wrote."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v"))
    return last.select(*keys, "__v.*")
