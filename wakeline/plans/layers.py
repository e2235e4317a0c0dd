"""GPS tracks from other receivers and map layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.functions.dates import seconds_between
from wakeline.functions.geo import speed_kts, with_nautical_miles
from wakeline.operators.ordered import lead_row
from wakeline.operators.shape import explode_vertices

LOCAL_ZONE = "Pacific/Auckland"


def gpx_fixes(
    points: DataFrame,
    zone: str = LOCAL_ZONE,
    start: str | None = None,
    end: str | None = None,
    by: Sequence[str] = (),
    span_seconds: int = 3_600,
) -> DataFrame:
    """Local time, distance and speed to the next fix, then an open time window.

    ``time`` is UTC (``timestamp_ntz``). Distances look at the next fix in time order
    and are computed before the window is cut, as seconds of UTC so that a clock
    change does not distort speeds.
    """
    nxt = {"__t": "time", "__lat": "latitude", "__lon": "longitude"}
    rows = lead_row(points, nxt, by, "time", ("latitude", "longitude"), span_seconds)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("time"))
    rows = with_nautical_miles(rows, "dist_nm", "longitude", "latitude", "__lon", "__lat")
    rows = rows.withColumns({"ts": local, "__s": seconds_between("time", "__t")})
    rows = rows.withColumns(
        {"date": F.col("ts").cast("date"), "speed_kts": speed_kts(F.col("dist_nm"), F.col("__s"))}
    )
    if start is not None:
        rows = rows.where(F.col("ts") > F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return rows.select(*by, "ts", "date", "latitude", "longitude", "dist_nm", "speed_kts")


def layer_extract(layer: DataFrame, where: Column) -> DataFrame:
    """Vertices of the features an attribute condition selects."""
    return explode_vertices(layer.where(where))
