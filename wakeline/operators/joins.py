"""Joins Spark has no single operator for: as-of, interval, completion, years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.dates import DAY_SECONDS, MICROS_PER_SECOND, micros
from wakeline.operators.ordered import (
    _CELL,
    _across_cells,
    _cell,
    _with_inherited,
    summarise_cells,
)

HOUR_SECONDS = 3_600


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    direction: str = "backward",
    allow_exact: bool = True,
    tolerance_seconds: float | None = None,
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Attach to each left row the right row of the same key nearest in time.

    ``direction`` is ``backward`` (last at or before), ``forward`` (first at or
    after) or ``nearest`` (closer of the two, the earlier one on a tie). The match
    comes as a struct column ``matched`` (NULL without a match) holding every
    right column that is not a key. Right rows with the same key and time are
    taken in struct order: the largest looking back, the smallest looking ahead.

    One union, one shuffle on (key, span) cells: no range join, no pair
    enumeration, and a hot key is spread over its spans.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    payload = F.struct(*[F.col(on).alias(on), *[c for c in right.columns if c not in (*by, on)]])
    usable = F.col(on).isNotNull()
    for k in by:
        usable = usable & F.col(k).isNotNull()
    stops = right.where(usable).select(*by, on, payload.alias("__r"), F.lit(1).alias("__right"))
    rows = left.withColumn("__right", F.lit(0)).unionByName(stops, allowMissingColumns=True)
    rows = rows.withColumn(_CELL, _cell(by, on, span_seconds))

    back, ahead = direction != "forward", direction != "backward"
    point = F.struct(F.col(on).alias("t"), F.col("__r").alias("r"))
    points = stops.select(_cell(by, on, span_seconds).alias(_CELL), point.alias("__p"))
    edges = {**({"__last": F.max("__p")} if back else {}), **({"__first": F.min("__p")} if ahead else {})}
    summary = summarise_cells(rows, points, edges)
    inherited = [F.col(_CELL)]
    if back:
        seen = F.last("__last", ignorenulls=True).over(_across_cells(by))
        inherited.append(seen["r"].alias("__before"))
    if ahead:
        seen = F.last("__first", ignorenulls=True).over(_across_cells(by, reverse=True))
        inherited.append(seen["r"].alias("__after"))
    rows = _with_inherited(rows, summary.select(*inherited))

    # at equal times right rows come first when an exact match counts, last otherwise
    side = F.col("__right").desc() if allow_exact else F.col("__right").asc()
    cell = Window.partitionBy(_CELL)
    to_here = (Window.unboundedPreceding, 0)
    if back:
        w = cell.orderBy(F.col(on).asc(), side, F.col("__r").asc()).rowsBetween(*to_here)
        rows = rows.withColumn(
            "__b", F.coalesce(F.last("__r", ignorenulls=True).over(w), F.col("__before"))
        )
    if ahead:
        w = cell.orderBy(F.col(on).desc(), side, F.col("__r").desc()).rowsBetween(*to_here)
        rows = rows.withColumn(
            "__a", F.coalesce(F.last("__r", ignorenulls=True).over(w), F.col("__after"))
        )

    t = micros(on)
    if direction == "nearest":
        gap_b = t - micros(f"__b.{on}")
        gap_a = micros(f"__a.{on}") - t
        match = F.when(F.col("__a").isNull() | (gap_b <= gap_a), F.col("__b")).otherwise(
            F.col("__a")
        )
    else:
        match = F.col("__b") if back else F.col("__a")
    rows = rows.where(F.col("__right") == 0).withColumn("matched", match)
    keep = F.col(on).isNotNull()
    if tolerance_seconds is not None:
        gap = F.abs(micros(f"matched.{on}") - t)
        keep = keep & (gap <= tolerance_seconds * MICROS_PER_SECOND)
    return rows.withColumn("matched", F.when(keep, F.col("matched"))).select(
        *left.columns, "matched"
    )


#: An interval is repeated once per bin up to so many bins; a longer one takes wider bins.
BINS_PER_INTERVAL = 64


def binned(intervals: DataFrame, lo: str, hi: str, bin_seconds: int) -> DataFrame:
    """Valid intervals, once per bin they touch: adds ``__level`` and ``__cell``.

    A bin of level n is `BINS_PER_INTERVAL` ** n times ``bin_seconds`` wide. An interval is on the
    least level where it spans no more than `BINS_PER_INTERVAL` bins, so one wrong end date
    makes a few dozen rows, and the 10,000 years of a timestamp take five levels of an hour.
    """
    spanned = (micros(hi) - micros(lo)) / (bin_seconds * MICROS_PER_SECOND)
    wider = [(spanned > float(BINS_PER_INTERVAL) ** n).cast("int") for n in range(1, 12)]
    level = reduce(lambda a, b: a + b, wider)
    rows = intervals.where(F.col(lo) <= F.col(hi)).withColumn("__level", level)
    first, last = (bin_of(c, F.col("__level"), bin_seconds) for c in (lo, hi))
    return rows.withColumn("__cell", F.explode(F.sequence(first, last)))


def bin_of(ts: str, level: Column, bin_seconds: int) -> Column:
    """Number of the level's bin that holds ``ts``."""
    width = F.pow(F.lit(float(BINS_PER_INTERVAL)), level) * (bin_seconds * MICROS_PER_SECOND)
    return F.floor(micros(ts) / width)


def interval_assign(
    points: DataFrame,
    intervals: DataFrame,
    by: Sequence[str],
    ts: str,
    lo: str,
    hi: str,
    how: str = "inner",
    bin_seconds: int = HOUR_SECONDS,
) -> DataFrame:
    """Join points to the intervals (ends included) that contain them, keys equal.

    One equi join on (keys, level, bin): intervals are repeated once per bin they touch (see
    `binned`), a point looks into one bin of each level that has intervals, mostly one level.
    These levels are found while the join runs, by a subquery over the intervals alone; points
    are read once. A point is in one bin of a level and an interval on one level, so no match is
    found twice. A bin that many points share is split by adaptive skew handling.

    With ``how='left'`` points without an interval are kept, once for each copy, also those
    whose key or time is NULL. The looks that found nothing come out of the same join; a count
    over equal points then tells whether all of them did.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how!r}")
    right = binned(intervals.withColumnsRenamed({k: f"__k_{k}" for k in by}), lo, hi, bin_seconds)
    levels = right.agg(F.array_sort(F.collect_set("__level"))).scalar()
    look = F.posexplode_outer(levels) if how == "left" else F.posexplode(levels)
    rows = points.select("*", look.alias("__look", "__at"))
    rows = rows.withColumn("__in", bin_of(ts, F.col("__at"), bin_seconds))
    same = (F.col("__at") == F.col("__level")) & (F.col("__in") == F.col("__cell"))
    for k in by:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    joined = rows.join(right, same & F.col(ts).between(F.col(lo), F.col(hi)), how)
    helpers = ["__look", "__at", "__in", "__level", "__cell", *[f"__k_{k}" for k in by]]
    if how == "inner":
        return joined.drop(*helpers)
    found = F.count("__level").over(Window.partitionBy(*points.columns))
    first_look = F.coalesce(F.col("__look"), F.lit(0)) == 0
    kept = F.col("__level").isNotNull() | ((F.col("__found") == 0) & first_look)
    return joined.withColumn("__found", found).where(kept).drop("__found", *helpers)


def clip_to_periods(
    rows: DataFrame, periods: DataFrame, by: Sequence[str], ts: str, lo: str, hi: str
) -> DataFrame:
    """Keep rows inside their own period; NULL keys match NULL keys."""
    right = periods.withColumnsRenamed({k: f"__k_{k}" for k in by})
    cond = F.col(ts).between(F.col(lo), F.col(hi))
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(right, cond, "inner").drop(*[f"__k_{k}" for k in by])


#: Values of a dimension that one bucket of `complete` holds, on average.
GRID_BUCKET = 1_024


def complete(df: DataFrame, keys: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """Every combination of the key values present, absent ones filled.

    The keys after the first are dimensions (years, classes) of any size: their distinct
    values are dealt by hash into buckets of about `GRID_BUCKET`, every combination so far
    is repeated once per bucket, and an equi join on the bucket brings the values. No row
    and no task holds all values of a key; a short dimension is one bucket, which Spark
    broadcasts. A NULL is no value of a dimension.
    """
    first, *rest = keys
    grid = df.select(first).distinct()
    for k in rest:
        values = df.select(k).where(F.col(k).isNotNull()).distinct()
        buckets = values.agg(F.floor(F.count("*") / GRID_BUCKET) + 1).scalar()
        bucket = F.pmod(F.xxhash64(k), buckets).alias("__bucket")
        repeated = grid.withColumn("__bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), buckets - 1)))
        grid = repeated.join(values.select(k, bucket), "__bucket").drop("__bucket")
    return grid.join(df, on=list(keys), how="left").fillna(dict(fill))


def expand_years(df: DataFrame, first: Column | int, last: Column | int, out: str = "year"):
    """One row per input row and year of [first, last]; nothing when first > last."""
    first = first if isinstance(first, Column) else F.lit(first)
    last = last if isinstance(last, Column) else F.lit(last)
    years = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))
    return df.withColumn(out, F.explode(years))


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], defaults: Mapping[str, object]):
    """Left lookup with defaults for rows the dimension does not know."""
    joined = df.join(dim, on=list(on), how="left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    )


def latest_by(df: DataFrame, year: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the newest year, over the table or per key. No sort, no window."""
    if not by:
        return df.where(F.col(year) == df.agg(F.max(year)).scalar())
    newest = df.groupBy(*by).agg(F.max(year).alias(year))
    return df.join(newest, on=[*by, year], how="left_semi")
