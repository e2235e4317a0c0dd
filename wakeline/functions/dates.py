"""Date and clock-time expressions used by the survey tables.

Survey clocks are local wall-clock times (``timestamp_ntz``), so nothing here
depends on the session time zone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

MICROS_PER_SECOND = 1_000_000
DAY_SECONDS = 86_400

# First month of each season, and the season names.
SEASONS = ("SUMMER", "AUTUMN", "WINTER", "SPRING")

# Trips whose month alone gives the wrong season (year, month, season).
SEASON_OVERRIDES = ((2015, 12, "SPRING"), (2019, 12, "SPRING"))

# Fixed value: the month in which a new calf-year starts.
CALF_YEAR_START_MONTH = 9


def _micros_sql(ts: str) -> str:
    minutes = f"hour({ts}) * 60 + minute({ts})"
    seconds = f"unix_date(cast({ts} AS date)) * {DAY_SECONDS}L + ({minutes}) * 60"
    fraction = f"cast(extract(SECOND FROM {ts}) * {MICROS_PER_SECOND} AS bigint)"
    return f"(({seconds}) * {MICROS_PER_SECOND}L + {fraction})"


def micros(ts: str) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock time, independent of the session zone.

    ``ts`` is a column name or SQL expression; here and below one parsed expression
    replaces dozens of calls into the JVM per use.
    """
    return F.expr(_micros_sql(ts))


def seconds_between(start: str, end: str) -> Column:
    return F.expr(f"({_micros_sql(end)} - {_micros_sql(start)}) / {MICROS_PER_SECOND}D")


def minutes_between(start: str, end: str) -> Column:
    return F.expr(f"({_micros_sql(end)} - {_micros_sql(start)}) / {60 * MICROS_PER_SECOND}D")


def parse_ts(text: Column, fmt: str) -> Column:
    """Wall-clock timestamp from text; unparseable text gives NULL."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def trip_code(date: Column) -> Column:
    return F.date_format(date, "yyyy_MM")


def trip_month(trip: str) -> str:
    """SQL text of the month number in a ``yyyy_MM`` trip code."""
    return f"try_cast(substring({trip}, 6, 2) AS int)"


def season(
    month: str, year: str | None = None, overrides: Iterable[tuple[int, int, str]] = ()
) -> Column:
    """Southern-hemisphere season of a month, with (year, month, season) overrides first.

    ``month`` and ``year`` are column names or SQL expressions.
    """
    special = "".join(
        f"WHEN {month} = {m} AND {year} = {y} THEN '{name}' " for y, m, name in overrides
    )
    return F.expr(
        f"""CASE {special}
          WHEN {month} <= 2 OR {month} = 12 THEN 'SUMMER'
          WHEN {month} BETWEEN 3 AND 5 THEN 'AUTUMN'
          WHEN {month} BETWEEN 6 AND 8 THEN 'WINTER'
          WHEN {month} BETWEEN 9 AND 11 THEN 'SPRING' END"""
    )


def calf_year(date: Column) -> Column:
    """Calendar year, moved on by one from September."""
    return F.year(date) + (F.month(date) >= CALF_YEAR_START_MONTH).cast("int")


def shift_years(date: Column, years: int) -> Column:
    """Whole years away; 29 February clamps to 28 February."""
    return F.add_months(date, 12 * years)


def date_range_text(first: Column, last: Column) -> Column:
    return F.concat(F.date_format(first, "dd MMM"), F.lit("–"), F.date_format(last, "dd MMM"))
