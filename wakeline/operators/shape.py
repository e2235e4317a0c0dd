"""Cleaning, schema drift, pivots and grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from wakeline.operators.skew import attach


def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Empty text becomes NULL, in the named columns or in every text column."""
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cols})


def ensure_columns(df: DataFrame, names: Sequence[str], default: object) -> DataFrame:
    """Add the columns that are absent, filled with ``default``."""
    absent = [c for c in names if c not in df.columns]
    return df.withColumns({c: F.lit(default) for c in absent}) if absent else df


def normalise_schema(
    df: DataFrame,
    aliases: Mapping[str, str] | None = None,
    casts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rename whichever old names are present, then cast text that may not parse to NULL."""
    present = {old: new for old, new in (aliases or {}).items() if old in df.columns}
    df = df.withColumnsRenamed(present)
    return df.withColumns(
        {c: F.col(c).try_cast(t) for c, t in (casts or {}).items() if c in df.columns}
    )


def recode(df: DataFrame, col: str, rules: Mapping[str, str]) -> DataFrame:
    """Map values matching a regex to a canonical value, first rule wins."""
    value = F.col(col)
    result = None
    for pattern, to in rules.items():
        result = (F if result is None else result).when(value.rlike(pattern), to)
    return df if result is None else df.withColumn(col, result.otherwise(value))


def level_rank(col: Column, levels: Sequence[str]) -> Column:
    """1-based position of a value in an explicit level list; unknown values come last."""
    rank = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(rank > 0, rank).otherwise(F.lit(len(levels) + 1))


def pivot_counts(
    df: DataFrame, rows: Sequence[str], col: str, values: Sequence[str]
) -> DataFrame:
    """Counts with one bigint column per listed value, zero where there is none."""
    cells = [F.count_if(F.col(col) == v).cast("bigint").alias(v) for v in values]
    return df.groupBy(*rows).agg(*cells)


def share_of_total(df: DataFrame, by: Sequence[str], within: Sequence[str]) -> DataFrame:
    """``n`` per ``by``, total per ``within`` and their ratio.

    The window runs over the grouped counts, not over the rows.
    """
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*within))
    return counted.withColumn("n_tot", total).withColumn("prop", F.col("n") / F.col("n_tot"))


def with_group_stats(
    df: DataFrame, by: Sequence[str], stats: Mapping[str, Column]
) -> DataFrame:
    """Group aggregates kept on every row.

    Aggregated map-side first and attached over salts: a window over the rows would
    hold a whole group in one task.
    """
    grouped = df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])
    return attach(df, grouped, by)


def explode_vertices(layer: DataFrame, rings: str = "rings") -> DataFrame:
    """Feature rings (array of array of struct<x,y>) to one row per vertex."""
    rest = [c for c in layer.columns if c != rings]
    parts = layer.select(*rest, F.posexplode(rings).alias("part", "__ring"))
    verts = parts.select(*rest, "part", F.posexplode("__ring").alias("seq", "__xy"))
    return verts.select(
        *rest, "part", "seq", F.col("__xy.x").alias("x"), F.col("__xy.y").alias("y")
    )
