"""Order-dependent operators that do not put a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one
task, so a key holding a third of the table stalls the job. Here the time line
of a key is cut into *cells* ``(key, span)`` of ``span_seconds`` each:

1. inside a cell an ordinary window does the work;
2. one summary row per cell is aggregated map-side first, and a window over those
   few rows finds what each cell inherits from earlier (or later) cells;
3. the inherited value is joined back on the cell, which is also the partitioning
   of step 1, so the big side is shuffled once.

Keys are packed with the span into one struct column: struct equality treats
NULL fields as equal, which is how windows group NULL keys, and lets the window
and the join share one hash partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from wakeline.functions.dates import DAY_SECONDS, MICROS_PER_SECOND, micros
from wakeline.operators.skew import attach
from wakeline.sources.staging import stage

_CELL, _BACK = "__cell", "__cell_back"


def _cell(by: Sequence[str], ts: str, span_seconds: int) -> Column:
    span = F.floor(micros(ts) / (span_seconds * MICROS_PER_SECOND))
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(by)], span.alias("span"))


def _point(ts: str, ties: Sequence[str], **values: Column) -> Column:
    """Struct that sorts like the row order and carries values along."""
    fields = [F.col(ts).alias("t"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(ties)]]
    return F.struct(*fields, *[v.alias(n) for n, v in values.items()])


def _in_cell(ts: str, ties: Sequence[str], reverse: bool = False):
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in (ts, *ties)]
    return Window.partitionBy(_CELL).orderBy(*order)


def _across_cells(by: Sequence[str], reverse: bool = False):
    span = F.col(f"{_CELL}.span")
    keys = [F.col(f"{_CELL}.k{i}") for i in range(len(by))]
    window = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return window.orderBy(span.desc() if reverse else span.asc()).rowsBetween(
        Window.unboundedPreceding, -1
    )


def summarise_cells(
    cells: DataFrame, points: DataFrame, aggs: Mapping[str, Column], cell: str = _CELL
) -> DataFrame:
    """One row per cell of ``cells`` with aggregates over the ``points`` inside it, NULL without one.

    Aggregating structs makes Spark sort its input, so only the rows that carry a
    value go through it; the mere presence of a cell is a hash aggregation. Both are
    partitioned by cell when they are joined.
    """
    present = cells.select(cell).distinct()
    found = points.groupBy(F.col(cell).alias(_BACK)).agg(*[a.alias(n) for n, a in aggs.items()])
    return present.join(found, F.col(cell) == F.col(_BACK), "left").drop(_BACK)


def _known_points(rows: DataFrame, key: str, cols, ts: str, ties) -> DataFrame:
    """Key and one point per column, of the rows where any of ``cols`` is known."""
    points = [
        F.when(F.col(c).isNotNull(), _point(ts, ties, v=F.col(c))).alias(f"__e{i}")
        for i, c in enumerate(cols)
    ]
    some = reduce(or_, [F.col(c).isNotNull() for c in cols])
    return rows.where(some).select(key, *points)


def _with_inherited(cells: DataFrame, summary: DataFrame) -> DataFrame:
    inherited = summary.withColumnRenamed(_CELL, _BACK)
    return cells.join(inherited, F.col(_CELL) == F.col(_BACK), "left").drop(_BACK)


def _fill(df, cols, by, ts, ties, span_seconds, reverse):
    cells = df.withColumn(_CELL, _cell(by, ts, span_seconds))
    edge = F.min if reverse else F.max
    points = _known_points(cells, _CELL, cols, ts, ties)
    edges = {f"__e{i}": edge(f"__e{i}") for i in range(len(cols))}
    summary = summarise_cells(cells, points, edges)
    across = _across_cells(by, reverse)
    summary = summary.select(
        _CELL,
        *[
            F.last(f"__e{i}", ignorenulls=True).over(across)["v"].alias(f"__c{i}")
            for i in range(len(cols))
        ],
    )
    # a following frame is re-read for every row; the reversed order keeps it linear
    here = _in_cell(ts, ties, reverse).rowsBetween(Window.unboundedPreceding, 0)
    filled = _with_inherited(cells, summary).withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"__c{i}"))
            for i, c in enumerate(cols)
        }
    )
    return filled.select(*df.columns)


def locf(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Carry the last known value of ``cols`` forward in time within ``by``."""
    return _fill(df, cols, by, ts, ties, span_seconds, reverse=False)


def nocb(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Carry the next known value of ``cols`` backward in time within ``by``."""
    return _fill(df, cols, by, ts, ties, span_seconds, reverse=True)


def running_sum(
    df: DataFrame,
    value: Column,
    out: str,
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Running total of ``value`` up to and including each row."""
    cells = df.withColumn(_CELL, _cell(by, ts, span_seconds)).withColumn("__v", value)
    summary = cells.groupBy(_CELL).agg(F.sum("__v").alias("__s"))
    summary = summary.select(_CELL, F.sum("__s").over(_across_cells(by)).alias("__c"))
    here = _in_cell(ts, ties).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(F.sum("__v").over(here), F.lit(0)) + F.coalesce(F.col("__c"), F.lit(0))
    return _with_inherited(cells, summary).withColumn(out, total).drop(_CELL, "__v", "__c")


def number_rows(
    df: DataFrame,
    out: str,
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """1, 2, 3 … in time order within ``by``."""
    return running_sum(df, F.lit(1).cast("bigint"), out, by, ts, ties, span_seconds)


def sessionise(
    df: DataFrame,
    starts: Column,
    out: str,
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Group number that goes up by one at every row where ``starts`` holds."""
    flag = F.coalesce(starts, F.lit(False)).cast("bigint")
    return running_sum(df, flag, out, by, ts, ties, span_seconds)


def _neighbour(df, cols, by, ts, ties, span_seconds, reverse):
    cells = df.withColumn(_CELL, _cell(by, ts, span_seconds))
    row = _point(ts, ties, **{f"v{i}": F.col(c) for i, c in enumerate(cols.values())})
    edge = F.min if reverse else F.max
    summary = cells.groupBy(_CELL).agg(edge(row).alias("__e"))
    across = _across_cells(by, reverse)
    summary = summary.select(_CELL, F.last("__e", ignorenulls=True).over(across).alias("__c"))
    near = _with_inherited(cells, summary).withColumn(
        "__n", F.coalesce(F.lag(row).over(_in_cell(ts, ties, reverse)), F.col("__c"))
    )
    picked = {out: F.col(f"__n.v{i}") for i, out in enumerate(cols)}
    return near.withColumns(picked).drop(_CELL, "__n", "__c")


def lag_row(
    df: DataFrame,
    cols: Mapping[str, str],
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Values of the previous row; ``cols`` maps new column name -> source column."""
    return _neighbour(df, cols, by, ts, ties, span_seconds, reverse=False)


def lead_row(
    df: DataFrame,
    cols: Mapping[str, str],
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Values of the next row; ``cols`` maps new column name -> source column."""
    return _neighbour(df, cols, by, ts, ties, span_seconds, reverse=True)


def dedupe_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every group. Spark keeps one row per group before the shuffle
    (window group limit), so copies of a row never meet in one task."""
    first = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def thin_bins(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    seconds: int = 10,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """First row of every ``seconds``-wide bin, bins counted from the key's first time.

    Bins are the cells here: ``span_seconds`` is taken as elsewhere, and makes no difference.
    """
    rows = df.where(F.col(ts).isNotNull())
    # one row per key, which goes back by an equi join; the bins spread a hot key
    first = rows.groupBy(*by).agg(F.min(ts).alias("__first"))
    width = seconds * MICROS_PER_SECOND
    binned = attach(rows, first, by).withColumn(
        "__bin", F.floor((micros(ts) - micros("__first")) / width)
    )
    return dedupe_first(binned, [*by, "__bin"], [ts, *ties]).drop("__first", "__bin")


def fill_from_first(
    df: DataFrame,
    col: str,
    allowed: Sequence[str],
    starts: Column,
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Give every row of a session the ``col`` of its first row when that is in ``allowed``.

    Sessions open at rows where ``starts`` holds; rows before the first one keep
    their own value. The opening value is carried as a struct, so an opening row
    with NULL ends the previous session instead of being skipped.
    """
    opened = df.withColumn("__open", F.when(starts, F.struct(F.col(col).alias("v"))))
    carried = locf(opened, ["__open"], by, ts, ties, span_seconds)
    first = F.col("__open.v")
    value = F.when(first.isin(*allowed), first).otherwise(F.col(col))
    return carried.withColumn(col, value).drop("__open")


def pair_marks(
    marks: DataFrame,
    by: Sequence[str],
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Pair consecutive marks (1st+2nd, 3rd+4th, …) within ``by``: adds ``pair``, 1-based."""
    numbered = number_rows(marks, "__n", by, ts, ties, span_seconds)
    return numbered.withColumn("pair", F.floor((F.col("__n") - 1) / 2) + 1).drop("__n")


def before_key(
    per_key: DataFrame,
    key: str,
    sums: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
) -> DataFrame:
    """For one row per key: totals (``sums``) and last known values (``lasts``) over all
    smaller keys. Keys are dealt into even ranges, written once so that a key's range stays
    the same, and ranges are summarised first: no task sees every key, whatever their names.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    ranged = per_key.repartitionByRange(F.col(key).asc_nulls_first())
    rows = stage(ranged.withColumn("__b", F.spark_partition_id()), "keys")
    point = {o: F.when(F.col(c).isNotNull(), F.struct(F.col(key), F.col(c).alias("v"))) for o, c in lasts.items()}
    totals = rows.groupBy("__b").agg(
        *[F.sum(c).alias(f"__s_{o}") for o, c in sums.items()],
        *[F.max(p).alias(f"__l_{o}") for o, p in point.items()],
    )
    # one row per range: as many as shuffle partitions, whatever the number of keys
    buckets = Window.orderBy(F.col("__b").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = totals.select(
        F.col("__b").alias("__tb"),
        *[F.sum(f"__s_{o}").over(buckets).alias(f"__s_{o}") for o in sums],
        *[F.last(f"__l_{o}", ignorenulls=True).over(buckets)["v"].alias(f"__l_{o}") for o in lasts],
    )
    inside = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return (
        rows.join(totals, F.col("__b").eqNullSafe(F.col("__tb")), "left")
        .withColumns(
            {
                **{
                    o: F.coalesce(F.sum(c).over(inside), zero) + F.coalesce(F.col(f"__s_{o}"), zero)
                    for o, c in sums.items()
                },
                **{
                    o: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__l_{o}"))
                    for o, c in lasts.items()
                },
            }
        )
        .select(key, *sums, *lasts)
    )


@dataclass(frozen=True)
class Carry:
    """A value that rows set and later rows inherit.

    Rows where ``sets`` holds set ``value``, also to NULL. Order within a key is time, then
    ``ties``; with ``after_equal`` a row that sets nothing comes after all rows of its time that
    do. With ``over_keys`` the rows of a key before its first setting take the last one of the smaller
    keys, as a forward fill over a sorted table does.
    """

    value: Column
    sets: Column
    ties: Sequence[str] = ()
    after_equal: bool = False
    over_keys: bool = False


def carry_forward(
    df: DataFrame, carries: Mapping[str, Carry], key: str, ts: str, span_seconds: int = DAY_SECONDS
) -> DataFrame:
    """Add or replace columns by values in force, all in one pass over the cells.

    Every row gets, per name of ``carries``, what the last setting row up to itself has set, else
    NULL. The settings of a cell are summarised in one row for all names; these rows find what
    their cell inherits, from earlier cells and, where asked for, from smaller keys. So the rows
    themselves are shuffled once, whatever the number of names, and a hot key is many cells.
    """
    cells = df.withColumn(_CELL, _cell([key], ts, span_seconds))
    marked = {n: F.struct(F.when(c.sets, F.struct(c.value.alias("v"))).alias("s")).alias(f"__m_{n}") for n, c in carries.items()}
    rows = cells.select("*", *marked.values())
    is_set = {n: F.col(f"__m_{n}.s").isNotNull() for n in carries}
    points = rows.where(reduce(or_, is_set.values())).select(
        _CELL,
        *[
            F.when(is_set[n], F.struct(*_order(ts, c.ties), F.col(f"__m_{n}.s").alias("s"))).alias(f"__e_{n}")
            for n, c in carries.items()
        ],
    )
    summary = summarise_cells(cells, points, {f"__e_{n}": F.max(f"__e_{n}") for n in carries})
    over = [n for n, c in carries.items() if c.over_keys]
    across = _across_cells([key])
    held = summary.select(_CELL, *[F.last(f"__e_{n}", ignorenulls=True).over(across).alias(f"__c_{n}") for n in carries])
    if over:
        per_key = summary.groupBy(F.col(f"{_CELL}.k0").alias("__key")).agg(*[F.max(f"__e_{n}").alias(f"__e_{n}") for n in over])
        earlier = before_key(per_key, "__key", lasts={f"__p_{n}": f"__e_{n}" for n in over})
        held = held.withColumn("__key", F.col(f"{_CELL}.k0"))
        held = attach(held, earlier, ["__key"]).drop("__key")
        held = held.withColumns({f"__c_{n}": F.coalesce(f"__c_{n}", f"__p_{n}") for n in over}).drop(*[f"__p_{n}" for n in over])
    joined = _with_inherited(rows, held)
    values = {}
    for n, c in carries.items():
        late = [is_set[n].desc()] if c.after_equal else []
        order = Window.partitionBy(_CELL).orderBy(F.col(ts), *late, *c.ties)
        here = F.last(f"__m_{n}.s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        values[f"__v_{n}"] = F.coalesce(here, F.col(f"__c_{n}.s"))["v"]
    kept = [c for c in df.columns if c not in carries]
    return joined.withColumns(values).select(*kept, *[F.col(f"__v_{n}").alias(n) for n in carries])


def _order(ts: str, ties: Sequence[str]) -> list[Column]:
    return [F.col(ts).alias("t"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(ties)]]


def locf_frame(
    df: DataFrame,
    cols: Sequence[str],
    key: str,
    ts: str,
    ties: Sequence[str] = (),
    span_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Carry values forward over the whole frame in (key, time) order.

    Rows of a key before its first known value take the last value of the keys
    before it, as a forward fill over a sorted table does.
    """
    carries = {c: Carry(F.col(c), F.col(c).isNotNull(), tuple(ties), over_keys=True) for c in cols}
    return carry_forward(df, carries, key, ts, span_seconds).select(*df.columns)
