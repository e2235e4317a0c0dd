"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.sources.staging import stage

#: Hash space of `sampled`.
_SPACE = 1 << 40


def id_remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def whole_texts(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and further columns; a null text is an empty one."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns)


def sampled(df: DataFrame, rows: int, of: int, column: str = "doc_id", seed: int = 17) -> DataFrame:
    """About ``rows`` of ``of`` rows (all, if there are no more), chosen by a hash of the id."""
    if of <= rows:
        return df
    spot = F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(_SPACE))
    return df.where(spot < F.lit(int(_SPACE * rows / of)))


def fields(docs: DataFrame, rest: str, key: str = "doc_id") -> T.StructType:
    """Schema with the table's own id type, then ``rest`` as DDL."""
    return T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(rest).fields])


def map_batches(
    df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict]]
) -> DataFrame:
    """Run ``make()(batch)`` over Arrow batches; ``make`` runs once per task and holds what a task loads.

    The function returns a record batch, or a dict of columns in the schema's order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            out = work(batch)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def with_text_columns(
    docs: DataFrame,
    ddl: str,
    make: Callable[[], Callable[[list[str]], list]],
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``carry`` columns as they are, then the columns of ``ddl``, which ``make()(texts)`` gives as arrays."""
    new = T.StructType.fromDDL(ddl)
    kept = [c for c in carry if c not in new.names]
    source = docs.select(*kept) if "text" in kept else docs.select(*kept, "text")

    def wrapped():
        inner = make()

        def work(batch):
            made = inner([x or "" for x in batch["text"].to_pylist()])
            return {**{c: batch[c] for c in kept}, **dict(zip(new.names, made, strict=True))}

        return work

    return map_batches(source, T.StructType([*docs.select(*kept).schema, *new]), wrapped)


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """The rows with ``out``: 0, 1, 2 … within ``keys`` (nulls are a key) by ``order``.

    Rows are dealt into sorted ranges of (keys, order) and written, so that a row's place in
    its range stands; a range adds what earlier ranges hold of the same keys. No task sees a
    whole key. Rows that are equal in keys and order should be told apart by a last column of
    ``order``, or they meet in one range.
    """
    by = [F.col(k).asc_nulls_first() for k in keys]
    names = ("_range", "_row", "_first", "_before", "_key")
    part, row, first, before, key = (fresh(n, rows.columns) for n in names)
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = stage(dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(row)), "ranges")
    group = F.struct(F.lit(0).alias("all"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    held = dealt.groupBy(part, group.alias(key)).agg(F.min(row).alias(first), F.count("*").alias("n"))
    # one row per key and range that it reaches into
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(part, key, first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    return (
        dealt.withColumn(key, group)
        .join(held, [part, key])
        .select(*rows.columns, (F.col(row) - F.col(first) + F.col(before)).alias(out))
    )


def sums_before(
    rows: DataFrame, key: str, at: str, values: Mapping[str, str], span: int = 1024
) -> DataFrame:
    """The rows with the totals of ``values`` (new name -> column) over smaller ``at`` of the key.

    ``at`` is a whole number that is unique in its key. Windows run inside spans of it and
    over one row per span, so a long key is not one task.
    """
    cell, total = fresh("_span", rows.columns), {o: f"_t_{o}" for o in values}
    rows = rows.withColumn(cell, F.expr(f"`{at}` div {span}"))
    earlier = Window.partitionBy(key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(key, cell).agg(*[F.sum(c).alias(total[o]) for o, c in values.items()])
    spans = spans.select(key, cell, *[F.sum(total[o]).over(earlier).alias(total[o]) for o in values])
    inside = Window.partitionBy(key, cell).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    made = {o: F.coalesce(F.sum(c).over(inside), zero) + F.coalesce(F.col(total[o]), zero) for o, c in values.items()}
    return rows.join(spans, [key, cell]).withColumns(made).drop(cell, *total.values())


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
