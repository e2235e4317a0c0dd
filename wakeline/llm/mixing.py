"""Mixing sources to target weights by proportionate-fair schedules.

A source of weight w gives its block i a window: released at slot floor(i / w), due at
ceil((i + 1) / w). Slots go to released blocks, earliest deadline first, so after any slot
each source has had its weight's share to within less than one block. Where sources are very
many, the rarest ones form groups: a group is scheduled like a source, and its sources in the
same way among the group's slots, each to within less than two blocks. Weights are multiples
of 1 / `PERIOD`, which makes the schedule repeat: one period is laid out once, and block i
finds its slot by its number alone.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wakeline.llm.common import fresh, map_batches, numbered
from wakeline.sources.staging import stage

BLOCK_DOCS = 16
PERIOD = 1 << 16
#: Sources that the driver lays out itself, besides those named in targets; rarer ones are laid
#: out in groups of about so many, each group in a task, within the slots of their group.
MAX_SOURCES, GROUP_SOURCES = 4096, 2048
#: Without targets a source weighs its document count to this power.
SMOOTHING = 0.7


def quotas(weights: list[float], period: int = PERIOD) -> list[int]:
    """Slots of each source in a period: largest remainders, one at least."""
    if not weights:
        return []
    share = np.array(weights, float) / sum(weights) * period
    slots = np.maximum(np.floor(share), 1).astype(int)
    order = np.argsort(-(share - np.floor(share)), kind="stable")
    i = 0
    while slots.sum() != period:
        at = order[i % len(order)]
        if slots.sum() < period:
            slots[at] += 1
        elif slots.max() > 1:
            slots[int(slots.argmax())] -= 1
        i += 1
    return slots.tolist()


def roomy(period: int, sources: int) -> int:
    """The period, doubled until each source can have 16 slots."""
    while period < 16 * sources:
        period *= 2
    return period


def lay_out(slots: list[int]) -> list[list[int]]:
    """The slot of each source's blocks in one period."""
    period, out = sum(slots), [[] for _ in slots]
    waiting = [(0, s) for s in range(len(slots))]
    ready: list[tuple[int, int]] = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * period // slots[s]), s))
        _, s = heapq.heappop(ready)
        out[s].append(slot)
        if len(out[s]) < slots[s]:
            heapq.heappush(waiting, (len(out[s]) * period // slots[s], s))
    return out


def _key(column: str) -> Column:
    """A source's name; a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def source_weights(docs: DataFrame, targets: dict[str, float] | None, source: str) -> DataFrame:
    """key, n (documents), weight and named (in targets) of every source."""
    counted = docs.groupBy(_key(source).alias("key")).agg(F.count("*").alias("n"))
    if targets is None:
        return stage(counted.select("key", "n", F.pow("n", F.lit(SMOOTHING)).alias("weight"), F.lit(False).alias("named")), "sources")
    given = [("=" + str(k) if k is not None else "", float(w)) for k, w in targets.items()]
    least = min((w for _, w in given if w > 0), default=1.0) / 10
    listed = docs.sparkSession.createDataFrame(given, "key string, given double")
    weight = F.greatest(F.coalesce("given", F.lit(least)), F.lit(least / 10)).alias("weight")
    joined = counted.join(listed, "key", "left")
    return stage(joined.select("key", "n", weight, F.col("given").isNotNull().alias("named")), "sources")


def lay_out_groups(tail: DataFrame) -> DataFrame:
    """key, group, turns (the source's in a round), size (of a round), turn and place, from key, group and weight."""
    out = T.StructType.fromDDL("key string, group long, turns long, size long, turn long, place long")
    arrow = to_arrow_schema(out)

    def lay(rows: pa.Table) -> pa.Table:
        rows = sorted(zip(*(rows[c].to_pylist() for c in ("key", "group", "weight"))))
        turns = quotas([w for *_, w in rows], roomy(PERIOD, len(rows)))
        tables, n = lay_out(turns), np.array(turns)
        columns = [
            pa.array([k for k, *_ in rows]).take(pa.array(np.repeat(np.arange(len(rows)), n))),
            np.repeat([g for _, g, _ in rows], n),
            np.repeat(n, n),
            np.full(n.sum(), n.sum()),
            np.concatenate([np.arange(x) for x in turns]),
            np.concatenate(tables),
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, arrow)], schema=arrow)

    return tail.select("key", "group", "weight").groupBy("group").applyInArrow(lay, out)


def schedule(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    source: str = "source",
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
    max_sources: int = MAX_SOURCES,
    group_sources: int = GROUP_SOURCES,
) -> DataFrame:
    """doc_id, the source column, block and slot of every row, copies of a row included.

    A source's documents stand in the order of a hash of the id and are dealt into blocks
    of ``block_docs``. ``targets`` maps source names (None: no source) to weights; sources
    without one get a small one; without targets large sources are damped. No row is
    dropped: a source that has ended leaves its slots empty. A null source is a source, equal
    rows take places one after the other, an empty table gives an empty schedule.
    """
    rows = docs.select("doc_id", F.col(source).alias("own"), F.xxhash64(*docs.columns).alias("mark"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "to-schedule")
    placed = _place(rows, targets, block_docs, period, max_sources, group_sources)
    return placed.select("doc_id", F.col("own").alias(source), "block", "slot")


def _place(
    rows: DataFrame,
    targets: dict[str, float] | None,
    block_docs: int,
    period: int,
    max_sources: int,
    group_sources: int,
) -> DataFrame:
    """doc_id, own, row, block and slot, from doc_id, own (the source), mark (a tie) and row (its number)."""
    sources = source_weights(rows, targets, "own")
    ordered = sources.orderBy(F.desc("named"), F.desc("n"), "key")
    top = ordered.limit(max(max_sources, len(targets or ()))).collect()
    entries, tail = [(r["key"], r["weight"]) for r in top], None
    rarer = sources.count() - len(top)
    if rarer:
        known = rows.sparkSession.createDataFrame([(r["key"],) for r in top], "key string")
        group = F.pmod(F.xxhash64("key"), F.lit(-(-rarer // group_sources)))
        tail = stage(sources.join(known, "key", "left_anti").withColumn("group", group), "rarer-sources")
        sums = tail.groupBy("group").agg(F.sum("weight").alias("weight"))
        entries += [(r["group"], r["weight"]) for r in sums.orderBy("group").collect()]
    period = roomy(period, len(entries))
    slots = quotas([w for _, w in entries], period)
    # by name of a source, or number of a group
    places = {key: np.array(x, np.int64) for (key, _), x in zip(entries, lay_out(slots))}
    rows = rows.withColumn("key", _key("own"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("mark"), F.col("row")]
    placed = numbered(rows, ["key"], order, "at").withColumn("block", F.expr(f"`at` div {block_docs}")).drop("at")
    if tail is None:
        placed = placed.select("*", *(F.lit(None).cast("long").alias(c) for c in ("group", "turns", "size", "place")))
    else:
        laid = stage(lay_out_groups(tail), "groups")
        shares = laid.where("turn = 0").select("key", "group", "turns", "size")
        turns = laid.select("key", "turn", "place")
        placed = placed.join(shares, "key", "left").withColumn("turn", F.col("block") % F.col("turns"))
        placed = placed.join(turns, ["key", "turn"], "left")
    out = T.StructType([*rows.select("doc_id", "own", "row").schema, *T.StructType.fromDDL("block long, slot long").fields])

    def make():
        def work(batch):
            block = batch["block"].to_numpy()
            group = batch["group"].to_pylist()
            keys = np.array([k if g is None else g for k, g in zip(batch["key"].to_pylist(), group)], object)
            turns, size, place = (batch[c].fill_null(1).to_numpy() for c in ("turns", "size", "place"))
            grouped = np.array([g is not None for g in group], bool)
            at, slot = np.where(grouped, block // turns * size + place, block), np.zeros(len(block), np.int64)
            for key in set(keys.tolist()):
                own = keys == key
                table = places[key]
                slot[own] = at[own] // len(table) * period + table[at[own] % len(table)]
            return {**{c: batch[c] for c in ("doc_id", "own", "row")}, "block": block, "slot": slot}

        return work

    return map_batches(placed, out, make)


def interleave(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    source: str = "source",
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
    max_sources: int = MAX_SOURCES,
    group_sources: int = GROUP_SOURCES,
) -> DataFrame:
    """All documents and columns, their rows in the order of the schedule.

    Partitions hold ranges of slots and are sorted, so files written from them follow the
    schedule by name and row. Columns may have any names. Rows are written once with a number
    each, by which they find their slot, so copies of a row have places of their own.
    """
    row, at, slot = (fresh(n, docs.columns) for n in ("_row", "_at", "_slot"))
    kept = stage(docs.withColumn(row, F.monotonically_increasing_id()), "to-mix")
    told = kept.select("doc_id", F.col(source).alias("own"), F.xxhash64(*docs.columns).alias("mark"), F.col(row).alias("row"))
    slots = _place(told, targets, block_docs, period, max_sources, group_sources)
    joined = kept.join(slots.select(F.col("row").alias(at), F.col("slot").alias(slot)), F.col(row) == F.col(at))
    order = (slot, row)
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
