"""Exact repeats of historical texts, found through a minimal perfect hash of their digests.

The history's distinct SHA-256 digests are dealt by their own bits into buckets of about
``BUCKET`` digests. Inside a bucket, digests fall into groups of about four; each group gets the
least *pilot* that sends all its digests to free slots (hash and displace), so that a bucket of n
digests fills n slots exactly. With a bucket's first slot before them, slots of all buckets number
the history's distinct texts from 0 without a gap. Two tables make the index:

* ``buckets``: bucket, its first slot, its size, the bits in use, one pilot per group;
* ``slots``: slot, the full digest and byte length, the winner's locator, the number of rows.

A lookup computes a slot from a bucket row and compares the slot's whole digest and length: a text
that is not in the history also lands on some slot, and is told apart there. Both steps are
equi joins of distinct digests, so a text that a third of all rows repeat is one row in them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import whole_texts
from wakeline.operators.ordered import before_key
from wakeline.sources.staging import stage

#: Digests in a bucket, on average, and in a group of one pilot.
BUCKET, GROUP = 2048, 4
#: Displacement is taken modulo this prime.
PRIME = 2**31 - 1
#: Pilots tried before a bucket turns to other bits of its digests.
PILOTS = 1 << 22
#: First byte (from 1) of the two displacement numbers, for each choice of bits.
_BITS = ((12, 16), (20, 24))


@dataclass(frozen=True)
class Index:
    """``buckets``: bucket, start, size, bits, pilots; ``slots``: slot, digest, n_bytes, winner, n_rows."""

    buckets: DataFrame
    slots: DataFrame
    n_buckets: int

    def save(self, path: str) -> None:
        """Write both tables below ``path``."""
        self.buckets.withColumn("n_buckets", F.lit(self.n_buckets)).write.parquet(f"{path}/buckets")
        self.slots.write.parquet(f"{path}/slots")


def load(spark: SparkSession, path: str) -> Index:
    buckets = spark.read.parquet(f"{path}/buckets")
    first = buckets.select("n_buckets").first()
    return Index(buckets.drop("n_buckets"), spark.read.parquet(f"{path}/slots"), first[0] if first else 1)


def digest_rows(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """doc_id, row (a number of its own), digest (32 bytes) and n_bytes of every text, written once.

    A null text is an empty one. Other columns of ``docs`` do not matter.
    """
    text = F.col("text")
    rows = whole_texts(docs, *columns).withColumns(
        {
            "digest": F.unhex(F.sha2(text, 256)),
            "n_bytes": F.octet_length(text).cast("long"),
            "row": F.monotonically_increasing_id(),
        }
    )
    return stage(rows.drop("text"), "digests")


def distinct_texts(rows: DataFrame) -> DataFrame:
    """digest, n_bytes, winner (doc_id, row; the largest) and n_rows of every distinct text."""
    return rows.groupBy("digest", "n_bytes").agg(
        F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("n_rows")
    )


def _bytes(first: int, length: int) -> Column:
    """Some bytes of the digest as a whole number."""
    return F.conv(F.hex(F.substring("digest", first, length)), 16, 10).cast("long")


def _bucket(n_buckets: int) -> Column:
    return F.pmod(_bytes(1, 7), F.lit(n_buckets))


def _number(digests: np.ndarray, first: int) -> np.ndarray:
    return digests[:, first - 1 : first + 3].astype(np.int64) @ (256 ** np.arange(3, -1, -1, dtype=np.int64))


def fill_bucket(digests: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, pilot of each group, slot of each digest) for distinct digests, n × 32 bytes."""
    n = len(digests)
    groups = _number(digests, 8) % -(-n // GROUP)
    order = np.argsort(groups, kind="stable")
    starts = np.searchsorted(groups[order], np.arange(-(-n // GROUP) + 1))
    members = [order[a:b] for a, b in zip(starts, starts[1:])]
    for bits, (at, step) in enumerate(_BITS):
        one, two = _number(digests, at), _number(digests, step)
        free, slots = np.ones(n, bool), np.empty(n, np.int64)
        pilots = np.zeros(len(members), np.int32)
        for g in sorted(range(len(members)), key=lambda g: -len(members[g])):
            found = _pilot(one[members[g]], two[members[g]], free)
            if found is None:
                break
            pilots[g], slots[members[g]] = found
            free[slots[members[g]]] = False
        else:
            return bits, pilots, slots
    raise ValueError("no perfect hash for a bucket: its digests agree in all bits in use")


def _pilot(one: np.ndarray, two: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The least pilot that sends the group to distinct free slots, and these slots."""
    tried, step = 0, 32
    while tried < PILOTS:
        pilots = np.arange(tried, tried + step, dtype=np.int64)
        at = (one + pilots[:, None] * two) % PRIME % len(free)
        fits = free[at].all(axis=1)
        if len(one) > 1:
            fits &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
        if fits.any():
            best = int(fits.argmax())
            return int(pilots[best]), at[best]
        tried, step = tried + step, min(step * 2, 8192)
    return None


def _fill(table: pa.Table) -> pa.Table:
    """One row for the bucket: bits, pilots, and its digests, each with its slot."""
    digests = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, 32)
    bits, pilots, slots = fill_bucket(digests)
    return pa.table(
        {
            "bucket": table["bucket"][:1],
            "size": pa.array([len(slots)], pa.int64()),
            "bits": pa.array([bits], pa.int32()),
            "pilots": pa.array([pilots], pa.list_(pa.int32())),
            "digests": pa.array([table["digest"].to_pylist()], pa.list_(pa.binary())),
            "places": pa.array([slots], pa.list_(pa.int64())),
        }
    )


def build(texts: DataFrame) -> Index:
    """Index of distinct texts (see ``distinct_texts``). No text makes an index without a row."""
    texts = stage(texts, "texts")
    n_buckets = max(1, -(-texts.count() // BUCKET))
    keyed = texts.select("digest", _bucket(n_buckets).alias("bucket"))
    filled = stage(
        keyed.groupBy("bucket").applyInArrow(
            _fill, "bucket long, size long, bits int, pilots array<int>, digests array<binary>, places array<long>"
        ),
        "filled",
    )
    starts = before_key(filled.select("bucket", "size"), "bucket", sums={"start": "size"})
    buckets = stage(filled.join(starts, "bucket").drop("digests", "places"), "buckets")
    placed = filled.join(starts, "bucket").select("start", F.explode(F.arrays_zip("digests", "places")).alias("x"))
    placed = placed.select((F.col("start") + F.col("x.places")).alias("slot"), F.col("x.digests").alias("digest"))
    return Index(buckets, stage(placed.join(texts, "digest").select("slot", *texts.columns), "slots"), n_buckets)


def slot_of(texts: DataFrame, index: Index) -> DataFrame:
    """``texts`` with ``slot``, the one that its digest hashes to: its own, or anyone's if it is no member."""
    group = F.pmod(_bytes(8, 4), F.ceil(F.col("size") / GROUP)).cast("int")
    one, two = (F.when(F.col("bits") == 0, _bytes(a, 4)).otherwise(_bytes(b, 4)) for a, b in zip(*_BITS))
    place = (one + F.get("pilots", group).cast("long") * two) % PRIME % F.col("size")
    return (
        texts.withColumn("bucket", _bucket(index.n_buckets))
        .join(index.buckets, "bucket", "left")
        .select(*texts.columns, (F.col("start") + place).alias("slot"))
    )


def look_up(texts: DataFrame, index: Index) -> DataFrame:
    """``texts`` with ``slot``, ``old_winner`` and ``old_rows`` of the equal historical text, null for nonmembers."""
    held = index.slots.select(
        F.col("slot").alias("at"),
        F.col("digest").alias("held"),
        F.col("n_bytes").alias("held_bytes"),
        F.col("winner").alias("old_winner"),
        F.col("n_rows").alias("old_rows"),
    )
    same = (F.col("held") == F.col("digest")) & (F.col("held_bytes") == F.col("n_bytes"))
    joined = slot_of(texts, index).join(held, F.col("slot") == F.col("at"), "left")
    return joined.select(
        *texts.columns,
        *[F.when(same, F.col(c)).alias(c) for c in ("slot", "old_winner", "old_rows")],
    )


def find_repeats(docs: DataFrame, is_history: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and in_history of every row.

    ``is_history`` marks the rows that the index is made of; all others are a new batch. Of
    equal texts the row with the largest doc_id stays, wherever it is: a new row that repeats a
    slot's text takes the slot over if its id is larger. Nonmembers are grouped by themselves.
    A null text is an empty one. A null id is smaller than any other (keep_id is null where a text
    has no other), and of rows that share text and id exactly one is kept. ``is_history`` may
    use doc_id; null counts as false. An empty table gives no rows; other columns do not matter.
    """
    rows = digest_rows(docs.withColumn("in_history", F.coalesce(is_history, F.lit(False))), "in_history")
    index = build(distinct_texts(rows.where("in_history")))
    found = stage(look_up(distinct_texts(rows.where("NOT in_history")), index), "found")
    repeats = found.where("slot IS NOT NULL").select(
        "slot", F.col("winner").alias("new_winner"), F.col("n_rows").alias("new_rows")
    )
    old = index.slots.join(repeats, "slot", "left").select(
        "digest",
        F.greatest("winner", "new_winner").alias("winner"),
        (F.col("n_rows") + F.coalesce("new_rows", F.lit(0))).alias("group_size"),
    )
    new = found.where("slot IS NULL").select("digest", "winner", F.col("n_rows").alias("group_size"))
    return rows.join(old.unionAll(new), "digest").select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "in_history",
    )
