"""Attaching per-key values to rows when one key may hold a large share of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def key_struct(keys: Sequence[str]) -> Column:
    """Keys as one struct: NULL fields compare equal, unlike NULL join keys."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join a table of one row per key onto the rows, NULL keys included.

    A plain equi join: neither side is repeated. The partition of a hot key is one large
    side against one row, which adaptive skew handling splits by rows at run time; when the
    per-key side turns out small, Spark broadcasts it from its measured size instead.
    """
    values = [c for c in per_key.columns if c not in keys]
    right = per_key.select(key_struct(keys).alias("__g"), *values)
    left = rows.withColumn("__k", key_struct(keys))
    return left.join(right, F.col("__k") == F.col("__g"), "left").select(*rows.columns, *values)
