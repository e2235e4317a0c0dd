"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.sources.staging import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every node of an edge but the roots, root being the least id reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) on written tables
    until the stars stand still. Edges with a null end or equal ends are left out.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a, b)
    now = stage(pair.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u != v").select("u", "v").distinct(), "edges")
    sign = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).alias("sign")
    before, after = None, now.agg(sign).first()["sign"]
    while after["n"] and after != before:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        ends = F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))
        small = _with_least(large).select(F.explode(ends).alias("e"))
        now = stage(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), "stars")
        before, after = after, now.agg(sign).first()["sign"]
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and all its neighbours.

    Minima combine map-side into one row per node; the join back splits a node of very many
    edges, which a window would hold in one task.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.hint("merge"), "u").select("u", "v", F.least("u", "m").alias("m"))
