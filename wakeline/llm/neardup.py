"""Near-duplicates by tensored MinHash banding, with exact links.

Two collections of ``m`` bands (``r`` MinHash values each) make ``m * m`` tables: the key of
table (i, j) joins band i of the first collection with band j of the second, so 2*m*r
values serve where independent tables would need m*m*2*r. Documents that share a key form
candidate groups. Within a group, links are decided on full shingle sets, so keys only ever
add work, and a link is lost only if every key misses it and every path of keys around it.

Equal sets are one class from the start. A group larger than a chunk is never taken whole:
each chunk is compared in itself and with the group's leaders, which joins nearly all of
it; what then is still apart from the group's largest part is compared with every chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wakeline.llm.common import fields, map_batches
from wakeline.llm.graph import components
from wakeline.sources.staging import stage

SHINGLE, PERCENT = 3, 85
#: Bands in each of the two collections, and values in a band.
BANDS, BAND_VALUES = 12, 4
#: Documents compared with each other in one task, and leaders of a larger group, about.
CHUNK, LEADERS = 1024, 128
_COLUMNS = 1 << 14
#: Shingles up to which all multipliers are taken at once.
_LONG = 1024

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _ODD[by % 3]
        return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words (A-Z lowered); of all words, if there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(own))
    out = np.full(len(own) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = _mixed(out + own[i : i + len(out)], i)
    return np.unique(out)


def band_multipliers(bands: int = BANDS, values: int = BAND_VALUES) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, 2 * bands * values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(shingles: np.ndarray, multipliers: np.ndarray, values: int = BAND_VALUES) -> np.ndarray:
    """One hash per band, first collection first."""
    with np.errstate(over="ignore"):
        if len(shingles) > _LONG:  # one multiplier at a time, whose products stay in cache
            least = np.array([_mixed(shingles * m, 1).min() for m in multipliers])
        else:
            least = _mixed(shingles * multipliers[:, None], 1).min(1)
        least = least.reshape(-1, values)
        out = np.arange(len(least), dtype=np.uint64)
        for i in range(values):
            out = _mixed(out + least[:, i], i)
    return out


def linked_stars(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the least index of its component under links of ``percent`` Jaccard similarity."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(number) > 1
    renumber = np.cumsum(shared) - 1
    row, number = row[shared[number]], renumber[number[shared[number]]]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    common = np.zeros((n, n))
    for start in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(number, [start, start + _COLUMNS])
        hold = np.zeros((n, min(_COLUMNS, int(shared.sum()) - start)), np.float32)
        hold[row[a:b], number[a:b] - start] = 1
        common += hold @ hold.T
    union = sizes[:, None] + sizes[None, :] - common
    link = (100 * common >= percent * union) & (union > 0)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(link, label[None, :], n).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _sketches(docs: DataFrame, size: int, bands: int, values: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set) and bands of every row."""
    multipliers = band_multipliers(bands, values)

    def make():
        def work(batch):
            counts, marks, hashed = [], [], []
            for text in batch["text"].to_pylist():
                own = shingle_hashes(text or "", size)
                counts.append(len(own))
                marks.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                hashed.append(band_hashes(own, multipliers, values).view(np.int64) if len(own) else None)
            return {
                "doc_id": batch["doc_id"],
                "n_shingles": pa.array(counts, pa.int64()),
                "set_hash": pa.array(marks, pa.binary()),
                "bands": pa.array(hashed, pa.list_(pa.int64())),
            }

        return work

    schema = fields(docs, "n_shingles long, set_hash binary, bands array<long>")
    return stage(map_batches(docs.select("doc_id", "text"), schema, make), "sketches")


def _candidate_groups(classes: DataFrame, bands: int) -> DataFrame:
    """(id, root) of classes that are joined by shared table keys."""
    one = classes.select("id", F.posexplode("bands").alias("band", "hash"))
    # a key of table (i, j) is only shared where band i and band j are; a band of very many classes
    # is one row on the right, and its rows on the left are split by adaptive execution
    several = one.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = one.join(several.hint("merge"), ["band", "hash"])
    own = shared.groupBy("id").agg(F.collect_list(F.struct("band", "hash")).alias("own"))  # at most 2 * bands

    def make():
        def work(batch):
            ids, keys = [], []
            for i, own in zip(batch["id"].to_pylist(), batch["own"].to_pylist()):
                band = np.array([x["band"] for x in own])
                value = np.array([x["hash"] for x in own], np.int64).view(np.uint64)
                with np.errstate(over="ignore"):
                    first, second = _mixed(value[band < bands], 0), value[band >= bands]
                    made = _mixed(first[:, None] + second[None, :], 2).ravel()
                keys.append(made)
                ids += [i] * len(made)
            joined = np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)
            return {"key": pa.array(joined), "id": pa.array(ids, batch["id"].type)}

        return work

    keys = map_batches(own, T.StructType([T.StructField("key", T.LongType()), classes.schema["id"]]), make)
    keys = stage(keys, "keys")
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    led = keys.join(leaders.select("key", "leader").hint("merge"), "key").where("leader != id")
    return components(led.select("leader", "id").distinct(), "leader", "id")


def _compare(rows: DataFrame, cell: list[str], size: int, percent: int) -> DataFrame:
    """Star edges (a, b) of what is linked within each cell; a task holds one cell at a time."""
    schema = T.StructType([T.StructField("a", rows.schema["id"].dataType), T.StructField("b", rows.schema["id"].dataType)])
    arrow = to_arrow_schema(schema)

    def stars(held: list[tuple]) -> list[dict]:
        if len({i for i, _ in held}) < 2:
            return []
        label = linked_stars([shingle_hashes(t or "", size) for _, t in held], percent)
        return [{"a": held[r][0], "b": held[i][0]} for i, r in enumerate(label) if held[r][0] != held[i][0]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            made = []
            for *key, i, text in zip(*(batch[c].to_pylist() for c in (*cell, "id", "text"))):
                if key != now:
                    made += stars(held)
                    now, held = key, []
                held.append((i, text))
            yield pa.RecordBatch.from_pylist(made, schema=arrow)
        yield pa.RecordBatch.from_pylist(stars(held), schema=arrow)

    return rows.select(*cell, "id", "text").repartition(*cell).sortWithinPartitions(*cell).mapInArrow(walk, schema)


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    values: int = BAND_VALUES,
    chunk: int = CHUNK,
    leaders: int = LEADERS,
) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (it is its own).

    A link means that shared shingles are ``percent`` of all shingles of both or more.
    Texts that are null or hold no word have no shingles and are linked with nothing. Rows
    with equal doc_id are one document, linked by any of its texts; rows with a null
    doc_id are linked with nothing, have a null component and are kept. An empty table
    gives an empty one; columns other than doc_id and text are not read.
    """
    sketches = _sketches(docs, size, bands, values)
    named = sketches.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    least = named.groupBy("set_hash").agg(F.min("doc_id").alias("id"))
    classes = stage(
        named.withColumnRenamed("doc_id", "id").join(least, ["set_hash", "id"]).select("set_hash", "id", "bands").distinct(),
        "classes",
    )
    joined = _candidate_groups(classes, bands)
    grouped = joined.unionAll(joined.select(F.col("root").alias("id"), "root")).distinct()
    sized = grouped.groupBy("root").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    spot = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    led = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("n") / leaders)) == 0)
    # a merge join at every size: the ids grow with the documents, so they are never broadcast
    members = stage(
        docs.select(F.col("doc_id").alias("id"), "text")
        .join(grouped.join(sized, "root").select("id", "root", "n", "chunks").hint("merge"), "id")
        .select("root", "id", "text", "chunks", spot.alias("chunk"), led.alias("leader")),
        "members",
    )
    # leaders stand in every chunk of their group
    every = F.when(F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = stage(_compare(members.withColumn("chunk", F.explode(every)), ["root", "chunk"], size, percent), "links")
    edges = first.unionAll(_apart(members, components(first), chunk, size, percent))
    found = components(edges.unionAll(_same_document(named, classes)))
    class_root = classes.join(found, "id", "left").select("set_hash", F.coalesce("root", "id").alias("component"))
    return sketches.join(class_root, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def _apart(members: DataFrame, joined: DataFrame, chunk: int, size: int, percent: int) -> DataFrame:
    """Edges between members of large groups that are not yet joined with the group's largest part."""
    own = joined.select("id", F.col("root").alias("part"))
    large = members.where("chunks > 1").join(own, "id", "left").withColumn("part", F.coalesce("part", "id"))
    parts = large.groupBy("root", "part").agg(F.count("*").alias("n"))
    largest = F.max_by("part", F.struct("n", "part")).alias("most")
    most = parts.groupBy("root").agg(largest, F.sum("n").alias("all"), F.max("n").alias("top"))
    blocks = F.ceil((F.col("all") - F.col("top")) / chunk).cast("int")
    known = stage(large.join(most.select("root", "most", blocks.alias("blocks")), "root").where("blocks > 0"), "apart")
    block = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = known.where("part != most").withColumn("block", block).withColumn("chunk", up_to("chunks"))
    inner = known.withColumn("block", up_to("blocks"))
    columns = ("root", "chunk", "block", "id", "text")
    return _compare(outer.select(*columns).unionAll(inner.select(*columns)), ["root", "chunk", "block"], size, percent)


def _same_document(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes that rows of one doc_id with different texts are in."""
    ids = named.groupBy("doc_id").agg(F.count_distinct("set_hash").alias("sets")).where("sets > 1").select("doc_id")
    owned = named.join(ids, "doc_id", "left_semi").join(classes.select("set_hash", "id"), "set_hash")
    return owned.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without those that are linked to one with a lesser doc_id; all columns."""
    gone = near_duplicates(docs, **parameters).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
