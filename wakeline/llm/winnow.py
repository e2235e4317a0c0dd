"""Winnowing fingerprints of whole texts.

Every run of ``k`` code points has a rolling hash; of each ``w`` neighbouring hashes the
least is kept, the rightmost of equals, with its position. Two texts that share a run of
``w + k - 1`` code points therefore share a fingerprint.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wakeline.llm.common import fields, map_batches, with_text_columns

GRAM, WINDOW = 12, 40
#: Neighbouring documents that one task walks through, about; it holds one batch of them at a time.
DOCS_PER_RANGE = 4096
#: Ranges at most, and so ids of which the driver and the tasks hold a list.
MOST_RANGES = 16_384

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(points: np.ndarray, k: int = GRAM) -> np.ndarray:
    """32-bit hashes of all runs of k code points: a polynomial by doubling, then mixed."""
    done, value, step = 1, points.astype(np.uint64) + np.uint64(1), _BASE
    whole, length, power = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if k & done:
                # runs of `length` already joined are followed by runs of `done`
                if whole is None:
                    whole = value
                else:
                    n = len(points) - length - done + 1
                    whole = whole[:n] * step + value[length : length + n]
                length += done
            if 2 * done > k:
                break
            n = len(points) - 2 * done + 1
            value = value[:n] * step + value[done : done + n]
            done, step = 2 * done, step * step
        whole = (whole ^ (whole >> np.uint64(32))) * _MIX
        return ((whole ^ (whole >> np.uint64(29))) >> np.uint64(16)) & _LOW


def winnow(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the fingerprint, by position.

    A text shorter than k has the hash of all of it at 0; one with fewer than w runs the
    least of them; an empty one nothing.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = gram_hashes(points, min(k, len(points)))
    # a larger position makes a smaller key, so that the rightmost of equal hashes wins
    keys = (hashes << np.uint64(32)) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    width, done = min(w, len(keys)), 1
    least = keys
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(keys) - width + 1], least[width - done :])
    kept = least[np.concatenate([[True], least[1:] != least[:-1]])]
    positions = (_LOW - (kept & _LOW)).astype(np.int64)
    return kept >> np.uint64(32), positions


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    return shared / union if union else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many code points from the start of the next (or all of it)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions of every whole text (array<long>, array<int>).

    Null texts count as empty and have no fingerprint; every row is its own, so equal texts
    have equal fingerprints and an empty table gives an empty one.
    """
    def make():
        def work(texts):
            made = [winnow(x, k, w) for x in texts]
            return [
                pa.array([h.astype(np.int64) for h, _ in made], pa.list_(pa.int64())),
                pa.array([p.astype(np.int32) for _, p in made], pa.list_(pa.int32())),
            ]

        return work

    return with_text_columns(docs, "hashes array<long>, positions array<int>", make)


def hex_of(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits per hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def _rank(doc_id) -> tuple:
    return (doc_id is not None, doc_id)


def range_starts(docs: DataFrame, docs_per_range: int) -> list:
    """The first id of each range of neighbouring ids, ascending, a null id first: `MOST_RANGES` at most."""
    ids = docs.select("doc_id")
    ranges = min(MOST_RANGES, max(1, -(-ids.count() // docs_per_range)))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [min(b["doc_id"].to_pylist(), key=_rank) for b in batches if b.num_rows]
        if first:
            yield pa.RecordBatch.from_pydict({"doc_id": [min(first, key=_rank)]}, schema=arrow)

    arrow = to_arrow_schema(ids.schema)
    # one row per range
    starts = ids.repartitionByRange(ranges, "doc_id").mapInArrow(least, ids.schema).collect()
    return sorted({r["doc_id"] for r in starts}, key=_rank)


def compare_neighbours(
    docs: DataFrame,
    k: int = GRAM,
    w: int = WINDOW,
    docs_per_range: int = DOCS_PER_RANGE,
    with_positions: bool = False,
) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike neighbours are.

    The next document is the next one by ascending doc_id, then text; after the last
    comes the first. Null ids come first, null texts count as empty, repeated rows are
    neighbours of each other, a single row its own, and an empty table gives an empty one.
    Columns: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (`hex_of`
    their hashes), near_edited, near_next; ``with_positions`` adds positions, where each hash of
    the fingerprint stands, in code points. Columns besides doc_id and text do not matter,
    whatever their names.

    Texts are shuffled once, into ranges of ids. A range needs one text beyond its end: the
    first document of each range is sent to the range before it as well. There are no more
    than `MOST_RANGES` ranges, so what the driver knows of them is bounded; larger ranges sort on disk
    and are walked one document at a time.
    """
    starts = range_starts(docs, docs_per_range)
    ranks = [_rank(x) for x in starts]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt_schema = T.StructType([*rows.schema, T.StructField("range", T.IntegerType()), T.StructField("beyond", T.BooleanType())])

    def deal() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch):
            ids = batch["doc_id"].to_pylist()
            own = [max(0, bisect_right(ranks, _rank(x)) - 1) for x in ids]
            again = [i for i, (x, r) in enumerate(zip(ids, own)) if x == starts[r]]
            taken = pa.array([*range(len(ids)), *again], pa.int64())
            return {
                "doc_id": batch["doc_id"].take(taken),
                "text": batch["text"].take(taken),
                "range": pa.array([*own, *((own[i] - 1) % len(starts) for i in again)], pa.int32()),
                "beyond": pa.array([False] * len(ids) + [True] * len(again), pa.bool_()),
            }

        return work

    out = fields(
        docs,
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double" + ", positions array<int>" * with_positions,
    )
    arrow = to_arrow_schema(out)

    def compared(doc_id, text: str, found: tuple[np.ndarray, np.ndarray], following: str, others: tuple) -> dict:
        own, other = found[0], others[0]
        changed = edited(text, following)
        changed_hashes = winnow(changed, k, w)[0]
        return {
            "doc_id": doc_id,
            "n_chars": len(text),
            "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
            "fingerprint": hex_of(own),
            "edited_fingerprint": hex_of(changed_hashes),
            "near_edited": likeness(own, changed_hashes),
            "near_next": likeness(own, other),
            **({"positions": found[1].tolist()} if with_positions else {}),
        }

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ended = None, False
        for batch in batches:
            made = []
            for doc_id, text, beyond in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "beyond"))):
                if ended:
                    break
                now = (doc_id, text, winnow(text, k, w))
                if before is not None:
                    made.append(compared(*before, *now[1:]))
                before, ended = now, beyond
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    dealt = map_batches(rows, dealt_schema, deal)
    ordered = dealt.repartitionById(max(1, len(starts)), "range").sortWithinPartitions("beyond", "doc_id", "text")
    return ordered.select("doc_id", "text", "beyond").mapInArrow(walk, out)
