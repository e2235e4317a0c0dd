"""Byte-level BPE with a local rank file."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wakeline.llm.common import fields, map_batches, whole_texts

#: Code points handed to the library at once; longer texts are cut at safe boundaries.
PIECE = 1 << 16
#: A token never holds a white-space character after another character, so the
#: split pattern always starts a new match there, whatever stands before or after.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def load_encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """Cut a text at safe boundaries into parts of about ``size``; a part without one stays whole."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    return [*parts, text[start:]]


def encode_text(encoding: tiktoken.Encoding, text: str, size: int = PIECE) -> np.ndarray:
    parts = [encoding.encode_ordinary(part) for part in pieces(text, size)]
    return np.concatenate([np.asarray(p, "<u4") for p in parts])


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, piece: int = PIECE) -> DataFrame:
    """doc_id and the text's token ids (array<int>).

    Every text is encoded whole, without special tokens: their strings are ordinary
    text. Null and empty texts give an empty array; repeated rows give a row each; an
    empty table gives an empty one; columns other than doc_id and text are not read.
    ``rank_file`` is a path that every executor has.
    """

    def make():
        encoding = load_encoding(rank_file, pattern)

        def work(batch):
            ids = [encode_text(encoding, t, piece) for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
            return {"doc_id": batch["doc_id"], "ids": pa.ListArray.from_arrays(ends, flat)}

        return work

    return map_batches(whole_texts(docs), fields(docs, "ids array<int>"), make)


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, column: str = "ids") -> DataFrame:
    """The table with its ids replaced by the raw bytes they stand for (``decoded``, binary).

    Bytes are never repaired: ids that cut a character in two give broken UTF-8 back as it
    was. A null array gives null, an empty one empty bytes.
    """
    rest = [c for c in encoded.columns if c not in (column, "decoded")]

    def make():
        encoding = load_encoding(rank_file, pattern)

        def work(batch):
            raw = [None if x is None else encoding.decode_bytes(x) for x in batch[column].to_pylist()]
            return {**{c: batch[c] for c in rest}, "decoded": pa.array(raw, pa.binary())}

        return work

    schema = T.StructType([*encoded.select(*rest).schema, T.StructField("decoded", T.BinaryType())])
    return map_batches(encoded.select(*rest, column), schema, make)


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str, piece: int = PIECE) -> DataFrame:
    """doc_id, ids_le (ids as little-endian unsigned 32-bit integers) and the decoded bytes.

    Same rules as `encode_documents`; the round trip stays inside one task.
    """

    def make():
        encoding = load_encoding(rank_file, pattern)

        def work(batch):
            ids = [encode_text(encoding, t, piece) for t in batch["text"].to_pylist()]
            return {
                "doc_id": batch["doc_id"],
                "ids_le": pa.array([x.tobytes() for x in ids], pa.binary()),
                "decoded": pa.array([encoding.decode_bytes(x.tolist()) for x in ids], pa.binary()),
            }

        return work

    return map_batches(whole_texts(docs), fields(docs, "ids_le binary, decoded binary"), make)
