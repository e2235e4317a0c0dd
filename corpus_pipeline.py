"""A corpus pipeline of the training-data operators, from raw documents to token ids.

Each stage takes the documents that its predecessor kept, as written and read back.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import bpe, mixing, neardup, pii, quality
from wakeline.sources.staging import staging_root

#: Classifiers and graph steps are not SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return neardup.keep_one(docs, size=5, percent=80, bands=12, values=3)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that gives each source its target weight."""
    return mixing.interleave(docs)


def with_position(docs: DataFrame) -> DataFrame:
    """doc_id, text and position: number of the file that holds the row, then the row's number in it.

    Files of a sorted table are numbered in its order. Rows that come from no file stand as they come.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("position"))
    number = lambda group: F.coalesce(
        F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-.*?(?:-c(\d+))?\.", group).try_cast("long"), F.lit(0)
    )
    return docs.select(
        "doc_id", "text", (number(1) * 2**43 + number(2) * 2**36 + F.col("_metadata.row_index")).alias("position")
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position, n_tokens, ids_le (little-endian unsigned 32-bit ids) and the decoded bytes' digest.

    ``position`` ascends in the order in which the mixing stage wrote the documents, which a
    reader of many files does not keep.
    """
    rank_file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    placed = with_position(docs).select(F.struct("doc_id", "position").alias("doc_id"), "text")
    done = bpe.encode_and_decode(placed, rank_file, public_tokenizers.PATTERN)
    return done.select(
        "doc_id.doc_id",
        "doc_id.position",
        (F.length("ids_le") / 4).cast("long").alias("n_tokens"),
        "ids_le",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", reject_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; all but the last are written under the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{staging_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
