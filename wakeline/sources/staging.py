"""Intermediate tables written once and read back.

A span-split operator reads its input twice (rows and summary). Chaining several
of them would repeat the whole upstream plan, so pipelines write the shared table
to the cluster's checkpoint folder. A written parquet table survives lost
executors, keeps column pruning and filter pushdown, and gives the optimizer real
sizes for its broadcast decisions.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint folder, else one in its warehouse.

    What is staged belongs to the application: whoever sets the folder clears it after the
    run. Only local mode goes without the setting, as a warehouse may be on one machine.
    """
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not root and not _is_local(spark.sparkContext.master):
        raise ValueError(f"set {_CONF} to a folder that the driver and all executors share")
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged").rstrip("/")


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def stage_together(**tables: DataFrame) -> list[DataFrame]:
    """``stage`` for tables that do not need each other, written at the same time.

    Each alone would leave cores idle at its last tasks and while it is planned.
    """
    session = next(iter(tables.values())).sparkSession
    write = inheritable_thread_target(session)(stage)  # threads take the caller's Spark properties along
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(write, tables.values(), tables))


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` under the checkpoint folder and return a scan of it."""
    path = f"{staging_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
