"""Session helpers: the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or groups at once. Adaptive execution joins partitions up to a number of compressed bytes, which
#: narrow rows reach only after many millions.
TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read, taken from ``spark.checkpoint.dir``.

    Where neither the setting nor the context names one, a temporary folder is made if the session runs
    on this machine alone, as in tests; on a cluster, whose executors would not see it, that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plantledger-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier call has used."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and cut its lineage there.

    Needed where a later step reads the same rows twice and both reads must see
    one placement of rows, also after an executor is lost.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parts_for(rows: int) -> int:
    """Tasks of ``TASK_ROWS`` rows that so many rows make."""
    return -(-rows // TASK_ROWS)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about so many ``rows``, dealt by ``keys`` to tasks of about ``TASK_ROWS``; where that is fewer tasks than
    the session runs at a time, Spark's own choice stands."""
    parts = parts_for(rows)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df
