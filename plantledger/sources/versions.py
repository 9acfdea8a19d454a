"""Rows kept under a run's id until they are taken back: snapshots, and markers of what a run has touched.

A recorded run is never written over. What has been taken back is written beside it, so an entry is open while no retirement names
its run and key, and readers on any machine see the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plantledger.sources.tables import stored

RUN = "run_id"


def record(rows: DataFrame, path: str, run_id: str) -> None:
    """Keep ``rows`` as the run ``run_id``; a run that exists already is an error."""
    rows.write.mode("errorifexists").parquet(f"{path}/entries/{RUN}={run_id}")


def entries(spark: SparkSession, path: str, schema: StructType, run_id: str | None = None) -> DataFrame:
    """Recorded rows with their ``run_id``, of one run or of all."""
    found = stored(spark, f"{path}/entries", StructType([*schema.fields, StructField(RUN, StringType())]))
    return found if run_id is None else found.filter(F.col(RUN) == run_id)


def retire(rows: DataFrame, path: str, keys: Sequence[str], by: str) -> None:
    """Close the entries that ``rows`` names by ``run_id`` and ``keys``; ``by`` names the run that does."""
    rows.select(F.col(RUN).alias("_of"), *keys).write.mode("overwrite").parquet(f"{path}/retired/by={by}")


def open_entries(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """Entries that no retirement names."""
    done = stored(spark, f"{path}/retired", StructType([StructField("_of", StringType()), *(schema[k] for k in keys)]))
    mine = entries(spark, path, schema)
    same = [F.col(RUN) == F.col("_of"), *(F.col(k).eqNullSafe(F.col(f"_retired_{k}")) for k in keys)]
    return mine.join(done.select("_of", *(F.col(k).alias(f"_retired_{k}") for k in keys)), same, "left_anti")
