"""Incremental replication of a change feed into a keyed table.

Every micro-batch is reduced to one row per key and written under its own batch number; a batch that runs
again after a failure overwrites its own folder, so delivery may repeat and the table stays right. Readers
resolve versions by key when they read (one combinable aggregate), and ``compact`` folds old batches into a
new base from time to time, so a batch costs its own rows and not those of the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plantledger.operators.ordering import latest

BATCH = "_batch"
POLICIES = ("update", "skip")
#: States in which a job has come to an end.
TERMINAL = ("done", "permanently_failed")


def replicate(
    stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], policy: str = "update"
) -> None:
    """Run the feed to its present end into the table at ``path`` (rows, checkpoint and metrics below it).

    ``update`` keeps the newest version per key, ``skip`` the first one that arrived. Versions with the same
    watermark are told apart by the further ``order`` columns; a version with no watermark is older than any
    other, so it never replaces one. Rows are taken by file offset, so one that ties with or is older than
    the last watermark is not lost.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown conflict policy {policy!r}")

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        watched = batch.observe(seen, F.count(F.lit(1)).alias("rows_last"), F.max(order[0]).alias("watermark"))
        latest(watched, keys, order, newest=policy == "update").write.mode("overwrite").parquet(
            f"{path}/rows/{BATCH}={batch_id}")
        row = (seen.get["rows_last"], None if seen.get["watermark"] is None else str(seen.get["watermark"]))
        state = batch.sparkSession.createDataFrame([row], "rows_last bigint, watermark string")
        state.write.mode("overwrite").parquet(f"{path}/state/{BATCH}={batch_id}")

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def read_table(
    spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str],
    policy: str = "update", base: str | None = None, upto: int = -1,
) -> DataFrame:
    """Current rows of a replicated table; with a compacted ``base``, only batches after ``upto`` are read."""
    stored_schema = StructType([*schema.fields, StructField(BATCH, LongType())])
    stored = spark.read.schema(stored_schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    stored = stored.filter(F.col(BATCH) > upto)
    if base:
        stored = spark.read.schema(stored_schema).parquet(base).unionByName(stored)
    ranked = [*order] if policy == "update" else [BATCH, *order]
    return latest(stored, keys, ranked, newest=policy == "update").drop(BATCH)


def compact(
    spark: SparkSession, path: str, base: str, schema: StructType, keys: Sequence[str], order: Sequence[str],
    upto: int, policy: str = "update",
) -> None:
    """Fold the batches up to ``upto`` into one table at ``base``; readers name both once it is complete."""
    stored = spark.read.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).option(
        "basePath", f"{path}/rows").parquet(f"{path}/rows").filter(F.col(BATCH) <= upto)
    ranked = [*order] if policy == "update" else [BATCH, *order]
    folded = latest(stored, keys, ranked, newest=policy == "update")
    folded.withColumn(BATCH, F.lit(upto).cast("bigint")).write.mode("errorifexists").parquet(base)


def state(spark: SparkSession, path: str) -> DataFrame:
    """Replication state: last watermark, rows of the last batch and of all batches. Numbers compare as numbers, all
    else as text."""
    rows = spark.read.schema(f"rows_last bigint, watermark string, {BATCH} bigint").option(
        "basePath", f"{path}/state").parquet(f"{path}/state")
    return rows.agg(F.max_by("watermark", F.struct(F.col("watermark").try_cast("decimal(38,6)"), "watermark")).alias("last_watermark"), F.max_by("rows_last", BATCH).alias("rows_last"),
                    F.sum("rows_last").alias("rows_total"))


def deleted_keys(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys the target still has and the source has lost."""
    return target.select(*keys).join(source.select(*keys), list(keys), "left_anti")


class Replica(NamedTuple):
    """One table of a cycle: ``read`` gives its stream, or under the policy ``refresh``, for tables without a watermark, all its rows.

    ``order`` is the watermark and what tells its ties apart.
    """

    name: str
    read: Callable[[], DataFrame]
    keys: Sequence[str]
    order: Sequence[str] = ()
    policy: str = "update"


STATE = "table_name string, status string, error string, rows_last bigint, rows_total bigint, deleted bigint, watermark string"
CYCLE = "_cycle"


def _table_state(spark: SparkSession, path: str) -> tuple[int, int, int, str | None]:
    found = state(spark, path).first()
    return found["rows_last"] or 0, found["rows_total"] or 0, 0, found["last_watermark"]


def _refreshed(spark: SparkSession, replica: Replica, path: str, number: int, before: int | None) -> tuple[int, int, int, str | None]:
    """All rows of the source as the next snapshot; readers go on with the last one until the cycle's state names this one.

    The key is compared with the snapshot of cycle ``before``, so what the source has lost is counted and is gone.
    """
    seen, source = Observation(), replica.read()
    source.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/rows/{CYCLE}={number}")
    taken = spark.read.schema(source.schema).parquet(f"{path}/rows/{CYCLE}={number}")
    lost = 0 if before is None else deleted_keys(taken, spark.read.schema(source.schema).parquet(f"{path}/rows/{CYCLE}={before}"), replica.keys).count()
    rows = seen.get["rows"]
    return rows, rows, lost, None


def cycle(spark: SparkSession, replicas: Sequence[Replica], path: str, number: int, at_once: int = 4) -> DataFrame:
    """Replicate all tables once, side by side, into folders below ``path``; one state row per table, also kept there.

    Each table is a query of its own with its own key, watermark, policy and checkpoint, so one that fails is
    told in its row and the others complete. ``rows_last`` are the rows of this cycle's last batch, ``rows_total``
    those of all cycles, both counted while they were written; a cycle that runs again replaces its state.
    """
    earlier = {r["table_name"]: r for r in states(spark, path, number - 1).collect()} if number else {}  # one row per table

    def run(replica: Replica) -> tuple:
        own, last = f"{path}/{replica.name}", earlier.get(replica.name)
        done, total = (last["snapshot"], last["rows_total"]) if last else (None, 0)
        try:
            if replica.policy == "refresh":
                rows, more, lost, watermark = _refreshed(spark, replica, own, number, done)
                return replica.name, "ok", "", rows, total + more, lost, watermark, number
            replicate(replica.read(), own, replica.keys, replica.order, replica.policy)
            return replica.name, "ok", "", *_table_state(spark, own), None
        except Exception as error:  # noqa: BLE001
            kept = last["watermark"] if last else None
            return replica.name, "failed", f"{type(error).__name__}: {error}", 0, total, 0, kept, done

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(run, replicas))
    found = spark.createDataFrame(rows, f"{STATE}, snapshot int")
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/{CYCLE}={number}")
    return states(spark, path, number)


def states(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The state rows of one cycle; ``snapshot`` is the cycle that a refreshed table was last complete in."""
    return spark.read.schema(f"{STATE}, snapshot int").parquet(f"{path}/state/{CYCLE}={number}")


def replica_rows(spark: SparkSession, replica: Replica, path: str, schema: StructType, number: int) -> DataFrame:
    """Current rows of a replicated table after cycle ``number``; none for a table that was never complete."""
    own = f"{path}/{replica.name}"
    if replica.policy != "refresh":
        return read_table(spark, own, schema, replica.keys, replica.order, replica.policy)
    row = states(spark, path, number).filter(F.col("table_name") == replica.name).first()
    if row is None or row["snapshot"] is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{own}/rows/{CYCLE}={row['snapshot']}")


def replication_lag(source: DataFrame, target: DataFrame, table_column: str, watermark: str, limit_s: int = 90) -> DataFrame:
    """Last watermark on both sides per table, lag in seconds, rows copied, and whether the lag is in limits."""
    a = source.groupBy(table_column).agg(F.max(watermark).alias("_source"), F.count(F.lit(1)).alias("source_rows"))
    b = target.groupBy(table_column).agg(F.max(watermark).alias("_target"), F.count(F.lit(1)).alias("rows_copied"))

    def seconds(column):
        return (F.unix_date(F.col(column).cast("date")).cast("bigint") * 86400 + F.hour(column) * 3600
                + F.minute(column) * 60 + F.second(column))
    lag = F.coalesce(seconds("_source") - seconds("_target"), F.lit(-1))

    def shown(column):
        return F.coalesce(F.date_format(column, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return a.join(b, table_column, "full_outer").select(
        F.col(table_column).alias("table_name"), shown("_source").alias("source_watermark"),
        shown("_target").alias("target_watermark"), lag.cast("bigint").alias("lag_seconds"),
        F.coalesce("source_rows", F.lit(0)).alias("source_rows"), F.coalesce("rows_copied", F.lit(0)).alias("rows_copied"),
        ((lag >= 0) & (lag < limit_s)).alias("within_limit"))


def queue_state(jobs: DataFrame) -> DataFrame:
    """Latest job per entity and whether it has come to an end. ``jobs``: job_id, entity, status, retries, updated_at."""
    last = latest(jobs, ["entity"], ["job_id"])
    return last.withColumn("terminal", F.col("status").isin(*TERMINAL))
