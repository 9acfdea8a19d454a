"""Queue state over a stream: the latest job of each entity in keyed state, until it has come to an end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plantledger.operators.ordering import latest
from plantledger.streaming.replicate import TERMINAL
from plantledger.streaming.watch import keyed_state

COLUMNS = ["job_id", "status", "retries"]
CHANGES = "entity {kind}, job_id bigint, status string, retries bigint, at bigint, terminal boolean, stalled boolean"


class Latest(StatefulProcessor):
    """The job with the greatest number per entity. Times are in microseconds, ``timeout`` in milliseconds."""

    def __init__(self, timeout: int) -> None:
        self._timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._job = handle.getValueState("job", "job_id bigint, status string, retries bigint, at bigint, stalled boolean")

    def _told(self, key, job: tuple, stalled: bool) -> pd.DataFrame:
        number, status, retries, at = job
        return pd.DataFrame([(*key, number, status, retries, at, status in TERMINAL, stalled)], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def _until(self, job: tuple) -> int:
        return -(-job[3] // 1000) + self._timeout

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self._job.get())[:4] if self._job.exists() else None
        newest = known
        for part in rows:
            for row in part[[*COLUMNS, "at"]].itertuples(index=False, name=None):
                if newest is None or row[0] > newest[0]:
                    newest = (int(row[0]), row[1], None if pd.isna(row[2]) else int(row[2]), int(row[3]))
        if newest != known:
            self._job.update((*newest, False))
            self._handle.registerTimer(max(self._until(newest), timerValues.getCurrentWatermarkInMs() + 1))
            yield self._told(key, newest, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self._job.exists():
            return
        *job, stalled = self._job.get()
        if timerValues.getCurrentWatermarkInMs() < self._until(job):
            return  # a newer job has a timer of its own
        if job[1] in TERMINAL:
            self._job.clear()
        elif not stalled:
            self._job.update((*job, True))
            yield self._told(key, tuple(job), True)

    def close(self) -> None:
        pass


def follow(stream: DataFrame, path: str, lateness: str, timeout_seconds: int) -> None:
    """Follow a stream of jobs (job_id, entity, status, retries, updated_at) to its present end; changes go to a table at ``path``.

    A change is told when an entity gets a job of a greater number. Once the watermark, ``lateness`` behind the newest time, is
    ``timeout_seconds`` past its last job, a finished entity leaves the state, and an unfinished one is told as stalled,
    once. A row without an entity carries the time of a poll. An old job that comes after its entity has left is told again
    and changes nothing for readers, who take the greatest number.
    """
    jobs = (stream.select("entity", "job_id", "status", F.col("retries").cast("bigint").alias("retries"), F.col("updated_at").cast("timestamp").alias("time"))
            .withColumn("at", F.unix_micros("time")).withWatermark("time", lateness))
    rows = jobs.filter(F.when(F.col("time").isNotNull(), F.col("entity").isNotNull()).otherwise(False))
    changes = rows.groupBy("entity").transformWithStateInPandas(
        Latest(timeout_seconds * 1000), CHANGES.format(kind=dict(stream.dtypes)["entity"]), outputMode="Append", timeMode="EventTime")
    with keyed_state(stream.sparkSession):
        (changes.writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def current(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Each entity's latest job, whether it has come to an end, and whether it was told as stalled; ``kind`` is the type of an entity."""
    changes = spark.read.schema(CHANGES.format(kind=kind)).parquet(f"{path}/changes")
    return latest(changes, ["entity"], ["job_id", "stalled"]).select("entity", "job_id", "status", "retries", F.timestamp_micros("at").alias("updated_at"), "terminal", "stalled")
