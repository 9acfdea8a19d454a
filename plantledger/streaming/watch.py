"""State watch: what changed on each entity since its previous snapshot, field by field.

Over a stream the last snapshot of each entity lives in Spark's own keyed state. Snapshots wait there until the watermark has
passed them, so those that come late, within the stated lateness, still take their place in the order; a timer per
entity lets them out, and tells when an entity has been silent for too long. The sink receives changes only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from plantledger.operators.ordering import with_previous

SILENT = "(silent)"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _cells(fields: Sequence[str], old: str, new: str) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{old}{f}").cast("string").alias("old_value"),
                              F.col(f"{new}{f}").cast("string").alias("new_value")) for f in fields])


def state_deltas(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Changes between consecutive snapshots of each entity, over a whole table."""
    paired = with_previous(df, [key], order, fields)
    changed = F.filter(_cells(fields, "previous.", ""), lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    return paired.filter(F.col("previous").isNotNull()).select(key, *order, F.inline(changed))


class Watcher(StatefulProcessor):
    """Keeps the last snapshot of an entity and the ones the watermark has not passed yet.

    Snapshots are tuples: time in microseconds, the further order columns, the fields as text. ``silence`` is in
    microseconds, 0 for none.
    """

    def __init__(self, order: Sequence[str], fields: Sequence[str], state: str, silence: int) -> None:
        self._order, self._fields, self._state, self._silence = list(order), list(fields), state, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", f"{self._state}, told_ boolean")
        self._waiting = handle.getListState("waiting", self._state)

    @staticmethod
    def _due(at: int) -> int:
        """The first watermark, in milliseconds, that has passed this time."""
        return -(-at // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["at_", *self._order, *self._fields]
        first = None
        for part in rows:
            found = list(zip(*([None if v != v else v for v in part[c].tolist()] for c in columns)))
            if found:
                self._waiting.appendList(found)
                low = min(r[0] for r in found)
                first = low if first is None else min(first, low)
        if first is not None:
            self._handle.registerTimer(max(self._due(first), timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        due = sorted((r for r in waiting if r[0] <= now), key=lambda r: r[:1 + len(self._order)])
        later = [r for r in waiting if r[0] > now]
        last, told = None, False
        if self._last.exists():
            *last, told = self._last.get()
            last = tuple(last)
        out = []
        for row in due:
            if last is not None:
                if self._silent(last, row[0]) and not told:
                    out.append(self._told(last))
                out += [(*row[:1 + len(self._order)], f, a, b) for f, a, b in
                        zip(self._fields, last[1 + len(self._order):], row[1 + len(self._order):]) if a != b]
            last, told = row, False
        if last is not None and self._silence:
            if not told and self._silent(last, now):
                out.append(self._told(last))
                told = True
            elif not told:
                self._handle.registerTimer(self._due(last[0] + self._silence))
        if due:
            self._waiting.clear()
            if later:
                self._waiting.put(later)
        if later:
            self._handle.registerTimer(self._due(min(r[0] for r in later)))
        if last is not None:
            self._last.update((*last, told))
        if out:
            columns = ["key_", "at_", *self._order, "field", "old_value", "new_value"]
            yield pd.DataFrame(dict(zip(columns, map(list, zip(*((*key, *r) for r in out))))))

    def _silent(self, last: tuple, at: int) -> bool:
        return bool(self._silence) and at >= last[0] + self._silence

    def _told(self, last: tuple) -> tuple:
        return (*last[:1 + len(self._order)], SILENT, None, None)

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs Spark's RocksDB store; the session keeps its own setting afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def watch(stream: DataFrame, path: str, key: str, time: str, order: Sequence[str], fields: Sequence[str], lateness: str,
          silence_seconds: int = 0) -> None:
    """The same over a stream, run to its present end; changes go to a table at ``path``.

    Snapshots are put in order by ``time`` and the further ``order`` columns, and come at most ``lateness`` after the newest time seen;
    later ones are left out and never move an entity back. A row without a key carries the time of a poll and nothing else: it moves
    the watermark on when nothing happens. Rows without a time are left out. Where an entity has had no snapshot for
    ``silence_seconds`` (0: never mind), one row with the field ``(silent)`` names its last one. Run again, the stream goes
    on from its checkpoint.
    """
    spark = stream.sparkSession
    kinds = dict(stream.dtypes)
    state = ", ".join(["at_ bigint", *(f"{c} {kinds[c]}" for c in order), *(f"{c} string" for c in fields)])
    out = f"key_ {kinds[key]}, at_ bigint, " + ", ".join([*(f"{c} {kinds[c]}" for c in order), "field string", "old_value string", "new_value string"])
    timed = (stream.select(F.col(key).alias("key_"), F.col(time).cast("timestamp").alias("time_"), *order, *(F.col(f).cast("string").alias(f) for f in fields))
             .withColumn("at_", F.unix_micros("time_")).withWatermark("time_", lateness))
    # One condition over both columns stays behind the watermark, so that polls move it.
    snapshots = timed.filter(F.when(F.col("time_").isNotNull(), F.col("key_").isNotNull()).otherwise(False))
    changes = snapshots.groupBy("key_").transformWithStateInPandas(
        Watcher(order, fields, state, silence_seconds * 1_000_000), out, outputMode="Append", timeMode="EventTime")
    with keyed_state(spark):
        query = (changes.select(F.col("key_").alias(key), F.timestamp_micros("at_").alias(time), *order, "field", "old_value", "new_value")
                 .writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/checkpoint")
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()


def read_changes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/changes").select(*schema.names)
