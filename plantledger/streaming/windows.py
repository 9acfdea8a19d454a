"""Parity of two streams, window by window: both sides meet in the state of a window, which is told when it is complete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantledger.operators.parity import fingerprint, row_text

SIDES = ("source", "target")
SCHEMA = "window_start string, source_n bigint, target_n bigint, source_sum double, target_sum double, match boolean"


def _totals() -> list[Column]:
    def of(side: str) -> list[Column]:
        own = F.col("side_") == side
        return [F.count_if(own).alias(f"{side}_n"), F.sum(F.when(own, F.col("value_"))).alias(f"{side}_v"), F.sum(F.when(own, F.col("hash_"))).alias(f"{side}_h")]
    return [total for side in SIDES for total in of(side)]


def _compared(totals: DataFrame, start: Column) -> DataFrame:
    same = (F.col("source_n") == F.col("target_n")) & F.coalesce(F.col("source_h") == F.col("target_h"), F.lit(False))
    return totals.select(start.alias("window_start"), "source_n", "target_n", *(F.coalesce(F.col(f"{s}_v").cast("double"), F.lit(0.0)).alias(f"{s}_sum") for s in SIDES),
                         same.alias("match"))


def window_parity_stream(source: DataFrame, target: DataFrame, path: str, key: str, ts: str, value: str, lateness: str,
                         columns: Sequence[str] | None = None, window: str = "600 seconds", slide: str = "300 seconds") -> None:
    """``parity.window_parity`` over two streams, run to their present end; windows go to a table at ``path``.

    Each side has its own watermark, ``lateness`` behind the newest time it has seen, and the slower side decides: a window is
    told once, when both have passed its end. Rows that come later than that are left out. A row without ``key`` carries the
    time of a poll and nothing else. Rows without a time belong to no window; they are summed up on their own and told anew by each
    run. Run again, both go on from their checkpoints.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(ts).cast("timestamp").alias("time_"), F.col(key).isNotNull().alias("row_"), F.lit(name).alias("side_"),
                         F.col(value).cast("decimal(18,4)").alias("value_"), fingerprint(row_text(df, columns or df.columns))[0].alias("hash_"))

    both = [side(source, "source"), side(target, "target")]
    timed = both[0].withWatermark("time_", lateness).unionByName(both[1].withWatermark("time_", lateness))
    # One condition over both columns stays behind the watermark, so that polls move it.
    rows = timed.filter(F.when(F.col("time_").isNotNull(), F.col("row_")).otherwise(False))
    windows = _compared(rows.groupBy(F.window("time_", window, slide).alias("window_")).agg(*_totals()),
                        F.date_format(F.col("window_.start"), "yyyy-MM-dd HH:mm:ss"))
    untimed = both[0].unionByName(both[1]).filter(F.col("time_").isNull() & F.col("row_")).groupBy().agg(*_totals())

    def told(batch: DataFrame, _: int) -> None:
        _compared(batch, F.lit("(no time)")).write.mode("overwrite").parquet(f"{path}/untimed")

    queries = [
        windows.writeStream.format("parquet").option("path", f"{path}/windows").option("checkpointLocation", f"{path}/checkpoint-windows")
        .outputMode("append").trigger(availableNow=True).start(),
        untimed.writeStream.foreachBatch(told).option("checkpointLocation", f"{path}/checkpoint-untimed")
        .outputMode("complete").trigger(availableNow=True).start()]
    for query in queries:
        query.awaitTermination()


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """All windows told so far, and the row ``(no time)`` where any row has none."""
    parts = [spark.read.schema(SCHEMA).parquet(f"{path}/{part}") for part in ("windows", "untimed")]
    return parts[0].unionByName(parts[1].filter("source_n + target_n > 0"))
