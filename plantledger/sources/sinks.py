"""Sinks: append with a reject table, definition dumps, action and marker logs, upsert by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantledger.operators.ordering import latest, number_rows


def append(good: DataFrame, rejects: DataFrame, path: str) -> None:
    """Append good rows under ``path/rows`` and refused rows under ``path/rejects``."""
    good.write.mode("append").parquet(f"{path}/rows")
    rejects.write.mode("append").parquet(f"{path}/rejects")


def dump_definitions(df: DataFrame, stable: Sequence[str], path: str) -> None:
    """Write only the columns that mean the same on every installation, as JSON lines."""
    df.select(*stable).write.mode("overwrite").json(path)


def action_log(df: DataFrame, key: str, old_value: Column, status: Column, error: Column) -> DataFrame:
    """One row per acted-on record: key, value before, outcome, error text."""
    return df.select(F.col(key), old_value.alias("old_value"), status.alias("status"), error.alias("error"))


def merge_by_key(
    current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], policy: str = "update"
) -> DataFrame:
    """Upsert as a rewrite: newest incoming version per key replaces (``update``) or yields to
    (``skip``) the stored row. Both sides meet with one row per key, so no key is hot."""
    columns = current.columns
    if policy == "update":
        both = current.unionByName(incoming.select(*columns))
        return latest(both, keys, order).select(*columns)
    if policy == "skip":
        first = latest(incoming.select(*columns), keys, order, newest=False).select(*columns)
        return current.unionByName(first.join(current.select(*keys), list(keys), "left_anti"))
    raise ValueError(f"unknown conflict policy {policy!r}")


def write_snapshot(packagings: DataFrame, products: DataFrame, values: DataFrame, path: str) -> None:
    """Snapshot of packagings, each with its product's code, and of saved values, as JSON lines."""
    coded = packagings.join(products.select("product_id", "product_code"), "product_id", "left")
    coded.write.mode("errorifexists").json(f"{path}/packagings")
    values.write.mode("errorifexists").json(f"{path}/saved_values")


def write_report(results: DataFrame, path: str) -> None:
    """Check or audit results for other tools, as JSON lines."""
    results.write.mode("overwrite").json(path)


def markdown_lines(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """The same for people: a line of a Markdown table per row, numbered in the given order behind the two lines of the header."""
    def line(cells: Sequence[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    columns = results.columns
    head = results.sparkSession.createDataFrame([(1, f"| {' | '.join(columns)} |"), (2, "|" + "---|" * len(columns))], "line_no bigint, line string")
    shown = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    rows = number_rows(results.withColumn("_all", F.lit(0)), ["_all"], order, "line_no").select((F.col("line_no") + 2).alias("line_no"), line(shown).alias("line"))
    return head.unionByName(rows)


def write_marker(touched: DataFrame, path: str, run_id: str) -> None:
    """Ids a run touched, kept under its own id until they are restored; an existing one is not overwritten."""
    touched.write.mode("errorifexists").parquet(f"{path}/run_id={run_id}")
