"""Typed load with rejects, source consolidation, next keys, create plans and value restore."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantledger.functions import values as V
from plantledger.operators.ordering import latest


def _typed(name: str, kind: str) -> tuple[Column, Column]:
    """Typed value of a text column, and whether the text is present but cannot be read as ``kind``."""
    text = F.col(name)
    present = V.blank_to_null(text)
    if kind == "bool":
        return V.to_bool(text), F.lit(False)
    if kind == "date":
        parsed = V.parse_date(present)
        return parsed, present.isNotNull() & parsed.isNull()
    if kind == "json":
        return present, F.lit(False)
    if kind in ("bigint", "double"):
        number = present.try_cast(kind)
        return number, present.isNotNull() & number.isNull()
    return text, F.lit(False)


def judged(df: DataFrame, target: Mapping[str, str]) -> tuple[DataFrame, Column]:
    """Every row with its typed columns, its ``text`` as a map, and in ``reason`` the columns that cannot be read; and whether a row
    holds malformed JSON.

    Columns the target lacks are dropped. ``''`` is NULL for numbers, dates, flags and JSON. Malformed JSON is kept as text and marked in
    ``<column>_malformed``.
    """
    columns = {c: kind for c, kind in target.items() if c in df.columns}
    typed, faults = [], []
    for name, kind in columns.items():
        value, bad = _typed(name, kind)
        typed.append(value.alias(name))
        if kind == "json":
            typed.append(V.json_malformed(F.col(name)).alias(f"{name}_malformed"))
        if kind in ("date", "bigint", "double"):
            faults.append(F.when(bad, F.lit(name)))
    text = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])
    malformed = reduce(lambda a, b: a | b, [F.coalesce(f"{c}_malformed", F.lit(False)) for c, kind in columns.items() if kind == "json"], F.lit(False))
    return df.select(*typed, text.alias("text"), F.concat_ws(", ", *faults).alias("reason")), malformed


def coerce(df: DataFrame, target: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Text rows to typed rows. Returns (good, rejects); see ``judged``.

    A row with an unreadable number or date is rejected, keeps its text and names the columns at fault in ``reason``.
    """
    rows, _ = judged(df, target)
    good = rows.filter(F.col("reason") == "").drop("text", "reason")
    columns = [c for c in target if c in df.columns]
    return good, rows.filter(F.col("reason") != "").select(*(F.col("text")[c].alias(c) for c in columns), "reason")


def first_wins(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Consolidated rows: per key the row of the first source that has it."""
    ranked = None
    for rank, (name, df) in enumerate(sources):
        part = df.withColumn("_rank", F.lit(rank)).withColumn("source", F.lit(name))
        ranked = part if ranked is None else ranked.unionByName(part)
    return latest(ranked, keys, ["_rank"], newest=False).drop("_rank")


def next_keys(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Next free key per table: highest plus one, 1 for an empty table."""
    out = None
    for name, (df, key) in tables.items():
        part = df.agg((F.coalesce(F.max(key).cast("bigint"), F.lit(0)) + 1).alias("next_key"))
        part = part.select(F.lit(name).alias("table_name"), "next_key")
        out = part if out is None else out.unionByName(part)
    return out


def packaging_plan(source: DataFrame, targets: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with each source packaging: create on the product with the same id, else on the
    first product with the same code; skip without a match or where (product, name) is there already.

    ``source``: packaging_id, name, qty, product_id, code. ``targets``: product_id, code.
    ``existing``: product_id, name.
    """
    same_id = targets.select(F.col("product_id").alias("_by_id"))
    same_code = targets.filter(F.col("code").isNotNull()).groupBy("code").agg(F.min("product_id").alias("_by_code"))
    have = existing.select(F.col("product_id").alias("target_id"), "name").distinct().withColumn("_have", F.lit(True))
    matched = (source.join(same_id, F.col("product_id") == F.col("_by_id"), "left").join(same_code, "code", "left")
               .withColumn("target_id", F.coalesce("_by_id", "_by_code")))
    # of several rows for one product and name the first is created, the rest find it there
    first = matched.filter(F.col("target_id").isNotNull()).groupBy("target_id", "name").agg(F.min("packaging_id").alias("_first"))
    planned = matched.join(have, ["target_id", "name"], "left").join(first, ["target_id", "name"], "left")
    action = (F.when(F.col("target_id").isNull(), "skip: no product").when(F.col("_have") | (F.col("packaging_id") != F.col("_first")), "skip: exists")
              .otherwise("create"))
    return planned.select("packaging_id", "name", "qty", F.coalesce("target_id", F.lit(-1)).alias("target_id"),
                          F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_code").isNotNull(), "code")
                          .otherwise("none").alias("matched_by"), action.alias("action"))


def restore_values(snapshot: DataFrame, target: DataFrame, on: str, value: str) -> DataFrame:
    """Saved values put back on rows with the same name; names not found are kept as such."""
    saved = snapshot.groupBy(on).agg(F.max(value).alias("_saved"))
    return (saved.join(target.select(on, F.col(value).alias("_now"), F.lit(True).alias("_hit")), on, "left")
            .select(on, F.when(F.col("_hit").isNull(), "no match").when(F.col("_saved").eqNullSafe(F.col("_now")), "same")
                    .otherwise("restored").alias("outcome"), F.col("_saved").alias("value")))
