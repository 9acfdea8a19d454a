"""Proof that a copy is right: counts, columns, rows, time windows, JSON documents, links."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from re import Pattern

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantledger.functions.text import scrub_times
from plantledger.functions.trees import tree
from plantledger.operators.ordering import number_rows
from plantledger.sources.tables import stacked_counts

# Key fragments whose values differ between two systems by nature.
VOLATILE_KEYS = ("timestamp", "_at", "elapsed", "duration_ms", "uptime", "server_time", "etag", "request_id")
# Fields that identify an element of a list of objects, first usable one wins.
ELEMENT_KEYS = ("id", "wo_number", "pallet_id", "roll_id", "name")


def count_parity(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table on both sides and whether they agree."""
    counted = stacked_counts(source.items()).withColumn("_side", F.lit("source")).unionByName(
        stacked_counts(target.items()).withColumn("_side", F.lit("target")))
    per_table = counted.groupBy("table_name").agg(*[
        F.coalesce(F.sum(F.when(F.col("_side") == side, F.col("n_rows"))), F.lit(0)).alias(f"{side}_rows")
        for side in ("source", "target")])
    return per_table.withColumn("status", F.when(F.col("source_rows") == F.col("target_rows"), "OK").otherwise("MISMATCH"))


def _as_text(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]


def _profile(df: DataFrame) -> DataFrame:
    """Non-null and distinct counts of every column, by counting per (column, value) first."""
    long = df.select(*_as_text(df, df.columns)).unpivot([], df.columns, "column_name", "value")
    per_value = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("value").alias("distinct_values"))


def column_profile_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns on one side only, and value counts of the shared ones."""
    a = _profile(source).withColumnsRenamed({"non_null": "source_non_null", "distinct_values": "source_distinct"})
    b = _profile(target).withColumnsRenamed({"non_null": "target_non_null", "distinct_values": "target_distinct"})
    zero = F.lit(0)
    return a.join(b, "column_name", "full_outer").select(
        "column_name",
        F.when(F.col("target_non_null").isNull(), "source only").when(F.col("source_non_null").isNull(), "target only")
        .when((F.col("source_non_null") == F.col("target_non_null"))
              & (F.col("source_distinct") == F.col("target_distinct")), "same").otherwise("differs").alias("status"),
        *[F.coalesce(c, zero).alias(c) for c in
          ("source_non_null", "source_distinct", "target_non_null", "target_distinct")])


def fingerprint(text: Column) -> list[Column]:
    """Two 60-bit numbers made from a text; equal texts give equal numbers in any engine."""
    digest = F.md5(text)
    return [F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)") for start in (1, 16)]


def differing_keys(source: DataFrame, target: DataFrame, key: str, text: Column) -> DataFrame:
    """Keys whose rows are not the same on both sides.

    Only the key and two numbers per row are shuffled: source rows count plus, target rows minus, and keys
    that do not come to zero differ. Wide rows are read again for those keys alone.
    """
    first, second = fingerprint(text)

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(key, F.lit(sign).alias("_n"), (first * sign).alias("_h1"), (second * sign).alias("_h2"))
    sums = side(source, 1).unionByName(side(target, -1)).groupBy(key).agg(
        *[F.sum(c).alias(c) for c in ("_n", "_h1", "_h2")])
    return sums.filter((F.col("_n") != 0) | (F.col("_h1") != 0) | (F.col("_h2") != 0)).select(key)


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """The row as text that tells all values apart: columns in name order, each value with its length, ``-`` for NULL."""
    def field(name: str) -> Column:
        value = F.col(name)
        if isinstance(df.schema[name].dataType, T.TimestampType):
            value = F.unix_micros(value)
        value = value.cast("string")
        return F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat_ws(",", *[field(c) for c in sorted(columns)])


def row_diff(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Every column that differs, by key; rows on one side only appear once as column ``(row)``.

    Rows of one key are compared as multisets: equal rows cancel, and what is left is paired in the order of row hashes.
    (The sides are dealt anew after their union: Spark 4.1 takes a union of two joins on the key for dealt by it already,
    which adaptive execution can make untrue.)
    """
    columns = [c for c in source.columns if c != key and c in target.columns]
    suspects = differing_keys(source, target, key, row_text(source, columns))

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.join(suspects, key, "left_semi").select(key, F.md5(row_text(df, columns)).alias("_row"), F.lit(sign).alias("_sign"),
                                                          F.struct(*_as_text(df, columns)).alias("_cells"))
    net = (side(source, 1).unionByName(side(target, -1)).repartition(key, "_row").groupBy(key, "_row")
           .agg(F.sum("_sign").alias("_net"), F.first("_cells").alias("_cells")).filter(F.col("_net") != 0))
    left = net.select(key, "_row", "_cells", (F.col("_net") > 0).alias("_in_source"), F.explode(F.array_repeat(F.lit(1), F.abs("_net").cast("int"))).alias("_copy"))
    left = number_rows(left, [key, "_in_source"], ["_row"], "_no")
    a = left.filter("_in_source").select(key, "_no", F.col("_cells").alias("a"))
    b = left.filter(~F.col("_in_source")).select(key, "_no", F.col("_cells").alias("b"))
    both = a.join(b, [key, "_no"], "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("a")[c].alias("source_value"),
                               F.col("b")[c].alias("target_value")) for c in columns])
    changed = F.filter(cells, lambda x: ~x["source_value"].eqNullSafe(x["target_value"]))

    def whole(source_value: str, target_value: str) -> Column:
        return F.array(F.struct(F.lit("(row)").alias("column_name"), F.lit(source_value).alias("source_value"),
                                F.lit(target_value).alias("target_value")))

    found = (F.when(F.col("b").isNull(), whole("present", "missing"))
             .when(F.col("a").isNull(), whole("missing", "present")).otherwise(changed))
    return both.select(key, F.inline(found))


def window_parity(
    source: DataFrame, target: DataFrame, ts: str, value: str, columns: Sequence[str] | None = None,
    window: str = "600 seconds", slide: str = "300 seconds",
) -> DataFrame:
    """Count, sum and order-free checksum per sliding window, source against target; ``columns`` (all) are hashed.

    The checksum adds up row hashes, so it does not depend on row order and is combined map-side. The
    source is first reduced to one row per slide step; windows are then added up from the steps. Rows without a
    time make one row ``(no time)``.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(ts, F.col(value).cast("decimal(18,4)").alias("_v"), fingerprint(row_text(df, columns or df.columns))[0].alias("_h"))
        totals = (F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_v"), F.sum("_h").alias("_h"))
        steps = rows.groupBy(F.window(ts, slide).getField("start").alias("_step")).agg(*totals)
        timed = steps.groupBy(F.window("_step", window, slide).getField("start").alias("_start")).agg(
            F.sum("_n").alias("_n"), F.sum("_v").alias("_v"), F.sum("_h").alias("_h"))
        untimed = rows.filter(F.col(ts).isNull()).groupBy(F.col(ts).alias("_start")).agg(*totals)
        return timed.unionByName(untimed).select(
            F.coalesce(F.date_format("_start", "yyyy-MM-dd HH:mm:ss"), F.lit("(no time)")).alias("window_start"),
            *[F.col(f"_{c}").alias(f"{name}_{full}") for c, full in (("n", "n"), ("v", "sum"), ("h", "hash"))])
    both = side(source, "source").join(side(target, "target"), "window_start", "full_outer")
    n, m = F.coalesce("source_n", F.lit(0)), F.coalesce("target_n", F.lit(0))
    return both.select(
        "window_start", n.alias("source_n"), m.alias("target_n"),
        F.coalesce(F.col("source_sum").cast("double"), F.lit(0.0)).alias("source_sum"),
        F.coalesce(F.col("target_sum").cast("double"), F.lit(0.0)).alias("target_sum"),
        ((n == m) & F.coalesce(F.col("source_hash") == F.col("target_hash"), F.lit(False))).alias("match"))


def drift_status(tables: DataFrame) -> DataFrame:
    """Status per table and one row for all of them; ``tables``: table_name, match."""
    per_table = tables.groupBy("table_name").agg(F.count_if(~F.col("match")).alias("n_bad"))
    colour = F.when(F.col("n_bad") == 0, "green").otherwise("drift")
    rows = per_table.select("table_name", colour.alias("status"), "n_bad")
    # one row per table: the list of drifting tables is as long as the table catalogue at most
    overall = per_table.agg(F.sum("n_bad").alias("n_bad"), F.array_join(F.array_sort(F.collect_list(
        F.when(F.col("n_bad") > 0, F.col("table_name")))), ", ").alias("_bad"))
    total = overall.select(F.concat(F.lit("(all)"), F.when(F.col("_bad") == "", "").otherwise(
        F.concat(F.lit(": "), "_bad"))).alias("table_name"), colour.alias("status"), "n_bad")
    return rows.unionByName(total)


LEAF = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("path", "type", "value")]))


def _erased(volatile: Sequence[str], suffix_only: bool) -> Pattern:
    return re.compile("(" + "|".join(re.escape(fragment) for fragment in volatile) + ")" + ("$" if suffix_only else ""))


def json_hash(text: Column, volatile: Sequence[str] = VOLATILE_KEYS, suffix_only: bool = False) -> Column:
    """Hash of a JSON text as a tree, the same for all texts without a difference in ``json_leaves``; NULL for NULL."""
    erased = _erased(volatile, suffix_only)

    def digest(document: str | None) -> str | None:
        found = tree(document, erased, ELEMENT_KEYS)
        return found.digest() if found else None

    return F.coalesce(F.udf(digest, T.StringType(), useArrow=True)(text), F.concat(F.lit("text "), F.md5(scrub_times(text))))


def json_leaves(text: Column, volatile: Sequence[str] = VOLATILE_KEYS, suffix_only: bool = False) -> Column:
    """Array of (path, type, value) for every leaf of a JSON text.

    Volatile keys keep their path and lose what they hold; a key is volatile if it contains one of the fragments
    anywhere, or ends with one under ``suffix_only``. Elements of a list of objects are named by the first
    identifying field that tells them apart, or else by their own hash, so list order does not count there; names that are not plain
    words are quoted in a path. Empty objects and lists are leaves. Text that is no JSON, or has more than ``trees.DEEPEST``
    levels, is one leaf of type ``text`` without its times.
    """
    erased = _erased(volatile, suffix_only)

    def leaves(document: str | None) -> list[tuple[str, str, str]]:
        found = tree(document, erased, ELEMENT_KEYS)
        return list(found.leaves()) if found else [] if document is None else [("$", "text", document)]

    return F.transform(F.udf(leaves, LEAF, useArrow=True)(text), lambda x: F.struct(x["path"].alias("path"), x["type"].alias("type"), F.when(
        x["type"] == "text", scrub_times(x["value"])).otherwise(x["value"]).alias("value")))


def json_diff(source: DataFrame, target: DataFrame, key: str, column: str,
              volatile: Sequence[str] = VOLATILE_KEYS, suffix_only: bool = False) -> DataFrame:
    """Paths added, removed or changed between two sets of JSON documents, with the types and values of both sides.

    Three steps, each for what the one before has left: documents that are not equal as stored are compared by the hash of their trees; those
    that still differ are taken apart and their leaves compared as multisets: source counts one, target minus
    one, what does not cancel differs.
    """
    text = F.col(column)
    unequal = differing_keys(source, target, key, F.coalesce(F.concat(F.lit("="), text), F.lit("")))

    def hashed(df: DataFrame) -> DataFrame:
        return df.join(unequal, key, "left_semi").select(key, F.coalesce(json_hash(text, volatile, suffix_only), F.lit("")).alias("_tree"))

    suspects = differing_keys(hashed(source), hashed(target), key, F.col("_tree"))

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.join(suspects, key, "left_semi").select(key, F.inline(json_leaves(text, volatile, suffix_only))).withColumn("_sign", F.lit(sign))
    net = (side(source, 1).unionByName(side(target, -1)).repartition(key, "path").groupBy(key, "path", "type", "value").agg(F.sum("_sign").alias("_net"))
           .filter(F.col("_net") != 0))
    pair = F.struct("type", "value")
    sides = net.groupBy(key, "path").agg(F.min(F.when(F.col("_net") > 0, pair)).alias("_a"), F.min(F.when(F.col("_net") < 0, pair)).alias("_b"))
    shown = [F.coalesce(f"_{s}.{c}", F.lit("")).alias(f"{name}_{c}") for c in ("type", "value") for s, name in (("a", "source"), ("b", "target"))]
    return sides.select(key, "path", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "changed").when(F.col("_a").isNotNull(), "removed")
                        .otherwise("added").alias("status"), *shown)


def link_coverage(df: DataFrame, hops: Sequence[tuple[str, DataFrame, str, str, str | None]]) -> DataFrame:
    """Rows per first hop at which a chain of links breaks.

    ``hops``: (name, parent, column in the rows so far, key of the parent, column taken from the parent
    for the next hop). Rows are counted per first link before anything is joined, so a parent held by
    most rows is looked up once.
    """
    first = hops[0][2]
    state = df.groupBy(F.col(first).alias("_link")).agg(F.count(F.lit(1)).alias("n_rows"))
    state = state.withColumn("broken_at", F.when(F.col("_link").isNull(), F.lit(hops[0][0])).cast("string"))
    for i, (name, parent, _, pk, carried) in enumerate(hops):
        side = parent.select(F.col(pk).alias("_pk"), (F.col(carried) if carried else F.lit(None)).alias("_next"),
                             F.lit(True).alias("_hit"))
        state = state.join(side, F.col("_link") == F.col("_pk"), "left").select(
            F.col("_next").alias("_link"), "n_rows",
            F.coalesce("broken_at", F.when(F.col("_hit").isNull(), F.lit(name))).alias("broken_at"))
        state = state.groupBy("_link", "broken_at").agg(F.sum("n_rows").alias("n_rows"))
    per_hop = state.groupBy(F.coalesce("broken_at", F.lit("(complete)")).alias("broken_at")).agg(
        F.sum("n_rows").alias("n_rows"))
    # one row per hop, so the window over all of them is a handful of rows
    total = F.sum("n_rows").over(W.partitionBy(F.lit(0)))
    return per_hop.select("broken_at", "n_rows", (F.col("n_rows") / total).alias("share"))
