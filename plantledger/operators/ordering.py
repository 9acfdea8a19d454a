"""Order-dependent building blocks that stay parallel when one key holds most of the rows.

The rows are written once. A sample of them, of a size that follows the number of shuffle partitions, tells which keys hold more
than a partition's share, and its rows are the borders that cut such a key, along the whole order, into slices of about
one share. All other keys are one slice. Rows are shuffled once, by key and slice, into parts whose number follows the rows, and a window works inside a slice;
what the slices before add comes from one row per slice. Borders are rows of the table, so a slice knows the row before its
first one. The sample decides where rows are worked on and never what comes out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantledger.session import dealt, fresh_path, parts_for

SLICE, BORDERS = "_slice", "_borders"
#: Shares of the table that the keys are measured by, for each task the rows are dealt to, and at most.
SHARES, MOST_SHARES = 2, 4096
#: Sampled rows for one share; a key that holds two shares of the sample is cut.
SAMPLED = 40


def _sort(order: Sequence[str]) -> list[Column]:
    """``'x'`` sorts ascending, ``'-x'`` descending; NULLs come first and last respectively."""
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in order]


def _bare(order: Sequence[str]) -> list[str]:
    return [name.removeprefix("-") for name in order]


def _beyond(border: Column, order: Sequence[str]) -> Column:
    """Whether a row comes after ``border``, a struct of the order columns; NULL compares as the smallest value."""
    def one(name: str) -> tuple[Column, Column]:
        bare = name.removeprefix("-")
        own, other = F.struct(F.col(bare).alias("v")), F.struct(border[bare].alias("v"))
        return (own < other if name.startswith("-") else own > other), own == other

    pairs = [one(name) for name in reversed(order)]
    return reduce(lambda later, pair: pair[0] | (pair[1] & later), pairs[1:], pairs[0][0])


class Sliced(NamedTuple):
    """Rows with ``SLICE``, and ``BORDERS`` where a key is cut; ``cut`` tells whether any is."""

    rows: DataFrame
    cut: bool


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], taken: Sequence[str] = ()) -> Sliced:
    """``df``, written and cut; the borders carry the ``taken`` columns of their rows in the struct ``taken``."""
    spark = df.sparkSession
    path, seen = fresh_path(spark, "ordered"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    rows, total = spark.read.schema(df.schema).parquet(path), seen.get["rows"]
    shares = min(MOST_SHARES, SHARES * max(parts_for(total), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    border = F.struct(*_bare(order), F.struct(*[F.col(c) for c in taken] or [F.lit(0).alias("_none")]).alias("taken")).alias("_border")
    by_key = W.partitionBy(*keys)
    sample = rows.sample(min(1.0, SAMPLED * shares / max(1, total)), seed=7)
    numbered = sample.select(*keys, border, F.row_number().over(by_key.orderBy(*_sort(order))).alias("_n"), F.count(F.lit(1)).over(by_key).alias("_of"))
    chosen = numbered.filter((F.col("_of") >= 2 * SAMPLED) & (F.col("_n") % SAMPLED == 0) & (F.col("_n") < F.col("_of")))
    borders = chosen.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "_border"))), lambda b: b["_border"]).alias(BORDERS))
    cut = borders.collect()  # one border for each share of the table at most
    if not cut:
        return Sliced(dealt(rows, total, *keys).withColumn(SLICE, F.lit(0)), False)
    held = spark.createDataFrame(cut, borders.schema)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    # Halving steps over the borders of the key: as many comparisons as the number of borders has binary digits.
    steps = F.array(*[F.lit(1 << k) for k in range(MOST_SHARES.bit_length() - 1, -1, -1)])

    def further(low: Column, step: Column) -> Column:
        inside = low + step <= F.size(BORDERS)
        return F.when(inside, F.when(_beyond(F.get(F.col(BORDERS), low + step - 1), order), low + step).otherwise(low)).otherwise(low)

    place = F.when(F.col(BORDERS).isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), further))
    placed = rows.join(F.broadcast(held), same, "left").select(*df.columns, BORDERS, place.alias(SLICE))
    return Sliced(dealt(placed, total, *keys, SLICE), True)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], amounts: Mapping[str, Column]) -> DataFrame:
    """Add for each named amount (whole numbers, never NULL) its sum over the key's rows up to and with this one in the given total order."""
    sliced = _sliced(df, keys, order)
    within = W.partitionBy(*keys, SLICE).orderBy(*_sort(order)).rowsBetween(W.unboundedPreceding, 0)
    if not sliced.cut:
        return sliced.rows.select(*df.columns, *(F.sum(amount).over(within).cast("bigint").alias(out) for out, amount in amounts.items()))
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    per_slice = (sliced.rows.filter(F.col(BORDERS).isNotNull()).groupBy(*keys, SLICE).agg(*(F.sum(a).alias(out) for out, a in amounts.items()))
                 .select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("_slice_at"),
                         *(F.coalesce(F.sum(out).over(earlier), F.lit(0)).alias(f"_before_{out}") for out in amounts)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    summed = sliced.rows.select(*df.columns, SLICE, *(F.sum(a).over(within).alias(f"_own_{out}") for out, a in amounts.items()))
    # One row per share of the table at most.
    return summed.join(F.broadcast(per_slice), same & (F.col(SLICE) == F.col("_slice_at")), "left").select(
        *df.columns, *((F.col(f"_own_{out}") + F.coalesce(f"_before_{out}", F.lit(0))).cast("bigint").alias(out) for out in amounts))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_no") -> DataFrame:
    """Add ``out`` = 1, 2, ... within each key group in the given total order."""
    return running_sums(df, keys, order, {out: F.lit(1)})


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], out: str = "previous") -> DataFrame:
    """Add struct ``out`` with ``columns`` of the row before in its group (NULL for the first row)."""
    sliced = _sliced(df, keys, order, columns)
    previous = F.lag(F.struct(*columns)).over(W.partitionBy(*keys, SLICE).orderBy(*_sort(order)))
    if sliced.cut:
        # The border in front of a slice is the last row of the slice before.
        carried = F.when(F.col(SLICE) > 0, F.get(F.col(BORDERS), F.col(SLICE) - 1)["taken"])
        previous = F.coalesce(previous, carried)
    return sliced.rows.select(*df.columns, previous.alias(out))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], newest: bool = True) -> DataFrame:
    """The last (or first) row per key by ``order``: a combinable aggregate, so no group is gathered."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    picked = (F.max if newest else F.min)(row).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def text_list(df: DataFrame, keys: Sequence[str], value: str, out: str, per_row: int = 500, order: Sequence[str] = (),
              totals: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct ``value`` in ``order`` (its own, if none is given) joined with ``', '`` per key,
    ``per_row`` values to a row.

    A key with more values continues on further rows (``page`` 1, 2, ...), so nothing is cut off and
    no task ever builds a text of unbounded length. ``totals`` are sums over all values of the key; each page has them.
    """
    totals = totals or {}
    held = df.filter(F.col(value).isNotNull()).select(*keys, value, *order, *(amount.alias(name) for name, amount in totals.items())).distinct()
    numbered = number_rows(held, keys, list(order) or [value], "_n")
    page = (F.floor((F.col("_n") - 1) / F.lit(per_row)) + 1).cast("bigint")
    pages = (numbered.withColumn("page", page).groupBy(*keys, "page")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]), ", ").alias(out),
                  *(F.sum(name).alias(name) for name in totals)))
    whole = W.partitionBy(*keys)
    return pages.withColumns({name: F.sum(name).over(whole) for name in totals})


def on_first_page(*names: str) -> dict[str, Column]:
    """Amounts of a line whose list goes on over several pages: on page 1 only, so that sums over the result are right."""
    return {name: F.when(F.col("page") == 1, F.col(name)) for name in names}
