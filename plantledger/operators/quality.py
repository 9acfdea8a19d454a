"""Pre-flight checks: orphans, storage classes, date formats, duplicate keys, overlapping sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantledger.functions import values as V


def orphan_keys(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Foreign keys without a parent, with the rows that carry each.

    Children are counted per key before the join, so a key held by most rows costs one row there.
    A NULL among the parent keys hides nothing.
    """
    used = child.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n_rows"))
    return used.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def fk_orphans(links: Sequence[tuple[str, DataFrame, str, str, DataFrame | None, str]]) -> DataFrame:
    """Orphan rows per foreign key; ``links`` are (child name, child, fk, parent name, parent, pk).
    A link whose parent table does not exist is skipped."""
    parts = []
    for child_name, child, fk, parent_name, parent, pk in links:
        if parent is None:
            continue
        found = orphan_keys(child, parent, fk, pk).agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_orphans"),
            F.count(F.lit(1)).alias("n_keys"))
        parts.append(found.select(F.lit(child_name).alias("table_name"), F.lit(fk).alias("fk"),
                                  F.lit(parent_name).alias("parent"), "n_orphans", "n_keys"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def null_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """``child`` with orphan keys set to NULL and ``was_orphan`` telling which; nothing to do where the
    column is declared NOT NULL. Only the orphan keys travel to the child rows."""
    if not child.schema[fk].nullable:
        return child.withColumn("was_orphan", F.lit(False))
    orphans = orphan_keys(child, parent, fk, pk).select(F.col(fk).alias("_orphan"))
    marked = child.join(orphans, F.col(fk) == F.col("_orphan"), "left")
    lost = F.col("_orphan").isNotNull()
    columns = [F.when(~lost, F.col(c)).alias(c) if c == fk else F.col(c) for c in child.columns]
    return marked.select(*columns, lost.alias("was_orphan"))


def type_mismatches(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Columns of text values holding a storage class their declared type does not accept."""
    known = {c: kind for c, kind in declared.items() if V.accepted_storage(kind)}
    accepted = F.create_map(*[x for c, kind in known.items()
                              for x in (F.lit(c), F.array(*[F.lit(a) for a in V.accepted_storage(kind)]))])
    kinds = F.create_map(*[x for c, kind in known.items() for x in (F.lit(c), F.lit(kind.upper()))])
    long = df.select(*known).unpivot([], list(known), "column_name", "value").filter(F.col("value").isNotNull())
    classed = long.withColumn("class", V.storage_class(F.col("value")))
    bad = ~F.array_contains(F.element_at(accepted, F.col("column_name")), F.col("class"))
    return (classed.groupBy("column_name").agg(
        F.array_join(F.array_sort(F.collect_set("class")), ", ").alias("actual_types"),
        F.min(F.when(bad, F.col("value"))).alias("sample"),
        F.count_if(bad).alias("n_bad"))
        .filter(F.col("n_bad") > 0)
        .select("column_name", F.element_at(kinds, F.col("column_name")).alias("declared"),
                "actual_types", "sample", "n_bad"))


def datetime_mix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Date text columns that hold more than one format class."""
    long = df.select(*columns).unpivot([], list(columns), "column_name", "value").filter(F.col("value").isNotNull())
    seen = long.groupBy("column_name", V.date_class(F.col("value")).alias("format")).agg(F.count(F.lit(1)).alias("n"))
    return (seen.groupBy("column_name").agg(
        F.array_join(F.array_sort(F.collect_list("format")), ", ").alias("formats"),
        F.count(F.lit(1)).alias("n_formats"), F.sum("n").alias("n_values"))
        .filter(F.col("n_formats") > 1))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def overlap(sources: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys found in more than one named source, with the rows each source has for them."""
    counted = None
    for name, df in sources.items():
        part = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("source", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    return (counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("sources"),
        F.sum("n_rows").alias("n_rows"))
        .filter(F.col("n_sources") > 1))


class Audit(NamedTuple):
    """What is checked of one table: its key, its foreign keys as (column, parent rows, parent key), the declared type of its text
    columns, and its date columns. A parent that does not exist is None."""

    rows: DataFrame
    key: Sequence[str]
    links: Sequence[tuple[str, DataFrame | None, str]] = ()
    declared: Mapping[str, str] = {}
    dates: Sequence[str] = ()


CHECKS = ("n_rows", "n_orphans", "n_mismatched", "n_mixed_dates", "n_duplicate_keys", "n_null_keys")


def _audited(name: str, audit: Audit) -> DataFrame:
    """All checks of a table from one scan of it.

    Each row is stacked into a cell per key, per foreign key and per text or date column (value or class); one aggregate counts
    the cells, combined before the shuffle, and the checks read its groups.
    """
    rows, kinds = audit.rows, dict(audit.rows.dtypes)
    none, number = F.lit(None), F.lit(None).cast("bigint")

    def cell(code: int, first: Column = number, second: Column = number, text: Column = none) -> Column:
        return F.struct(F.lit(code).alias("cell"), first.alias("a"), second.alias("b"), text.cast("string").alias("text"))

    # Whole numbers stay numbers, which hash and compare faster than text.
    if len(audit.key) <= 2 and all(kinds[k] in ("int", "bigint") for k in audit.key):
        first, second = [*(F.col(k).cast("bigint") for k in audit.key), number, number][:2]
        complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in audit.key])
        cells = [cell(0, F.when(complete, first), F.when(complete, second))]
    else:
        texts = [F.col(k).cast("string") for k in audit.key]
        complete = reduce(lambda a, b: a & b, [t.isNotNull() for t in texts])
        cells = [cell(0, text=F.when(complete, F.concat(*(F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts))))]
    links = [(fk, parent, pk) for fk, parent, pk in audit.links if parent is not None]
    accepted = [V.accepted_storage(kind) for kind in audit.declared.values() if V.accepted_storage(kind)]
    typed = [c for c, kind in audit.declared.items() if V.accepted_storage(kind)]
    at_type = 1 + len(links)
    at_date = at_type + len(typed)
    cells += [cell(1 + i, text=F.col(fk)) if kinds[fk] not in ("int", "bigint") else cell(1 + i, F.col(fk).cast("bigint")) for i, (fk, _, _) in enumerate(links)]
    cells += [cell(at_type + i, text=V.storage_class(F.col(c))) for i, c in enumerate(typed)]
    cells += [cell(at_date + i, text=F.when(F.col(c).isNotNull(), V.date_class(F.col(c)))) for i, c in enumerate(audit.dates)]
    counted = rows.select(F.inline(F.array(*cells))).groupBy("cell", "a", "b", "text").agg(F.count(F.lit(1)).alias("n"))
    code, n, present = F.col("cell"), F.col("n"), F.col("a").isNotNull() | F.col("text").isNotNull()
    counted = counted.filter((code == 0) | (code >= at_type) | present)
    found = F.lit(True)
    for i, (fk, parent, pk) in enumerate(links):
        whole = kinds[fk] in ("int", "bigint")
        keys = parent.select(F.lit(1 + i).alias("_cell"), F.col(pk).cast("bigint" if whole else "string").alias("_value"), F.lit(True).alias(f"_found_{i}")).distinct()
        counted = counted.join(keys, (code == F.col("_cell")) & (F.col("a" if whole else "text") == F.col("_value")), "left").drop("_cell", "_value")
        found = F.when(code == 1 + i, F.col(f"_found_{i}")).otherwise(found)
    fits = reduce(lambda a, b: a | b, [(code == at_type + i) & F.col("text").isin(*kinds_) for i, kinds_ in enumerate(accepted)], F.lit(False))
    typing, dating, link = (code >= at_type) & (code < at_date), code >= at_date, (code > 0) & (code < at_type)

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, n)), F.lit(0))

    per_cell = counted.groupBy("cell").agg(
        total(code == 0).alias("rows"), total(link & found.isNull()).alias("orphans"), total(typing & present & ~fits).alias("unfit"),
        F.count_if(dating & present).alias("formats"), F.count_if((code == 0) & present & (n > 1)).alias("repeated"), total((code == 0) & ~present).alias("keyless"))
    return per_cell.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("orphans"), F.lit(0)).alias("n_orphans"),
        F.count_if(F.col("unfit") > 0).alias("n_mismatched"), F.count_if(F.col("formats") > 1).alias("n_mixed_dates"),
        F.coalesce(F.sum("repeated"), F.lit(0)).alias("n_duplicate_keys"), F.coalesce(F.sum("keyless"), F.lit(0)).alias("n_null_keys"),
    ).select(F.lit(name).alias("table_name"), *(F.col(c).cast("bigint").alias(c) for c in CHECKS))


def preflight(audits: Mapping[str, Audit]) -> DataFrame:
    """Every check of every table, one scan per table: rows, orphan rows, columns with values their declared type does not accept, date
    columns of several formats, keys held by several rows, and rows without a key. Orphans, mismatches and keys block, mixed dates only warn; empty
    tables are left out."""
    out = reduce(DataFrame.unionByName, [_audited(name, audit) for name, audit in audits.items()])
    blockers = F.col("n_orphans") + F.col("n_mismatched") + F.col("n_duplicate_keys") + F.col("n_null_keys")
    return out.filter(F.col("n_rows") > 0).withColumn("status", F.when(blockers > 0, "BLOCKER").when(F.col("n_mixed_dates") > 0, "WARN").otherwise("OK"))
