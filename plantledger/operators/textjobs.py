"""Stored text: rule-based rewriting, drift against a reference copy, stable dumps, log tail."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plantledger.functions import text as X


def patch(df: DataFrame, key: str, column: str, rules: Sequence[X.Rule], residual: str) -> DataFrame:
    """Apply an ordered rule list to stored text; only changed rows come back.

    ``hits_<label>`` counts each rule, ``residual`` the mentions of a pattern left over.
    """
    new, hits = X.apply_rules(F.col(column), rules)
    counted = df.select(key, F.col(column).alias("old_text"), new.alias("new_text"),
                        *[h.alias(f"hits_{r.label}") for h, r in zip(hits, rules)])
    return counted.filter(F.col("old_text") != F.col("new_text")).withColumn(
        "residual", F.regexp_count("new_text", F.lit(residual)).cast("bigint"))


def _canonical_xml(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return ET.canonicalize(f"<fragment>{text}</fragment>")[len("<fragment>"):-len("</fragment>")].strip()
    except ET.ParseError:
        return None


@F.pandas_udf(StringType())
def canonical_xml(texts: pd.Series) -> pd.Series:
    """Canonical form of XML fragments; NULL for text that does not parse."""
    return texts.map(_canonical_xml)


def loose_text(text: Column) -> Column:
    """Text that is no XML: one kind of line end, no blanks before line ends or around the whole."""
    lines = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "[ \\t]+(?=\\n|\\z)", "")
    return F.regexp_replace(lines, "^\\s+|\\s+\\z", "")


def text_drift(source: DataFrame, target: DataFrame, key: str, column: str) -> DataFrame:
    """Stored text compared by key: OK, DRIFT or missing, both sizes as stored, and changed lines.

    Keys, sizes and hashes of the stored text meet first. Only pairs that are not equal as stored are read again and
    brought to a common form; those that then still differ are split. Lines end at line breaks and between tags and
    are compared as multisets, summed per (key, line) over both sides.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        text = F.coalesce(F.col(column), F.lit(""))
        return df.select(key, F.sha2(text, 256).alias(f"_{name}"), F.length(text).cast("bigint").alias(f"{name}_size"))
    both = side(source, "source").join(side(target, "target"), key, "full_outer")
    unequal = both.filter(F.col("_source") != F.col("_target")).select(key)

    def common(df: DataFrame, name: str) -> DataFrame:
        chosen = df.join(unequal, key, "left_semi").select(key, F.coalesce(F.col(column), F.lit("")).alias("_raw"))
        return chosen.select(key, F.coalesce(canonical_xml("_raw"), loose_text(F.col("_raw"))).alias(f"_{name}_text"))
    drifting = (common(source, "source").join(common(target, "target"), key).filter(F.col("_source_text") != F.col("_target_text")))

    def lines(name: str, sign: int) -> DataFrame:
        cut = F.split(F.regexp_replace(f"_{name}_text", ">\\s*<", ">\n<"), "\n")
        return drifting.select(key, F.explode(cut).alias("_line")).select(key, F.md5("_line").alias("_line"), F.lit(sign).alias("_sign"))
    net = lines("source", 1).unionByName(lines("target", -1)).repartition(key, "_line").groupBy(key, "_line").agg(F.sum("_sign").alias("_net"))
    changed = net.groupBy(key).agg(F.sum(F.abs("_net")).alias("changed_lines"))
    status = (F.when(F.col("_target").isNull(), "missing in target").when(F.col("_source").isNull(), "missing in source")
              .when(F.col("changed_lines").isNotNull(), "DRIFT").otherwise("OK"))
    return both.join(changed, key, "left").select(
        key, status.alias("status"), F.coalesce("source_size", F.lit(0)).alias("source_size"),
        F.coalesce("target_size", F.lit(0)).alias("target_size"), F.coalesce("changed_lines", F.lit(0)).alias("changed_lines"))


def log_tail(df: DataFrame, levels: Sequence[str], text: str | None, n: int) -> DataFrame:
    """The newest ``n`` log rows of the given levels, optionally with a text in the message."""
    kept = df.filter(F.col("level").isin(*levels))
    if text:
        kept = kept.filter(F.col("message").ilike(f"%{text}%"))
    return kept.orderBy(F.desc("logged_at"), F.desc("log_id")).limit(n)
