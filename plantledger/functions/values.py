"""Typed reading of loosely typed text: dates, truth values, numbers, JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date text classes and the pattern of each, tried in this order.
DATE_CLASSES = {
    "iso_z": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$",
    "iso_no_z": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$",
    "sql_space": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$",
    "date_only": r"^\d{4}-\d{2}-\d{2}$",
    "epoch_seconds": r"^\d{10}(\.\d+)?$",
    "epoch_ms": r"^\d{13}$",
}

# Storage classes accepted for each declared column type.
ACCEPTED_STORAGE = {
    "INTEGER": ("integer",), "INT": ("integer",), "BIGINT": ("integer",), "BOOLEAN": ("integer",),
    "REAL": ("real", "integer"), "FLOAT": ("real", "integer"), "NUMERIC": ("real", "integer"),
    "TEXT": ("text",), "VARCHAR": ("text",), "CHAR": ("text",), "JSON": ("text",),
    "DATETIME": ("text",), "TIMESTAMP": ("text",), "DATE": ("text",), "BLOB": ("blob",),
}


def date_class(text: Column) -> Column:
    """Format class of a date text, ``unknown`` when none fits, NULL for NULL."""
    named = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, pattern in DATE_CLASSES.items():
        named = named.when(text.rlike(pattern), name)
    return named.otherwise("unknown")


def parse_date(text: Column) -> Column:
    """Naive timestamp from ISO (with or without literal Z), SQL or plain date text; NULL otherwise.

    Fractions of a second have one to six digits.
    """
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?$"
                       r"|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$")
    naive = F.regexp_replace(text, "Z$", "")
    return F.when(shape, naive.try_cast("timestamp_ntz"))


def date_columns(declared: Mapping[str, str]) -> list[str]:
    """The columns that hold dates: by their declared type, or, where it is a text type, by the last word of their name."""
    def holds_dates(name: str, kind: str) -> bool:
        base = kind.split("(")[0].strip().upper()
        if base in ("DATE", "DATETIME", "TIMESTAMP"):
            return True
        return base in ("", "TEXT", "VARCHAR", "CHAR") and name.lower().split("_")[-1] in ("at", "on", "day", "date", "time")
    return [name for name, kind in declared.items() if holds_dates(name, kind)]


def accepted_storage(declared: str) -> tuple[str, ...]:
    """Storage classes allowed for a declared type; empty for types outside the fixed list."""
    return ACCEPTED_STORAGE.get(declared.upper().split("(")[0].strip(), ())


def storage_class(text: Column) -> Column:
    """Class a text value would be stored as: integer, real or text."""
    return (F.when(text.isNull(), F.lit(None).cast("string"))
            .when(text.rlike(r"^[+-]?\d+$"), "integer")
            .when(text.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "real")
            .otherwise("text"))


def cutoff(newest: Column, seconds: int) -> Column:
    """The time so many seconds before the newest."""
    return newest - F.make_dt_interval(secs=F.lit(seconds))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from one time to the other, as a run's duration is told."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000).cast("bigint")


def to_bool(text: Column) -> Column:
    """Truth of a stored flag: ``''`` is NULL, ``0 / f / false / n / no`` false, all else true."""
    lowered = F.lower(F.trim(text))
    return (F.when(text.isNull() | (lowered == ""), F.lit(None).cast("boolean"))
            .otherwise(~lowered.isin("0", "0.0", "f", "false", "n", "no")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def json_malformed(text: Column) -> Column:
    """True where non-empty text does not parse as JSON; the raw text stays available to the caller."""
    return text.isNotNull() & (text != "") & F.try_parse_json(text).isNull()


def json_field(text: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(text), path, kind)
