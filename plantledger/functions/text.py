"""Text expressions: lot and pallet names, line splitting, number text, rule-based rewriting."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantledger.functions.values import date_class


def batch_of(lot: Column) -> Column:
    """Batch name of a lot: everything before the last ``-``."""
    tail = F.length(F.substring_index(lot, "-", -1))
    return F.when(lot.contains("-"), F.substring(lot, F.lit(1), F.length(lot) - tail - 1)).otherwise(lot)


def display_id(package: Column) -> Column:
    """Pallet id as printed: warehouse prefixes dropped."""
    return F.replace(F.replace(package, F.lit("WH/MO/"), F.lit("")), F.lit("WH/"), F.lit(""))


def pallet_prefix(package: Column) -> Column:
    return F.regexp_replace(F.coalesce(package, F.lit("")), "(?s)^(.*)-PAL-.*$", "$1")


#: Stands for "no number": above every number of up to 37 digits.
NO_NUMBER = "9" * 38


def pallet_number(package: Column) -> Column:
    """Trailing pallet number; names without one sort last."""
    digits = F.regexp_extract(F.coalesce(package, F.lit("")), "(?s)^.*-PAL-([0-9]+)$", 1)
    return F.coalesce(digits.try_cast("decimal(38,0)"), F.lit(NO_NUMBER).cast("decimal(38,0)"))


def strip_prefix(text: Column, prefix: str) -> Column:
    """The text without ``prefix`` at its start; other texts stay as they are."""
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def first_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(text, "\\R"), F.lit(1)), F.lit(""))


def other_lines(text: Column) -> Column:
    """Lines after the first, joined by a newline again; empty when there is only one."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\\R$", ""), "\\R")
    return F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")


def safe_token(text: Column) -> Column:
    return F.translate(F.trim(text), "/ ", "__")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


#: 10 to the power n + 11 for n = -5 .. 12: what divides 10**16 times a number of n + 1 digits before the point to leave six digits.
_POWERS = [10 ** (n + 11) for n in range(-5, 13)]


def _six_digits(v: Column) -> Column:
    """(digits, power): six significant digits of a number, half to even on its decimal digits, and the power of ten of the first."""
    power = F.floor(F.log10(F.abs(v))).cast("int")
    divisor = F.get(F.array(*[F.lit(str(p)).cast("decimal(38,0)") for p in _POWERS]), power + 5)
    scaled = (F.abs(v).cast("decimal(38,16)").cast("string"))
    whole = F.replace(scaled, F.lit("."), F.lit("")).cast("decimal(38,0)")

    def rounded(part: Column) -> Column:
        rest, size = part["rest"], part["size"]
        up = (rest * 2 > size) | ((rest * 2 == size) & (part["digits"] % 2 == 1))
        full = part["digits"] + up.cast("int")
        # 999999.5 and the like take up one more digit.
        return F.when(full == 1_000_000, F.struct(F.lit(100_000).cast("bigint").alias("digits"), (part["power"] + 1).alias("power"))).otherwise(
            F.struct(full.alias("digits"), part["power"].alias("power")))

    def divided(pair: Column) -> Column:
        count = F.floor(pair["whole"] / pair["size"]).cast("bigint")
        return F.struct(count.alias("digits"), (pair["whole"] - count * pair["size"]).alias("rest"), pair["size"].alias("size"), pair["power"].alias("power"))

    return bound(bound(F.struct(whole.alias("whole"), divisor.alias("size"), power.alias("power")), divided), rounded)


def _without_zeros(text: Column) -> Column:
    """A text with a point, without zeros at its end and without a point there."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def number_text(x: Column) -> Column:
    """Up to six significant digits without trailing zeros; exponent form outside 1e-4 .. 1e6."""
    def laid_out(number: Column) -> Column:
        digits, power = number["digits"].cast("string"), number["power"]
        plain = (F.when(power >= 0, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6))))
                 .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)))
        mantissa = F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))
        exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
        return F.when((power >= -4) & (power < 6), _without_zeros(plain)).otherwise(F.concat(_without_zeros(mantissa), exponent))

    def far(text: Column) -> Column:
        return F.concat(_without_zeros(F.regexp_extract(text, "^(-?[0-9.]+)e", 1)), F.regexp_extract(text, "(e[+-][0-9]+)$", 1))

    def shown(v: Column) -> Column:
        size = F.abs(v)
        return (F.when(v.isNull(), F.lit(None).cast("string"))
                .when((v == F.floor(v)) & (size < 1_000_000), v.cast("bigint").cast("string"))
                .when((size >= 1e-5) & (size < 1e13), F.concat(F.when(v < 0, "-").otherwise(""), bound(_six_digits(v), laid_out)))
                .otherwise(bound(F.format_string("%.5e", v), far)))

    return bound(x.cast("double"), shown)


def money_text(x: Column) -> Column:
    return F.format_number(x, 2)


def weight_text(x: Column) -> Column:
    """One decimal, half to even; ``-`` without a weight or for 0."""
    known = x.isNotNull() & (x != 0)
    return F.when(known, F.format_string("%.1f", F.bround(x.cast("decimal(38,10)"), 1).cast("double"))).otherwise("-")


def dims_text(length: Column, width: Column, height: Column) -> Column:
    """Length x width x height with ``-`` for a side that is missing; a single ``-`` when all are."""
    sides = [F.coalesce(number_text(side), F.lit("-")) for side in (length, width, height)]
    return F.when(F.coalesce(length, width, height).isNull(), "-").otherwise(F.concat_ws(" x ", *sides))


def drop_items(text: Column, items: Sequence[str]) -> Column:
    """Comma list without the named items."""
    kept = F.filter(F.split(text, ","), lambda item: ~F.trim(item).isin(*items))
    return F.array_join(kept, ",")


def mask_password(url: Column) -> Column:
    """The password ends at the last ``@`` before the path."""
    return F.regexp_replace(url, "(://[^:/@]+):[^/]*@", "$1:***@")


def scrub_times(text: Column) -> Column:
    """Words of a text that are a date with a time give way to a mark; words end at white space, quotes, commas and brackets."""
    ends = "\\s\"',;<>\\[\\]{}()"
    words = F.split(text, f"(?<=[{ends}])|(?=[{ends}])")
    return F.trim(F.array_join(F.transform(words, lambda w: F.when(date_class(w).isin("iso_z", "iso_no_z"), "(time)").otherwise(w)), ""))


class Rule(NamedTuple):
    """One rewriting rule: name, Java pattern, replacement."""

    label: str
    pattern: str
    replacement: str


def apply_rules(text: Column, rules: Sequence[Rule]) -> tuple[Column, list[Column]]:
    """Rules one after the other; returns the final text and the hits each rule had on its input."""
    current, hits = text, []
    for rule in rules:
        hits.append(F.regexp_count(current, F.lit(rule.pattern)).cast("bigint"))
        current = F.regexp_replace(current, rule.pattern, rule.replacement)
    return current, hits
