"""Quantities: unit classes, piece counts, rolls and pallets, tolerances, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TARE_LB = 50.0
# Name fragments of measured and of aggregate units.
MEASURE_NAMES = ("lb", "kg", "pound", "ft", "foot", "feet")
AGGREGATE_NAMES = ("thousand", "million")
POUND_NAMES = ("lb", "lbs", "pound", "pounds")


def unit_class(uom: Column) -> Column:
    """``measure`` (weight or length), ``aggregate`` (thousands, millions) or ``discrete``."""
    return (F.when(_names_any(uom, MEASURE_NAMES), "measure").when(_names_any(uom, AGGREGATE_NAMES), "aggregate")
            .otherwise("discrete"))


def _names_any(uom: Column, names: tuple[str, ...]) -> Column:
    lowered = F.lower(F.coalesce(uom, F.lit("")))
    return reduce(lambda a, b: a | b, [lowered.contains(name) for name in names])


def pieces_of(quantity: Column, uom: Column, count_per_unit: Column) -> Column:
    """Pieces behind one line: a measured lot is one piece, thousands and millions go through the
    product's count per unit, all else is the rounded quantity; never below one."""
    qty = F.coalesce(quantity, F.lit(0.0))
    factor = F.when(F.lower(uom).contains("million"), F.lit(1_000_000.0)).otherwise(F.lit(1000.0))
    usable = F.coalesce(count_per_unit, F.lit(0)) != 0
    converted = F.rint(qty * factor / F.when(usable, count_per_unit.cast("double")))
    kind = unit_class(uom)
    pieces = (F.when(kind == "measure", F.lit(1.0)).when(kind == "aggregate", F.coalesce(F.greatest(F.lit(1.0), converted), F.lit(1.0)))
              .otherwise(F.greatest(F.lit(1.0), F.rint(qty))))
    return pieces.cast("bigint")


def full_rolls(quantity: Column, per_roll: Column) -> Column:
    return F.floor(quantity / per_roll).cast("bigint")


def pallets_for(rolls: Column, per_pallet: Column) -> Column:
    return F.ceil(rolls / per_pallet).cast("bigint")


def scale(order_qty: Column, bom_qty: Column) -> Column:
    """Order quantity over recipe quantity; a missing or zero recipe quantity counts as one."""
    base = F.when(F.coalesce(bom_qty, F.lit(0.0)) != 0, bom_qty).otherwise(F.lit(1.0))
    return order_qty / base


def near(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    return F.coalesce(F.abs(a - b) < F.lit(tolerance), F.lit(False))


def gross_weight(net: Column) -> Column:
    return net + F.lit(TARE_LB)


def off_by_more_than(entered: Column, expected: Column, share: float = 0.10) -> Column:
    return F.abs(entered - expected) > F.lit(share) * expected


def cents(x: Column) -> Column:
    """Exact two-digit decimal of a money column."""
    return x.cast("decimal(18,2)")
