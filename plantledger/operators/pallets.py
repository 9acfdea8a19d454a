"""Pallets: building, spreading units, unit ranges, verification, reconciliation, weights, wiring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantledger.functions import quantities as Q
from plantledger.operators.checks import as_checks
from plantledger.operators.ordering import latest, number_rows, on_first_page, text_list


def build(units: DataFrame, key: str, order: Sequence[str], per_pallet: int) -> DataFrame:
    """Ordered units of each order on numbered pallets of ``per_pallet``."""
    numbered = number_rows(units, [key], order, "unit_index")
    number = F.ceil(F.col("unit_index") / per_pallet).cast("bigint")
    return numbered.withColumn("pallet_no", number).withColumn(
        "pallet_id", F.concat(F.col(key), F.lit("-PAL-"), F.col("pallet_no").cast("string")))


def spread(units: DataFrame, key: str, order: Sequence[str], parents: int) -> DataFrame:
    """Units of each order over ``parents`` parents in contiguous runs, remainder to the first ones."""
    numbered = number_rows(units, [key], order, "unit_index")
    sizes = units.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    base = F.floor(F.col("_n") / parents)
    extras = F.col("_n") - base * parents
    index, head = F.col("unit_index"), extras * (base + 1)
    parent = F.when(index <= head, F.ceil(index / (base + 1))).otherwise(
        extras + F.ceil((index - head) / F.greatest(base, F.lit(1))))
    return numbered.join(sizes, key).withColumn("parent_no", parent.cast("bigint")).drop("_n")


def unit_ranges(units: DataFrame, keys: Sequence[str], number: str, per_row: int = 500) -> DataFrame:
    """Gap-aware text of the unit numbers of each group: ``1-3, 5, 7-8``.

    Runs are found first, so the text is made from runs and not from single units.
    """
    distinct = units.filter(F.col(number).isNotNull()).select(*keys, number).distinct()
    runs = (number_rows(distinct, keys, [number], "_n")
            .groupBy(*keys, (F.col(number) - F.col("_n")).alias("_run"))
            .agg(F.min(number).alias("_low"), F.max(number).alias("_high"), F.count(F.lit(1)).alias("_units")))
    low, high = F.col("_low").cast("string"), F.col("_high").cast("string")
    named = runs.withColumn("_text", F.when(F.col("_low") == F.col("_high"), low).otherwise(F.concat(low, F.lit("-"), high)))
    texts = text_list(named, keys, "_text", "units", per_row, order=["_low"], totals={"n_units": F.col("_units"), "n_runs": F.lit(1)})
    return texts.withColumns(on_first_page("n_units", "n_runs"))


def verify(expected: DataFrame, packages: DataFrame, contents: DataFrame) -> DataFrame:
    """Checks per expected pallet against its own product, lot and order.

    ``expected``: picking_id, package_name, product_id, lot_name, expected_qty, order_no. ``packages``: keys,
    package_type, gross_weight_lb, finalized_at. ``contents``: keys, product_id, quantity, lot_name, order_no. Only
    the expected product counts towards the quantity.
    """
    keys = ["picking_id", "package_name"]
    wanted = expected.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("product_id", "lot_name", "order_no")])
    product = F.col("product_id") == F.col("_product_id")
    inside = contents.join(wanted, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(product, F.col("quantity"))), F.lit(0.0)).alias("fg_qty"), F.bool_or(product).alias("has_product"),
        F.bool_or(product & (F.col("lot_name") == F.col("_lot_name"))).alias("has_lot"),
        F.bool_or(F.col("order_no") == F.col("_order_no")).alias("has_order"))
    found = packages.withColumn("_present", F.lit(True))
    joined = expected.join(found, keys, "left").join(inside, keys, "left")
    return as_checks(joined, "pallets", F.concat_ws("/", F.col("picking_id").cast("string"), "package_name"), [
        ("present", F.col("_present").isNotNull(), "blocker"),
        ("package type", F.col("package_type") == "Pallet", "minor"),
        ("weight populated", F.col("gross_weight_lb") > 0, "major"),
        ("finalised", F.col("finalized_at").isNotNull(), "major"),
        ("has product", F.col("has_product"), "blocker"),
        ("quantity", Q.near(F.col("fg_qty"), F.col("expected_qty")), "blocker"),
        ("has finished lot", F.col("has_lot"), "blocker"),
        ("order link", F.col("has_order"), "major"),
    ])


def reconcile(plant: DataFrame, erp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What to pack or unpack per (pallet, lot) so that stock mirrors the plant floor."""
    a = plant.groupBy(*keys).agg(F.sum("units").alias("plant_units"))
    b = erp.groupBy(*keys).agg(F.sum("units").alias("erp_units"))
    p, e = F.coalesce("plant_units", F.lit(0)), F.coalesce("erp_units", F.lit(0))
    return (a.join(b, list(keys), "full_outer")
            .select(*keys, p.alias("plant_units"), e.alias("erp_units"), (p - e).alias("change"))
            .withColumn("action", F.when(F.col("change") > 0, "pack").when(F.col("change") < 0, "unpack").otherwise("ok")))


def replay(erp: DataFrame, plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stock after the plan was carried out."""
    moved = plan.filter(F.col("change") != 0).select(*keys, F.col("change").alias("units"))
    after = erp.select(*keys, "units").unionByName(moved).groupBy(*keys).agg(F.sum("units").alias("units"))
    return after.filter(F.col("units") != 0)


def weight_check(packages: DataFrame, scans: DataFrame) -> DataFrame:
    """Scale entries judged: unknown pallet or non-positive weight is rejected, more than 10 % off the
    expected gross weight warns. ``packages``: pallet_id, net_lb. ``scans``: scan_id, pallet_id, weight."""
    known = packages.select("pallet_id", Q.gross_weight(F.col("net_lb")).alias("expected_lb"))
    joined = scans.join(known, "pallet_id", "left")
    verdict = (F.when(F.col("pallet_id").isNull() | (F.col("pallet_id") == ""), "reject: no pallet id")
               .when(F.col("expected_lb").isNull(), "reject: unknown pallet")
               .when(F.col("weight") <= 0, "reject: weight")
               .when(Q.off_by_more_than(F.col("weight"), F.col("expected_lb")), "warn").otherwise("ok"))
    return joined.select("scan_id", "pallet_id", "weight", F.coalesce("expected_lb", F.lit(0.0)).alias("expected_lb"),
                         verdict.alias("verdict"))


def finalize_history(scans: DataFrame, shipments: DataFrame) -> DataFrame:
    """Last accepted weight per pallet; scans after the pallet shipped are blocked, non-positive rejected.

    ``scans``: pallet_id, scan_id, scanned_at, weight. ``shipments``: pallet_id, shipped_at.
    """
    shipped = shipments.groupBy("pallet_id").agg(F.min("shipped_at").alias("shipped_at"))
    judged = scans.join(shipped, "pallet_id", "left").withColumn(
        "_state", F.when(F.col("scanned_at") >= F.col("shipped_at"), "blocked").when(F.col("weight") <= 0, "rejected")
        .otherwise("accepted"))
    counts = judged.groupBy("pallet_id").agg(*[F.count_if(F.col("_state") == s).alias(f"n_{s}")
                                               for s in ("accepted", "blocked", "rejected")])
    last = latest(judged.filter(F.col("_state") == "accepted").select("pallet_id", "scanned_at", "scan_id", "weight"),
                  ["pallet_id"], ["scanned_at", "scan_id"])
    return counts.join(last, "pallet_id", "left").select(
        "pallet_id", F.coalesce("weight", F.lit(0.0)).alias("gross_weight"),
        F.coalesce(F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("finalized_at"),
        "n_accepted", "n_blocked", "n_rejected")


def rewire_plan(lines: DataFrame, pallets: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Pickings with one line per pallet in the right quantity keep their lines; others get their lines
    deleted and one line per pallet created. ``lines``: picking_id, package_name, quantity.
    ``pallets``: picking_id, package_name, quantity."""
    keys = ["picking_id", "package_name"]
    existing = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("quantity"))
    wanted = pallets.select(*keys, F.col("quantity").alias("_wanted"))
    paired = existing.join(wanted, keys, "full_outer")
    fits = (F.col("n_lines") == 1) & (F.abs(F.col("quantity") - F.col("_wanted")) < tolerance)
    wired = paired.groupBy("picking_id").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("_wired"))
    kept = existing.join(wired, "picking_id").select(
        "picking_id", F.when(F.col("_wired"), "keep").otherwise("delete").alias("action"),
        F.coalesce("package_name", F.lit("(loose)")).alias("package_name"), "n_lines", "quantity")
    made = pallets.join(wired.filter(~F.col("_wired")), "picking_id").select(
        "picking_id", F.lit("create").alias("action"), "package_name", F.lit(1).cast("bigint").alias("n_lines"), "quantity")
    return kept.unionByName(made)


def open_unassigned(lines: DataFrame, lots_made: DataFrame) -> DataFrame:
    """Open outgoing lines with a lot and no package, counted per (lot, picking, product) and placed by falling count, ties by key;
    with the order that makes the lot. ``lots_made``: a row of order_no and lot_name for each lot an order produces."""
    open_lines = lines.filter(F.col("package_name").isNull() & F.col("lot_name").isNotNull() & (F.col("state") != "done"))
    counted = open_lines.groupBy("lot_name", "picking_id", "product_id").agg(F.count(F.lit(1)).alias("n_cases"))
    made = lots_made.groupBy("lot_name").agg(F.min("order_no").alias("made_by"))
    named = counted.join(made, "lot_name", "left").select(
        "lot_name", "picking_id", "product_id", "n_cases", F.coalesce("made_by", F.lit("")).alias("made_by"))
    placed = number_rows(named.withColumn("_all", F.lit(0)), ["_all"], ["-n_cases", "lot_name", "picking_id", "product_id"], "place")
    return placed.drop("_all")
