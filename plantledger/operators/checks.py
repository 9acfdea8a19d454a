"""Verification jobs as check rows (stage, document, label, ok, severity), and their roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantledger.functions import quantities as Q
from plantledger.functions import values as V


def as_checks(df: DataFrame, stage: str, document: Column, checks: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """Each row of ``df`` as one row per check; a check that cannot be evaluated fails."""
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(ok, F.lit(False)).alias("ok"),
                              F.lit(severity).alias("severity")) for label, ok, severity in checks])
    return df.select(F.lit(stage).alias("stage"), document.cast("string").alias("document"), F.inline(rows))


def order_flow(orders: DataFrame, productions: DataFrame, pickings: DataFrame) -> DataFrame:
    """Order confirmed, exactly one production and one outgoing picking, same product, quantity, recipe.

    ``orders``: order_id, state, product_id, quantity, bom_id. ``productions``: order_id, product_id,
    quantity, bom_id. ``pickings``: order_id.
    """
    made = productions.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_productions"), F.min("product_id").alias("made_product"),
        F.min("quantity").alias("made_qty"), F.min("bom_id").alias("made_bom"))
    out = pickings.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_pickings"))
    joined = orders.join(made, "order_id", "left").join(out, "order_id", "left")
    return as_checks(joined, "order flow", F.col("order_id"), [
        ("confirmed", F.col("state") == "sale", "blocker"),
        ("one production", F.col("n_productions") == 1, "blocker"),
        ("product matches", F.col("made_product") == F.col("product_id"), "blocker"),
        ("quantity matches", Q.near(F.col("made_qty"), F.col("quantity")), "major"),
        ("recipe matches", F.col("made_bom") == F.col("bom_id"), "major"),
        ("one outgoing picking", F.col("n_pickings") == 1, "blocker")])


def sync(erp: DataFrame, plant: DataFrame, erp_parts: DataFrame, plant_parts: DataFrame) -> DataFrame:
    """ERP order against the plant's record: presence, quantity, unit, component set, label fields.

    ``erp``: order_id, quantity, uom, customer. ``plant``: order_id, quantity, uom, label_context (JSON
    text). The part frames are (order_id, component_id).
    """
    parts = (erp_parts.select("order_id", "component_id", F.lit(1).alias("_side"))
             .unionByName(plant_parts.select("order_id", "component_id", F.lit(2).alias("_side")))
             .groupBy("order_id", "component_id").agg(F.bool_or(F.col("_side") == 1).alias("_erp"),
                                                      F.bool_or(F.col("_side") == 2).alias("_plant")))
    missing = parts.groupBy("order_id").agg(F.count_if(F.col("_erp") & ~F.col("_plant")).alias("n_missing"))
    there = plant.select("order_id", F.col("quantity").alias("plant_qty"), F.col("uom").alias("plant_uom"),
                         V.json_field(F.col("label_context"), "$.customer").alias("label_customer"),
                         V.json_field(F.col("label_context"), "$.customer_po").alias("label_po"), F.lit(True).alias("_there"))
    joined = erp.join(there, "order_id", "left").join(missing, "order_id", "left")
    return as_checks(joined, "plant sync", F.col("order_id"), [
        ("record present", F.col("_there").isNotNull(), "blocker"),
        ("target quantity", Q.near(F.col("plant_qty"), F.col("quantity")), "major"),
        ("unit", F.col("plant_uom") == F.col("uom"), "minor"),
        ("components complete", F.col("n_missing") == 0, "blocker"),
        ("label customer", F.col("label_customer") == F.col("customer"), "minor"),
        ("label order number", F.col("label_po") == F.concat(F.lit("SO"), F.col("order_id").cast("string")), "minor")])


def pick(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Pick sheet recomputed and compared with the plan, per picking.

    ``lines``: picking_id, package_name, quantity, lot_name. ``plan``: picking_id, package_name,
    planned_qty. Sets of pallets agree when neither side has one the other lacks.
    """
    keys = ["picking_id", "package_name"]
    actual = lines.filter(F.col("package_name").isNotNull()).groupBy(*keys).agg(
        F.sum("quantity").alias("qty"), F.count(F.lit(1)).alias("n"), F.count("lot_name").alias("n_lot"))
    both = actual.join(plan, keys, "full_outer")
    per_picking = both.groupBy("picking_id").agg(
        F.count("planned_qty").alias("n_planned"), F.count("qty").alias("n_actual"),
        F.count_if(F.col("planned_qty").isNull()).alias("n_extra"), F.count_if(F.col("qty").isNull()).alias("n_missing"),
        F.bool_and(Q.near(F.col("qty"), F.col("planned_qty"))).alias("qty_ok"),
        F.bool_and(F.coalesce(F.col("n") == F.col("n_lot"), F.lit(False))).alias("lots_ok"))
    return as_checks(per_picking, "pick sheet", F.col("picking_id"), [
        ("pallet count", F.col("n_actual") == F.col("n_planned"), "major"),
        ("all pallets present", F.col("n_missing") == 0, "blocker"),
        ("pallet quantities", F.col("qty_ok"), "blocker"),
        ("lots on all lines", F.col("lots_ok"), "major"),
        ("pallet set matches", (F.col("n_missing") == 0) & (F.col("n_extra") == 0), "minor")])


def shipping(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Delivery done, dated, without backorder, one lot kept, shipped as ordered, stock moved out.

    ``orders``: order_id, order_status. ``lines``: order_id, ordered, shipped, lot_name, ship_date.
    """
    per_order = lines.groupBy("order_id").agg(
        F.sum("ordered").alias("ordered"), F.sum("shipped").alias("shipped"), F.max("ship_date").alias("done_at"),
        F.min("lot_name").alias("low_lot"), F.max("lot_name").alias("high_lot"),
        F.count("lot_name").alias("n_lot"), F.count(F.lit(1)).alias("n"))
    joined = orders.join(per_order, "order_id", "left")
    left = F.col("ordered") - F.col("shipped")
    return as_checks(joined, "shipping", F.col("order_id"), [
        ("done", F.col("order_status") == "F", "blocker"),
        ("date set", F.col("done_at").isNotNull(), "major"),
        ("no backorder", left <= 0, "major"),
        ("one lot kept", (F.col("n") == F.col("n_lot")) & (F.col("low_lot") == F.col("high_lot")), "minor"),
        ("shipped as ordered", Q.near(F.col("shipped"), F.col("ordered")), "blocker"),
        ("stock moved out", left == 0, "major")])


def invoice(orders: DataFrame, invoices: DataFrame, lines: DataFrame, partners: DataFrame) -> DataFrame:
    """Invoice against its order: state, partner or child contact, origin, one product line, quantity,
    unit, price. Section and note lines do not count.

    ``orders``: order_id, partner_id, quantity, uom, price. ``invoices``: order_id, state, partner_id,
    origin. ``lines``: order_id, display_type, quantity, uom, price. ``partners``: partner_id, commercial_id.
    """
    products = lines.filter(F.col("display_type").isNull() | (F.col("display_type") == "product")).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("quantity").alias("inv_qty"), F.min("uom").alias("inv_uom"),
        F.min("price").alias("inv_price"))
    contact = partners.select(F.col("partner_id").alias("inv_partner"), F.col("commercial_id").alias("inv_commercial"))
    heads = invoices.select("order_id", "state", F.col("partner_id").alias("inv_partner"), "origin")
    joined = (orders.join(heads, "order_id", "left").join(contact, "inv_partner", "left")
              .join(products, "order_id", "left"))
    customer = F.col("partner_id")
    return as_checks(joined, "invoice", F.col("order_id"), [
        ("invoice created", F.col("state").isNotNull(), "blocker"),
        ("state is draft", F.col("state") == "draft", "minor"),
        ("partner", (F.col("inv_partner") == customer) | (F.col("inv_commercial") == customer), "major"),
        ("origin", F.col("origin") == F.concat(F.lit("SO"), F.col("order_id").cast("string")), "minor"),
        ("one product line", F.col("n_lines") == 1, "major"),
        ("quantity", Q.near(F.col("inv_qty"), F.col("quantity")), "blocker"),
        ("unit", F.col("inv_uom") == F.col("uom"), "major"),
        ("price", Q.near(F.col("inv_price"), F.col("price")), "blocker")])


def step(deltas: DataFrame) -> DataFrame:
    """After a production step: quantity grew, packaging grew by about one or more, transfer done.

    ``deltas``: step_id, qty_before, qty_after, packs_before, packs_after, transfer_state.
    """
    return as_checks(deltas, "production step", F.col("step_id"), [
        ("quantity grew", F.col("qty_after") > F.col("qty_before"), "blocker"),
        ("packaging grew", F.col("packs_after") - F.col("packs_before") >= 0.99, "major"),
        ("transfer done", F.col("transfer_state") == "done", "major")])


def matrix(checks: DataFrame) -> DataFrame:
    """Stage by status with the gravest failed severity, and one row for all stages; nothing is fixed text."""
    rank = F.when(F.col("severity") == "blocker", 3).when(F.col("severity") == "major", 2).otherwise(1)
    failed = ~F.col("ok")
    # one row per stage before the rows are doubled for the row of all stages
    stages = checks.groupBy("stage").agg(F.count(F.lit(1)).alias("_n"), F.count_if(failed).alias("_failed"), F.max(F.when(failed, rank)).alias("_rank"))
    sums = (stages.groupingSets([["stage"], []], "stage").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_checks"), F.coalesce(F.sum("_failed"), F.lit(0)).alias("n_failed"),
        F.coalesce(F.max("_rank"), F.lit(0)).alias("_worst"), F.grouping("stage").alias("_all")))
    return sums.select(
        F.when(F.col("_all") == 1, "(all)").otherwise(F.col("stage")).alias("stage"),
        F.when(F.col("n_failed") == 0, "PASS").otherwise("FAIL").alias("status"), "n_checks", "n_failed",
        F.element_at(F.array(*[F.lit(s) for s in ("", "minor", "major", "blocker")]), F.col("_worst") + 1).alias("severity"))
