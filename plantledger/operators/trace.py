"""Lot tracing in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantledger.operators.ordering import on_first_page, text_list

NO_LOT = "(no lot)"
PLACEHOLDER_PREFIX = "FIX_DATA_"


def material_lots(consumption: DataFrame) -> DataFrame:
    """Material by lot consumption of each order, NULL lots left out, with the order's pound total.

    ``consumption``: order_no, product_id, lot_name, quantity, uom. Pounds count by name fragment and
    include lines without a lot.
    """
    per_lot = consumption.groupBy("order_no", "product_id", "lot_name").agg(
        F.sum("quantity").alias("quantity"),
        F.coalesce(F.sum(F.when(F.lower("uom").contains("lb"), F.col("quantity"))), F.lit(0.0)).alias("_lb"))
    pounds = per_lot.groupBy("order_no").agg(F.sum("_lb").alias("total_lb"))
    return (per_lot.filter(F.col("lot_name").isNotNull()).drop("_lb").join(pounds, "order_no"))


def backward(consumption: DataFrame, lots_per_row: int = 500) -> DataFrame:
    """Raw materials behind each finished lot: total, lots, and whether one of the lots is a real one
    (named, and not a placeholder of a data repair)."""
    keys = ["order_no", "product_id"]
    real = F.col("lot_name").isNotNull() & ~F.col("lot_name").startswith(PLACEHOLDER_PREFIX) & (F.col("lot_name") != NO_LOT)
    per_lot = consumption.groupBy(*keys, "lot_name").agg(F.sum("quantity").alias("quantity"))
    totals = per_lot.groupBy(*keys).agg(F.sum("quantity").alias("total"), F.count(F.lit(1)).alias("n_lots"),
                                        F.bool_or(real).alias("traced"))
    named = per_lot.select(*keys, F.coalesce("lot_name", F.lit(NO_LOT)).alias("lot"))
    lots = text_list(named, keys, "lot", "lots", lots_per_row)
    return totals.join(lots, keys).withColumns(on_first_page("total", "n_lots"))


def forward(consumption: DataFrame, productions: DataFrame, deliveries: DataFrame, partners: DataFrame) -> DataFrame:
    """Customers a raw lot reached: raw lot, orders that used it, finished lots delivered (done only).

    ``consumption``: raw_lot, order_id, quantity. ``productions``: order_id, finished_lot.
    ``deliveries``: finished_lot, partner_id, state. ``partners``: partner_id, commercial_id.
    An order counts once per raw lot and customer, however many finished lots or delivery lines lead there.
    """
    used = consumption.groupBy("raw_lot", "order_id").agg(F.sum("quantity").alias("quantity"))
    reached = (productions.join(deliveries.filter(F.col("state") == "done").select("finished_lot", "partner_id").distinct(), "finished_lot")
               .join(partners.select("partner_id", "commercial_id"), "partner_id")
               .select("order_id", "finished_lot", "commercial_id").distinct())
    lots = used.join(reached, "order_id")
    finished = lots.groupBy("raw_lot", "commercial_id").agg(F.count_distinct("finished_lot").alias("n_finished_lots"))
    orders = used.join(reached.select("order_id", "commercial_id").distinct(), "order_id").groupBy("raw_lot", "commercial_id").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("quantity").alias("quantity"))
    return orders.join(finished, ["raw_lot", "commercial_id"]).select("raw_lot", "commercial_id", "n_orders", "n_finished_lots", "quantity")
