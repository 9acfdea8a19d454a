"""Open-order lists, saved filters, backorders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_open() -> Column:
    """A confirmed order counts as open until its delivery is full."""
    return (F.col("state") == "sale") & (F.col("delivery_status") != "full")


def open_orders(orders: DataFrame, partners: DataFrame, n: int = 50) -> DataFrame:
    """Open orders by due date; the partner's name is looked up for the ``n`` rows shown only."""
    top = orders.filter(is_open()).orderBy("commitment_date", "order_id").limit(n)
    return top.join(partners.select("partner_id", "partner_name"), "partner_id", "left").select(
        "order_id", F.coalesce("partner_name", F.lit("")).alias("partner_name"), "delivery_status",
        F.date_format("commitment_date", "yyyy-MM-dd").alias("due"), "amount_total")


def open_lines(lines: DataFrame, orders: DataFrame, n: int = 150) -> DataFrame:
    """Lines of open orders, ordered against delivered."""
    open_ids = orders.filter(is_open()).select("order_id")
    return (lines.join(open_ids, "order_id", "left_semi")
            .orderBy("order_id", "line_no", "product_id", "supplier_id", "ship_date", "price").limit(n)
            .select("order_id", "line_no", "product_id", "product_uom_qty", "qty_delivered",
                    (F.col("product_uom_qty") - F.col("qty_delivered")).alias("open_qty")))


def made_not_shipped(production: DataFrame, delivered: DataFrame, orders: DataFrame, n: int = 100) -> DataFrame:
    """Production for orders still to be shipped, latest first within an order, with what is left over.
    The balance is blank where nothing was produced."""
    open_ids = orders.filter(is_open()).select("order_id")
    made = production.join(open_ids, "order_id", "left_semi").join(delivered.join(open_ids, "order_id", "left_semi"), "order_id", "left")
    shipped = F.coalesce("delivered", F.lit(0.0))
    balance = F.when(F.col("qty_produced").isNotNull(), F.col("qty_produced") - shipped)
    return (made.orderBy("order_id", F.desc("date_finished")).limit(n)
            .select("order_id", "product_qty", F.coalesce(F.col("qty_produced").cast("string"), F.lit("")).alias("produced"),
                    shipped.alias("delivered"), F.coalesce(balance.cast("string"), F.lit("")).alias("balance"),
                    F.date_format("date_finished", "yyyy-MM-dd").alias("finished")))


def saved_filter(df: DataFrame, name: str, predicates: Mapping[str, Column], group: str, amount: str) -> DataFrame:
    """Rows of a named predicate counted and summed per group key."""
    return (df.filter(predicates[name]).groupBy(F.col(group).cast("string").alias("group_key"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(amount).alias("amount"))
            .select(F.lit(name).alias("filter_name"), "group_key", "n_rows", "amount"))


def backorders(lines: DataFrame, deliveries: DataFrame) -> DataFrame:
    """What is still to be shipped per order, and its newest delivery that is not done (-1 without one)."""
    sums = lines.groupBy("order_id").agg(F.sum("ordered").alias("ordered"), F.sum("shipped").alias("shipped"))
    newest = deliveries.filter(F.col("state") != "done").groupBy("order_id").agg(F.max("picking_id").alias("picking_id"))
    remaining = F.col("ordered") - F.col("shipped")
    return (sums.filter(remaining > 0).join(newest, "order_id", "left")
            .select("order_id", "ordered", "shipped", remaining.alias("remaining"),
                    F.coalesce("picking_id", F.lit(-1)).alias("next_delivery")))
