"""Operations tables derived from the given tables, so that every job grows with them.

The mappings are fixed arithmetic on keys; ``plans/views.py`` states the same ones in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantledger.functions import quantities as Q
from plantledger.functions import text as X
from plantledger.sources.tables import table

LINE_ORDER = ("order_id", "unit_no", "part_id", "supplier_id", "ship_date", "price")


def move_line(spark: SparkSession, folder: str) -> DataFrame:
    """Stock movement lines; ``LINE_ORDER`` is their source order."""
    line = table(spark, folder, "lineitem")
    order_no = F.concat(F.lit("WH/MO/"), F.lpad((F.col("l_suppkey") % 10).cast("string"), 5, "0"))
    unit = F.col("l_linenumber").cast("string")
    return line.select(
        F.floor(F.col("l_orderkey") / 100).cast("bigint").alias("picking_id"),
        (F.col("l_partkey") % 20).alias("product_id"),
        order_no.alias("order_no"),
        F.when(F.col("l_linenumber") != 7, F.concat(order_no, F.lit("-U"), unit)).alias("lot_name"),
        F.when(F.col("l_linenumber") <= 5, F.concat(order_no, F.lit("-PAL-"), unit)).alias("package_name"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_returnflag") == "A", "lb").when(F.col("l_returnflag") == "N", "Thousands")
        .otherwise("Case").alias("uom"),
        F.when(F.col("l_linestatus") == "F", "done").otherwise("assigned").alias("state"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("unit_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_shipdate").alias("ship_date"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_partkey") % 9 == 0, "Bundle").alias("move_packaging"),
    )


def move(lines: DataFrame) -> DataFrame:
    """One stock move per (picking, product): ordered, shipped, unit and supplier of its first line."""
    return lines.groupBy("picking_id", "product_id").agg(
        F.sum("quantity").alias("ordered"),
        F.coalesce(F.sum(F.when(F.col("state") == "done", F.col("quantity"))), F.lit(0.0)).alias("shipped"),
        F.count_distinct("package_name").alias("n_pallets"),
        F.min(F.struct(*LINE_ORDER, "uom")).alias("_first"),
    ).select("picking_id", "product_id", "ordered", "shipped", "n_pallets", "_first.uom", "_first.supplier_id")


def package(lines: DataFrame) -> DataFrame:
    """Pallet records with dimensions, gross weight and the time they were finalised."""
    return (lines.filter(F.col("package_name").isNotNull()).groupBy("picking_id", "package_name")
            .agg(Q.gross_weight(F.sum("quantity")).alias("gross_weight_lb"),
                 F.max("ship_date").alias("finalized_at"))
            .withColumn("length", F.lit(40.0)).withColumn("width", F.lit(48.0))
            .withColumn("height", F.when(X.pallet_number(F.col("package_name")) == 5, 46.0).otherwise(52.0)))


def product(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_partkey").cast("string").alias("product_name"),
        F.concat("p_name", F.lit("\n"), "p_brand").alias("display_name"),
        F.when(size % 10 != 0, F.when(size % 2 == 0, "Roll").otherwise("Case")).alias("packaging_name"),
        size.cast("bigint").alias("packaging_qty"),
        F.when(size % 5 != 0, size.cast("bigint") * 100).alias("count_per_unit"),
        F.when(F.col("p_type") == "PROMO", "phantom").otherwise("normal").alias("bom_type"),
    )


def quant(spark: SparkSession, folder: str) -> DataFrame:
    """Stock by (product, lot key, location) with the date it came in."""
    line = table(spark, folder, "lineitem")
    return (line.groupBy((F.col("l_partkey") % 200).alias("product_id"), (F.col("l_suppkey") % 20).alias("lot_key"),
                         F.col("l_linestatus").alias("_status"))
            .agg(F.sum("l_quantity").alias("quantity"),
                 F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0))
                 .alias("reserved"),
                 F.min("l_shipdate").alias("in_date"))
            .select("product_id", "lot_key",
                    F.when(F.col("lot_key") != 13, F.col("lot_key")).alias("lot"),
                    F.when(F.col("_status") == "F", "Stock").otherwise("customer").alias("location"),
                    "quantity", "reserved", "in_date"))


def stock_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Stock records per product and location."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("product_id"), F.col("c_nationkey").alias("location_id"),
        F.col("c_acctbal").alias("quantity"), F.col("c_mktsegment").alias("segment"))


def locations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("location_id"),
        F.when(F.col("n_regionkey") <= 2, "internal").otherwise("customer").alias("usage"))


def kits(balance: DataFrame) -> DataFrame:
    """Products sold as kits (phantom recipe)."""
    return balance.filter(F.col("segment") == "MACHINERY").select("product_id").distinct()


def sale_order(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderpriority").startswith("5"), "draft").otherwise("sale").alias("state"),
        F.when(status == "F", "full").when(status == "P", "partial").otherwise("pending").alias("delivery_status"),
        F.col("o_orderdate").alias("commitment_date"),
        F.col("o_totalprice").alias("amount_total"),
        F.col("o_custkey").alias("partner_id"),
        status.alias("order_status"),
    )


def sale_order_line(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with exact decimal amounts."""
    subtotal = Q.cents(F.col("l_extendedprice")) * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(4,2)"))
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").alias("product_uom_qty"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0).alias("qty_delivered"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        subtotal.cast("decimal(22,4)").alias("price_subtotal"),
        (subtotal.cast("decimal(22,4)") * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(26,6)").alias("tax"),
        F.col("l_shipdate").alias("ship_date"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_returnflag").alias("return_flag"),
    )


def production(spark: SparkSession, folder: str) -> DataFrame:
    """One production order per sale order: demand, produced, finish date."""
    return (table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.sum("l_quantity").alias("product_qty"),
                 F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("qty_produced"),
                 F.max("l_shipdate").alias("date_finished")))


def payment(spark: SparkSession, folder: str) -> DataFrame:
    """Payment entries: full orders paid once, partial ones 60 % and sometimes 10 % reversed."""
    orders = table(spark, folder, "orders")
    total = Q.cents(F.col("o_totalprice"))
    paid = orders.filter(F.col("o_orderstatus").isin("F", "P")).select(
        F.col("o_orderkey").alias("order_id"), F.lit(1).alias("entry_no"),
        F.when(F.col("o_orderstatus") == "F", total.cast("decimal(20,2)"))
        .otherwise(F.round(total * F.lit(0.6).cast("decimal(2,1)"), 2).cast("decimal(20,2)")).alias("amount"),
        F.lit(False).alias("is_refund"), F.lit(False).alias("is_exchange"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("date"))
    reversed_part = orders.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0)).select(
        F.col("o_orderkey").alias("order_id"), F.lit(2).alias("entry_no"),
        (-F.round(total * F.lit(0.1).cast("decimal(2,1)"), 2)).cast("decimal(20,2)").alias("amount"),
        F.lit(True).alias("is_refund"), F.lit(False).alias("is_exchange"),
        (F.col("o_orderdate") + F.expr("INTERVAL 45 DAYS")).alias("date"))
    return paid.unionByName(reversed_part)


def partner(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts in trees of ten; every third one has no street of its own."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("partner_id"), F.col("c_name").alias("partner_name"),
        (key - key % 10).alias("commercial_id"),
        F.when(key % 3 != 1, F.concat(key.cast("string"), F.lit(" Main St"))).alias("street"),
        F.col("c_nationkey").alias("nation_id"))


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """Sync jobs per entity."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("entity"),
        F.when(kind == "purchase", "done").when(kind == "error", "permanently_failed")
        .otherwise("pending").alias("status"),
        (F.col("event_id") % 4).alias("retries"), F.col("ts").alias("updated_at"))
