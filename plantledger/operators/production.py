"""Production: component demand, pack plans, blends, consumption checks, order summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantledger.functions import quantities as Q
from plantledger.session import dealt


def bom_demand(orders: DataFrame, bom: DataFrame, lines: DataFrame) -> DataFrame:
    """Scaled component demand per order, with the order's total of pound components.

    ``orders``: order_id, product_id, quantity. ``bom``: product_id, bom_qty. ``lines``: product_id and an
    array ``components`` of (component_id, qty, uom): a recipe is read with its product, one row each. Rows are counted
    first, so that each shuffle deals them to tasks of bounded size. Rows without an order have a total of 0.
    """
    rows = orders.count()
    demanded = int(rows * (lines.agg(F.avg(F.size("components"))).first()[0] or 0))
    pair, triple = ["order_id", "product_id"], ["order_id", "component_id", "uom"]
    per_product = dealt(orders, rows, *pair).groupBy(*pair).agg(F.sum("quantity").alias("quantity"))
    scaled = (per_product.join(bom, "product_id").join(lines, "product_id")
              .select("order_id", Q.scale(F.col("quantity"), F.col("bom_qty")).alias("_scale"), F.inline("components"))
              .withColumn("demand", F.col("qty") * F.col("_scale")))
    per_component = dealt(scaled, demanded, *triple).groupBy(*triple).agg(F.sum("demand").alias("demand"))
    # One row per component of an order, so an order is a short group however many lines it has.
    pounds = F.sum(F.when(F.lower("uom").isin(*Q.POUND_NAMES) & F.col("order_id").isNotNull(), F.col("demand")))
    return dealt(per_component, demanded, "order_id").withColumn("total_lb", F.coalesce(pounds.over(W.partitionBy("order_id")), F.lit(0.0)))


def pack_plan(orders: DataFrame, packaging: DataFrame, per_pallet: int) -> DataFrame:
    """Rolls and pallets per order and product. The first roll packaging by ``sequence`` counts; without
    one, one unit is one roll."""
    roll = packaging.filter(F.lower("packaging_name") == "roll").groupBy("product_id").agg(
        F.min(F.struct("sequence", "packaging_qty"))["packaging_qty"].cast("double").alias("per_roll"))
    planned = orders.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("quantity")) \
        .join(roll, "product_id", "left").withColumn("per_roll", F.coalesce("per_roll", F.lit(1.0)))
    rolls = Q.full_rolls(F.col("quantity"), F.col("per_roll"))
    return (planned.withColumn("rolls", rolls)
            .withColumn("pallets", Q.pallets_for(F.col("rolls"), F.lit(per_pallet)))
            .select("order_id", "product_id", "quantity", "per_roll", "rolls", "pallets"))


def blend_allocate(rolls: DataFrame, blend: DataFrame) -> DataFrame:
    """Material consumed = roll weight x layer share x hopper share, summed per work order and material.

    Weight is summed per (work order, product) before the recipe is looked up. ``blend`` has an array
    ``layers`` of (share, hoppers), each hopper being (material_id, share).
    """
    weight = rolls.groupBy("work_order", "product_id").agg(F.sum("weight").alias("weight"))
    layers = weight.join(blend, "product_id").select("work_order", "weight", F.explode("layers").alias("layer"))
    hoppers = layers.select("work_order", (F.col("weight") * F.col("layer.share")).alias("weight"),
                            F.explode("layer.hoppers").alias("hopper"))
    return (hoppers.groupBy("work_order", F.col("hopper.material_id").alias("material_id"))
            .agg(F.sum(F.col("weight") * F.col("hopper.share")).alias("consumed")))


def blend_materials(blend: DataFrame) -> DataFrame:
    """(product, material) pairs of a blend."""
    layers = blend.select("product_id", F.explode("layers").alias("layer"))
    return layers.select("product_id", F.explode("layer.hoppers").alias("h")).select(
        "product_id", F.col("h.material_id").alias("material_id")).distinct()


def blend_bom_drift(blend: DataFrame, bom_lines: DataFrame) -> DataFrame:
    """Materials in the blend and not in the recipe, and the reverse; ``bom_lines``: product_id, material_id."""
    a = blend_materials(blend).withColumn("_a", F.lit(True))
    b = bom_lines.select("product_id", "material_id").distinct().withColumn("_b", F.lit(True))
    return (a.join(b, ["product_id", "material_id"], "full_outer")
            .filter(F.col("_a").isNull() | F.col("_b").isNull())
            .select("product_id", "material_id", F.when(F.col("_b").isNull(), "blend only").otherwise("bom only")
                    .alias("status")))


def consumption_check(actual: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Expected against actual per material; the quantity verdict comes before the lot verdict.

    ``actual``: material_id, lot, quantity. ``expected``: material_id, expected_qty, expected_lot.
    """
    per_lot = actual.groupBy("material_id", "lot").agg(F.sum("quantity").alias("quantity"))
    wanted = expected.select("material_id", "expected_lot")
    per_material = per_lot.join(wanted, "material_id").groupBy("material_id").agg(
        F.sum("quantity").alias("actual_qty"),
        F.coalesce(F.bool_or(F.col("lot") == F.col("expected_lot")), F.lit(False)).alias("lot_ok"))
    joined = expected.join(per_material, "material_id", "left")
    qty_ok = F.abs(F.col("actual_qty") - F.col("expected_qty")) <= tolerance
    return joined.select(
        "material_id", "expected_qty", F.coalesce("actual_qty", F.lit(0.0)).alias("actual_qty"),
        F.coalesce("lot_ok", F.lit(False)).alias("lot_ok"),
        F.when(F.col("actual_qty").isNull(), "MISSING").when(~qty_ok, "QTY MISMATCH")
        .when(~F.col("lot_ok"), "LOT MISMATCH").otherwise("PASS").alias("status"))


def delta_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of ``after`` whose id an earlier snapshot did not have."""
    return after.join(before.select(key), key, "left_anti")


def production_summary(lines: DataFrame, lotless: DataFrame) -> DataFrame:
    """Per order: demand, consumed, lines with a lot, whether every tracked material has one, and
    finished goods on hand. ``lotless`` lists the products that need no lot."""
    exempt = lotless.select("product_id").distinct().withColumn("_exempt", F.lit(True))
    has_lot, done = F.col("lot_name").isNotNull(), F.col("state") == "done"
    per_product = lines.groupBy("order_id", "product_id").agg(
        F.sum("quantity").alias("demand"),
        F.coalesce(F.sum(F.when(done, F.col("quantity"))), F.lit(0.0)).alias("consumed"),
        F.count(F.lit(1)).alias("n_lines"), F.count_if(has_lot).alias("lines_with_lot"),
        F.coalesce(F.sum(F.when(done & has_lot, F.col("quantity"))), F.lit(0.0)).alias("on_hand"))
    tracked = F.col("_exempt").isNotNull() | (F.col("n_lines") == F.col("lines_with_lot"))
    return (per_product.join(exempt, "product_id", "left").groupBy("order_id").agg(
        F.sum("demand").alias("demand"), F.sum("consumed").alias("consumed"), F.sum("n_lines").alias("n_lines"),
        F.sum("lines_with_lot").alias("lines_with_lot"), F.bool_and(tracked).alias("all_tracked"),
        F.sum("on_hand").alias("on_hand")))
