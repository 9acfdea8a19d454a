"""Production queries, with recipes and blends derived from the part table."""

from pyspark.sql import functions as F

from plantledger.operators import production
from plantledger.plans.registry import job
from plantledger.sources import standins as S
from plantledger.sources.tables import table

BOM_SQL = """bom AS (
  SELECT p_partkey AS product_id, CASE WHEN p_size % 10 = 0 THEN 1 ELSE [1, 2, 4, 8][p_size % 4 + 1] END AS bom_qty,
    unnest([1, 2, 3]) AS k, p_size FROM part),
bom_line AS (
  SELECT product_id, bom_qty, (product_id * k + k) % 97 AS component_id, p_size * k / 4.0::DOUBLE AS qty,
    ['lb', 'Units', 'Lbs'][k] AS uom FROM bom)"""


def recipes(spark, folder):
    """One recipe of three components per part; sizes divisible by ten have no recipe quantity."""
    key, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, folder, "part")
    bom = part.select(key.alias("product_id"), F.when(size % 10 != 0, F.pow(F.lit(2.0), size % 4)).alias("bom_qty"))
    components = F.array(*[F.struct(((key * k + k) % 97).alias("component_id"), (size * k / 4).alias("qty"),
                                    F.lit(uom).alias("uom")) for k, uom in ((1, "lb"), (2, "Units"), (3, "Lbs"))])
    return bom, part.select(key.alias("product_id"), components.alias("components"))


def blends(spark, folder):
    """Three layers of two hoppers per part."""
    key = F.col("p_partkey")

    def layer(n, share):
        return F.struct(F.lit(share).alias("share"), F.array(*[
            F.struct(((key + n * 7 + h * 3) % 50).alias("material_id"), F.lit(part).alias("share"))
            for h, part in ((1, 0.75), (2, 0.25))]).alias("hoppers"))
    layers = F.array(layer(1, 0.5), layer(2, 0.25), layer(3, 0.25))
    return table(spark, folder, "part").select(key.alias("product_id"), layers.alias("layers"))


def _ordered(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"))


@job(f"""WITH {BOM_SQL},
d AS (
  SELECT l_orderkey AS order_id, component_id, uom, sum(qty * (q / bom_qty)) AS demand
  FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) JOIN bom_line ON product_id = l_partkey
  GROUP BY ALL)
SELECT *, coalesce(sum(demand) FILTER (WHERE lower(uom) IN ('lb', 'lbs', 'pound', 'pounds')) OVER (PARTITION BY order_id), 0) AS total_lb
FROM d""")
def q_bom_demand(spark, folder):
    return production.bom_demand(_ordered(spark, folder), *recipes(spark, folder))


@job("""SELECT order_id, product_id, quantity, per_roll, CAST(floor(quantity / per_roll) AS BIGINT) AS rolls,
  CAST(ceil(floor(quantity / per_roll) / 25.0::DOUBLE) AS BIGINT) AS pallets
FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id, sum(l_quantity) AS quantity,
    coalesce(any_value(CASE WHEN packaging_name = 'Roll' THEN packaging_qty END), 1)::DOUBLE AS per_roll
  FROM lineitem LEFT JOIN product ON product_id = l_partkey GROUP BY ALL)""", "product")
def q_pack_plan(spark, folder):
    packaging = S.product(spark, folder).withColumn("sequence", F.lit(1))
    return production.pack_plan(_ordered(spark, folder), packaging, 25)


@job("""WITH hopper AS (
  SELECT p_partkey AS product_id, n, h, (p_partkey + n * 7 + h * 3) % 50 AS material_id,
    [0.5, 0.25, 0.25][n]::DOUBLE * [0.75, 0.25][h]::DOUBLE AS share
  FROM part, (SELECT unnest([1, 2, 3]) AS n), (SELECT unnest([1, 2]) AS h))
SELECT l_suppkey % 10 AS work_order, material_id, sum(l_quantity * share) AS consumed
FROM lineitem JOIN hopper ON product_id = l_partkey GROUP BY ALL""")
def q_blend_allocate(spark, folder):
    rolls = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("work_order"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("weight"))
    return production.blend_allocate(rolls, blends(spark, folder))


@job(f"""WITH {BOM_SQL},
a AS (SELECT DISTINCT p_partkey AS product_id, (p_partkey + n * 7 + h * 3) % 50 AS material_id
  FROM part, (SELECT unnest([1, 2, 3]) AS n), (SELECT unnest([1, 2]) AS h)),
b AS (SELECT DISTINCT product_id, component_id % 50 AS material_id FROM bom_line)
SELECT product_id, material_id, 'blend only' AS status FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT product_id, material_id, 'bom only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def q_blend_bom_drift(spark, folder):
    _, lines = recipes(spark, folder)
    materials = lines.select("product_id", F.inline("components")).select(
        "product_id", (F.col("component_id") % 50).alias("material_id"))
    return production.blend_bom_drift(blends(spark, folder), materials)


@job("""WITH a AS (SELECT l_partkey % 200 AS material_id, l_suppkey % 20 AS lot, l_quantity AS q FROM lineitem WHERE l_returnflag <> 'R'),
s AS (SELECT material_id, sum(q) AS actual_qty FROM a GROUP BY material_id),
e AS (
  SELECT material_id, CASE WHEN material_id % 11 = 0 THEN actual_qty + 1 ELSE actual_qty END AS expected_qty,
    CASE WHEN material_id % 13 = 0 THEN 77 ELSE material_id % 20 END AS expected_lot FROM s
  UNION ALL SELECT material_id + 1000000, actual_qty, 1 FROM s WHERE material_id % 50 = 0),
l AS (SELECT e.material_id, bool_or(a.lot = e.expected_lot) AS lot_ok FROM e JOIN a ON a.material_id = e.material_id GROUP BY ALL)
SELECT e.material_id, expected_qty, coalesce(actual_qty, 0) AS actual_qty, coalesce(lot_ok, FALSE) AS lot_ok,
  CASE WHEN actual_qty IS NULL THEN 'MISSING' WHEN abs(actual_qty - expected_qty) > 0.01 THEN 'QTY MISMATCH'
    WHEN NOT lot_ok THEN 'LOT MISMATCH' ELSE 'PASS' END AS status
FROM e LEFT JOIN s ON s.material_id = e.material_id LEFT JOIN l ON l.material_id = e.material_id""")
def q_consumption_check(spark, folder):
    actual = table(spark, folder, "lineitem").filter(F.col("l_returnflag") != "R").select(
        (F.col("l_partkey") % 200).alias("material_id"), (F.col("l_suppkey") % 20).alias("lot"), F.col("l_quantity").alias("quantity"))
    sums = actual.groupBy("material_id").agg(F.sum("quantity").alias("total"))
    material, total = F.col("material_id"), F.col("total")
    expected = sums.select(material, F.when(material % 11 == 0, total + 1).otherwise(total).alias("expected_qty"),
                           F.when(material % 13 == 0, 77).otherwise(material % 20).alias("expected_lot"))
    absent = sums.filter(material % 50 == 0).select((material + 1000000).alias("material_id"), total.alias("expected_qty"),
                                                    F.lit(1).cast("bigint").alias("expected_lot"))
    return production.consumption_check(actual, expected.unionByName(absent))


@job("""SELECT o_orderkey AS order_id, o_custkey AS partner_id, o_totalprice AS amount_total FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-01-01'""")
def q_delta_rows(spark, folder):
    orders = table(spark, folder, "orders")
    before = orders.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    new = production.delta_rows(before, orders, "o_orderkey")
    return new.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("partner_id"),
                      F.col("o_totalprice").alias("amount_total"))


@job("""WITH p AS (
  SELECT order_id, m.product_id, sum(quantity) AS demand, coalesce(sum(quantity) FILTER (WHERE state = 'done'), 0) AS consumed,
    count(*) AS n_lines, count(lot_name) AS lines_with_lot,
    coalesce(sum(quantity) FILTER (WHERE state = 'done' AND lot_name IS NOT NULL), 0) AS on_hand,
    any_value(bom_type) = 'phantom' AS exempt
  FROM move_line m JOIN product USING (product_id) GROUP BY ALL)
SELECT order_id, sum(demand) AS demand, sum(consumed) AS consumed, CAST(sum(n_lines) AS BIGINT) AS n_lines,
  CAST(sum(lines_with_lot) AS BIGINT) AS lines_with_lot, bool_and(exempt OR n_lines = lines_with_lot) AS all_tracked,
  sum(on_hand) AS on_hand FROM p GROUP BY order_id""", "move_line", "product")
def q_production_summary(spark, folder):
    lotless = S.product(spark, folder).filter(F.col("bom_type") == "phantom")
    return production.production_summary(S.move_line(spark, folder), lotless)
