"""Inventory queries."""

from pyspark.sql import functions as F

from plantledger.operators import inventory
from plantledger.plans.registry import job
from plantledger.session import fresh_path
from plantledger.sources import standins as S
from plantledger.sources import versions
from plantledger.sources.tables import table

NEGATIVE_SQL = """negative AS (
  SELECT product_id, location_id, quantity, CASE WHEN is_kit THEN 'kit' ELSE 'product' END AS kind
  FROM stock_balance WHERE internal AND quantity < 0)"""


@job(f"WITH {NEGATIVE_SQL} SELECT * FROM negative", "stock_balance")
def q_negative_stock(spark, folder):
    balance = S.stock_balance(spark, folder)
    return inventory.negative_stock(balance, S.locations(spark, folder), S.kits(balance))


@job(f"""WITH {NEGATIVE_SQL}
SELECT 'adjust' AS step, product_id, location_id, -quantity AS quantity FROM negative WHERE kind = 'product'
UNION ALL SELECT 'remaining', product_id, location_id, quantity FROM negative WHERE kind = 'kit'""", "stock_balance")
def q_zero_adjustments(spark, folder):
    return inventory.zero_adjustments(q_negative_stock(spark, folder))


@job("""SELECT product_id, 'normal' AS bom_type, bom_type AS old_type, bom_type = 'phantom' AS marked
FROM product""", "product")
def q_kit_flip(spark, folder):
    boms, path = S.product(spark, folder).select("product_id", "bom_type"), fresh_path(spark, "markers")
    flipped = inventory.kit_flip(boms, path, "flip")
    marked = versions.open_entries(spark, path, inventory.MARKED, ["product_id"]).select("product_id", F.lit(True).alias("marked"))
    return flipped.join(marked, "product_id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))


@job("""SELECT 'restore' AS step, CASE WHEN product_id % 7 = 0 THEN 'missing' WHEN product_id % 5 = 0 THEN 'already' ELSE 'flipped' END AS outcome,
  count(*) AS n FROM product WHERE bom_type = 'phantom' GROUP BY 2
UNION ALL SELECT 'open markers', 'before', count(*) FILTER (WHERE bom_type = 'phantom') FROM product
UNION ALL SELECT unnest(['open markers', 'second restore']), unnest(['after', 'any']), 0""", "product")
def q_kit_restore(spark, folder):
    """The restore closes the markers it has read back, so a second one finds nothing."""
    boms, path = S.product(spark, folder).select("product_id", "bom_type"), fresh_path(spark, "markers")
    flipped = inventory.kit_flip(boms, path, "flip")
    by_hand = F.when((F.col("product_id") % 5 == 0) & (F.col("old_type") == "phantom"), "phantom")
    current = flipped.filter(F.col("product_id") % 7 != 0).select(
        "product_id", F.coalesce(by_hand, F.col("bom_type")).alias("bom_type"))

    def open_markers(when):
        n = versions.open_entries(spark, path, inventory.MARKED, ["product_id"]).count()
        return "open markers", when, n
    before = open_markers("before")
    first = inventory.kit_restore(current, path, "restore-1").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    second = inventory.kit_restore(current, path, "restore-2").count()
    told = spark.createDataFrame([before, open_markers("after"), ("second restore", "any", second)], "step string, outcome string, n bigint")
    return first.select(F.lit("restore").alias("step"), "outcome", "n").unionByName(told)


@job("""WITH b AS (SELECT l_partkey AS product_id, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
a AS (SELECT l_partkey AS product_id, sum(CASE WHEN l_orderkey % 503 = 0 THEN l_quantity + 1 ELSE l_quantity END) AS q
  FROM lineitem WHERE l_orderkey % 701 <> 0 GROUP BY 1)
SELECT coalesce(b.product_id, a.product_id) AS product_id, coalesce(b.q, 0) AS before, coalesce(a.q, 0) AS after,
  coalesce(a.q, 0) - coalesce(b.q, 0) AS change
FROM b FULL JOIN a ON a.product_id = b.product_id WHERE coalesce(a.q, 0) <> coalesce(b.q, 0)""")
def q_onhand_invariant(spark, folder):
    line = table(spark, folder, "lineitem")
    quantity = F.col("l_quantity")
    before = line.select(F.col("l_partkey").alias("product_id"), quantity.alias("quantity"))
    after = line.filter(F.col("l_orderkey") % 701 != 0).select(
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_orderkey") % 503 == 0, quantity + 1).otherwise(quantity).alias("quantity"))
    return inventory.onhand_changes(before, after)


@job("""WITH t AS (
  SELECT product_id, lot, in_date, quantity - reserved AS free FROM quant
  WHERE location = 'Stock' AND lot IS NOT NULL AND quantity > 0 AND quantity - reserved > 1)
SELECT product_id, strftime(min(in_date), '%Y-%m-%d') AS in_date, arg_min(lot, (in_date, lot)) AS lot,
  arg_min(free, (in_date, lot, free)) AS free FROM t GROUP BY product_id""", "quant")
def q_fifo_lot(spark, folder):
    found = inventory.fifo_lot(S.quant(spark, folder))
    return found.withColumn("in_date", F.date_format("in_date", "yyyy-MM-dd"))


@job("""SELECT product_id, count(*) AS n_quants, sum(quantity) AS quantity, 'LOT-' || product_id AS new_lot
FROM quant WHERE location = 'Stock' AND lot IS NULL AND quantity > 0 GROUP BY product_id""", "quant")
def q_untracked_stock(spark, folder):
    return inventory.untracked_stock(S.quant(spark, folder))


@job("""WITH t AS (SELECT DISTINCT product_id, lot_key AS lot, 40 + (product_id * 7 + lot_key * 13) % 150 AS target FROM quant),
have AS (SELECT product_id, lot, sum(quantity) AS q FROM quant WHERE location = 'Stock' GROUP BY ALL)
SELECT t.product_id, t.lot, coalesce(q, 0) AS current, target::DOUBLE AS target, target - coalesce(q, 0) AS shortfall
FROM t LEFT JOIN have ON have.product_id = t.product_id AND have.lot = t.lot WHERE coalesce(q, 0) < target""", "quant")
def q_stock_topup(spark, folder):
    quants = S.quant(spark, folder)
    targets = quants.select("product_id", F.col("lot_key").alias("lot")).distinct().withColumn(
        "target", (40 + (F.col("product_id") * 7 + F.col("lot") * 13) % 150).cast("double"))
    return inventory.stock_topup(quants, targets)


@job("""SELECT product_id, sum(quantity) AS on_hand, sum(reserved) AS reserved, bool_and(quantity = reserved) AS covered
FROM quant WHERE location = 'Stock' GROUP BY product_id""", "quant")
def q_reservation_cover(spark, folder):
    return inventory.reservation_cover(S.quant(spark, folder))


@job("""WITH p AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 <> 0 THEN 'C' || p_partkey END AS code,
    CASE WHEN p_partkey % 4 <> 0 THEN 'B' || p_partkey END AS barcode, p_name AS name FROM part),
t AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'C' || p_partkey
    WHEN 2 THEN 'B' || p_partkey WHEN 3 THEN p_name ELSE '?' || p_partkey END AS query_text FROM part)
SELECT query_text, coalesce(i.product_id, c.pid, b.pid, n.pid, -1) AS product_id,
  CASE WHEN i.product_id IS NOT NULL THEN 'id' WHEN c.pid IS NOT NULL THEN 'code' WHEN b.pid IS NOT NULL THEN 'barcode'
    WHEN n.pid IS NOT NULL THEN 'name' ELSE 'none' END AS matched_by
FROM t LEFT JOIN p i ON CAST(i.product_id AS VARCHAR) = query_text
  LEFT JOIN (SELECT code, min(product_id) AS pid FROM p GROUP BY code) c ON c.code = query_text
  LEFT JOIN (SELECT barcode, min(product_id) AS pid FROM p GROUP BY barcode) b ON b.barcode = query_text
  LEFT JOIN (SELECT name, min(product_id) AS pid FROM p GROUP BY name) n ON n.name = query_text""")
def q_product_lookup(spark, folder):
    part = table(spark, folder, "part")
    key = F.col("p_partkey")
    text = key.cast("string")
    products = part.select(key.alias("product_id"), F.when(key % 3 != 0, F.concat(F.lit("C"), text)).alias("code"),
                           F.when(key % 4 != 0, F.concat(F.lit("B"), text)).alias("barcode"), F.col("p_name").alias("name"))
    asked = part.select(F.when(key % 5 == 0, text).when(key % 5 == 1, F.concat(F.lit("C"), text))
                        .when(key % 5 == 2, F.concat(F.lit("B"), text)).when(key % 5 == 3, F.col("p_name"))
                        .otherwise(F.concat(F.lit("?"), text)).alias("query_text"))
    return inventory.lookup(asked, products)


@job("""SELECT p_partkey AS product_id, p_name AS name, lower(p_name) = 'red widget' AS exact FROM part
WHERE p_name ILIKE '%red widget%' ORDER BY exact DESC, product_id LIMIT 30""")
def q_product_search(spark, folder):
    products = table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    return inventory.search(products, "RED Widget", 30)


@job("""SELECT p_partkey AS product_id, p_name AS name, contains(p_name, 'widget') AS holds, p_name LIKE 'red %_t' AS fits,
  regexp_replace(p_name, '^red ', '') AS short_name FROM part WHERE contains(p_name, 'widget') OR p_name LIKE 'red %_t'""")
def q_product_like(spark, folder):
    products = table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    return inventory.search_as_written(products, "widget", "red %_t", "red ")


@job("""WITH free AS (SELECT lot_name AS lot, sum(quantity) AS free FROM move_line WHERE package_name IS NULL AND quantity > 0 AND lot_name IS NOT NULL
  GROUP BY lot_name HAVING sum(quantity) >= 4)
SELECT production_id, lot, free FROM (SELECT max(order_id) AS production_id, lot_name AS lot FROM move_line GROUP BY lot_name) JOIN free USING (lot)
ORDER BY production_id DESC, lot LIMIT 1""", "move_line")
def q_newest_free(spark, folder):
    """Newest order whose lot has enough free stock, all orders searched."""
    lines = S.move_line(spark, folder)
    made = lines.groupBy(F.col("lot_name").alias("lot")).agg(F.max("order_id").alias("production_id"))
    return inventory.newest_with_free_stock(made, lines.select(F.col("lot_name").alias("lot"), "quantity", "package_name"), 4.0)
