"""Dashboard, backorder and tracing queries."""

from pyspark.sql import functions as F

from plantledger.operators import dashboard, trace
from plantledger.plans.registry import job
from plantledger.sources import standins as S
from plantledger.sources.tables import table

OPEN = "state = 'sale' AND delivery_status <> 'full'"


@job(f"""SELECT order_id, coalesce(partner_name, '') AS partner_name, delivery_status,
  strftime(commitment_date, '%Y-%m-%d') AS due, amount_total
FROM (SELECT * FROM sale_order WHERE {OPEN} ORDER BY commitment_date, order_id LIMIT 50) LEFT JOIN partner USING (partner_id)""",
     "sale_order", "partner")
def q_open_orders(spark, folder):
    return dashboard.open_orders(S.sale_order(spark, folder), S.partner(spark, folder), 50)


@job(f"""SELECT order_id, line_no, product_id, product_uom_qty, qty_delivered, product_uom_qty - qty_delivered AS open_qty
FROM sale_order_line WHERE order_id IN (SELECT order_id FROM sale_order WHERE {OPEN})
ORDER BY order_id, line_no, product_id, supplier_id, ship_date, price LIMIT 150""", "sale_order", "sale_order_line")
def q_open_lines(spark, folder):
    return dashboard.open_lines(S.sale_order_line(spark, folder), S.sale_order(spark, folder), 150)


@job(f"""SELECT order_id, product_qty, coalesce(CAST(qty_produced AS VARCHAR), '') AS produced, coalesce(d, 0) AS delivered,
  coalesce(CAST(qty_produced - coalesce(d, 0) AS VARCHAR), '') AS balance, strftime(date_finished, '%Y-%m-%d') AS finished
FROM production LEFT JOIN (SELECT order_id, sum(qty_delivered) AS d FROM sale_order_line WHERE return_flag <> 'R' GROUP BY order_id) USING (order_id)
WHERE order_id IN (SELECT order_id FROM sale_order WHERE {OPEN}) ORDER BY order_id, date_finished DESC LIMIT 100""",
     "sale_order", "sale_order_line", "production")
def q_made_not_shipped(spark, folder):
    delivered = S.sale_order_line(spark, folder).filter(F.col("return_flag") != "R").groupBy("order_id").agg(
        F.sum("qty_delivered").alias("delivered"))
    return dashboard.made_not_shipped(S.production(spark, folder), delivered, S.sale_order(spark, folder), 100)


@job(f"""SELECT 'open orders' AS filter_name, CAST(order_id AS VARCHAR) AS group_key, count(*) AS n_rows, sum(amount_total) AS amount
FROM sale_order WHERE {OPEN} GROUP BY order_id
UNION ALL SELECT 'open lines', CAST(l.order_id AS VARCHAR), count(*), sum(product_uom_qty) FROM sale_order_line l
  JOIN sale_order s USING (order_id) WHERE s.state = 'sale' GROUP BY l.order_id
UNION ALL SELECT 'productions by product', CAST(product_id % 20 AS VARCHAR), count(*), sum(product_uom_qty)
FROM sale_order_line WHERE line_status = 'F' GROUP BY product_id % 20""", "sale_order", "sale_order_line")
def q_saved_filter_groups(spark, folder):
    predicates = {"open orders": dashboard.is_open(), "open lines": F.col("state") == "sale",
                  "productions by product": F.col("line_status") == "F"}
    orders = S.sale_order(spark, folder)
    lines = S.sale_order_line(spark, folder)
    with_state = lines.join(orders.select("order_id", "state"), "order_id")
    folded = lines.withColumn("product_id", F.col("product_id") % 20)
    return (dashboard.saved_filter(orders, "open orders", predicates, "order_id", "amount_total")
            .unionByName(dashboard.saved_filter(with_state, "open lines", predicates, "order_id", "product_uom_qty"))
            .unionByName(dashboard.saved_filter(folded, "productions by product", predicates, "product_id", "product_uom_qty")))


@job("""SELECT order_id, sum(product_uom_qty) AS ordered, sum(qty_delivered) AS shipped,
  sum(product_uom_qty) - sum(qty_delivered) AS remaining,
  coalesce(max(order_id * 10 + line_no) FILTER (WHERE line_status = 'O'), -1) AS next_delivery
FROM sale_order_line GROUP BY order_id HAVING sum(product_uom_qty) - sum(qty_delivered) > 0""", "sale_order_line")
def q_backorder(spark, folder):
    lines = S.sale_order_line(spark, folder)
    deliveries = lines.select("order_id", (F.col("order_id") * 10 + F.col("line_no")).alias("picking_id"),
                              F.when(F.col("line_status") == "F", "done").otherwise("assigned").alias("state"))
    sums = lines.select("order_id", F.col("product_uom_qty").alias("ordered"), F.col("qty_delivered").alias("shipped"))
    return dashboard.backorders(sums, deliveries)


@job("""WITH t AS (SELECT order_no, coalesce(sum(quantity) FILTER (WHERE contains(lower(uom), 'lb')), 0) AS total_lb FROM move_line GROUP BY order_no)
SELECT order_no, product_id, lot_name, sum(quantity) AS quantity, any_value(total_lb) AS total_lb
FROM move_line JOIN t USING (order_no) WHERE lot_name IS NOT NULL GROUP BY order_no, product_id, lot_name""", "move_line")
def q_material_lots(spark, folder):
    return trace.material_lots(S.move_line(spark, folder))


CONSUMED_SQL = """consumed AS (
  SELECT order_no, product_id, quantity, CASE WHEN product_id = 4 THEN 'FIX_DATA_' || product_id || '_AUTO'
    WHEN product_id = 6 THEN NULL ELSE lot_name END AS lot_name FROM move_line)"""


@job(f"""WITH {CONSUMED_SQL}
SELECT order_no, product_id, sum(quantity) AS total, count(DISTINCT coalesce(lot_name, '(no lot)')) AS n_lots,
  bool_or(lot_name IS NOT NULL AND NOT starts_with(lot_name, 'FIX_DATA_')) AS traced, CAST(1 AS BIGINT) AS page,
  string_agg(DISTINCT coalesce(lot_name, '(no lot)'), ', ' ORDER BY coalesce(lot_name, '(no lot)')) AS lots
FROM consumed GROUP BY order_no, product_id""", "move_line")
def q_trace_backward(spark, folder):
    product = F.col("product_id")
    consumed = S.move_line(spark, folder).select(
        "order_no", "product_id", "quantity",
        F.when(product == 4, F.concat(F.lit("FIX_DATA_"), product.cast("string"), F.lit("_AUTO")))
        .when(product != 6, F.col("lot_name")).alias("lot_name"))
    return trace.backward(consumed)


@job("""SELECT 'RAW-' || (l_suppkey % 50) AS raw_lot, o_custkey - o_custkey % 10 AS commercial_id,
  count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT o_orderkey) AS n_finished_lots, sum(l_quantity) AS quantity
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' GROUP BY ALL""")
def q_trace_forward(spark, folder):
    consumption = table(spark, folder, "lineitem").select(
        F.concat(F.lit("RAW-"), (F.col("l_suppkey") % 50).cast("string")).alias("raw_lot"),
        F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"))
    orders = table(spark, folder, "orders")
    lot = F.concat(F.lit("FG-"), F.col("o_orderkey").cast("string")).alias("finished_lot")
    productions = orders.select(F.col("o_orderkey").alias("order_id"), lot)
    deliveries = orders.select(lot, F.col("o_custkey").alias("partner_id"),
                               F.when(F.col("o_orderstatus") == "F", "done").otherwise("assigned").alias("state"))
    return trace.forward(consumption, productions, deliveries, S.partner(spark, folder))
