"""Verification queries over orders with seeded faults, and the matrix that rolls them up."""

from pyspark.sql import functions as F

from plantledger.operators import checks
from plantledger.operators.ordering import with_previous
from plantledger.plans.pallet_jobs import PALLET_CHECKS_SQL, PALLETS_SQL, check_sql, q_pallet_verify
from plantledger.plans.registry import job
from plantledger.sources import standins as S
from plantledger.sources.tables import table


def _per_order(spark, folder):
    """One row per order: quantity, lowest product, highest price."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.sum("l_quantity").alias("quantity"), (F.min("l_partkey") % 20).alias("product_id"), F.max("l_extendedprice").alias("price"))


PER_ORDER_SQL = """per_order AS (
  SELECT l_orderkey AS order_id, sum(l_quantity) AS quantity, min(l_partkey) % 20 AS product_id, max(l_extendedprice) AS price
  FROM lineitem GROUP BY l_orderkey)"""

FLOW_SQL = f"""{PER_ORDER_SQL},
flow AS (
  SELECT order_id, state, CASE WHEN q.order_id % 31 = 0 THEN 0 WHEN q.order_id % 29 = 0 THEN 2 ELSE 1 END AS n_mo,
    CASE WHEN q.order_id % 37 = 0 THEN 0 WHEN q.order_id % 41 = 0 THEN 2 ELSE 1 END AS n_pick,
    q.order_id % 31 <> 0 AND q.order_id % 43 <> 0 AS product_ok, q.order_id % 31 <> 0 AND q.order_id % 47 <> 0 AS qty_ok,
    q.order_id % 31 <> 0 AS bom_ok
  FROM per_order q JOIN sale_order s USING (order_id))"""
FLOW_CHECKS_SQL = check_sql("order flow", "CAST(order_id AS VARCHAR)", "flow", [
    ("confirmed", "state = 'sale'", "blocker"), ("one production", "n_mo = 1", "blocker"),
    ("product matches", "product_ok", "blocker"), ("quantity matches", "qty_ok", "major"),
    ("recipe matches", "bom_ok", "major"), ("one outgoing picking", "n_pick = 1", "blocker")])


@job(f"WITH {FLOW_SQL}\n{FLOW_CHECKS_SQL}", "sale_order")
def q_order_flow_verify(spark, folder):
    orders = _per_order(spark, folder).join(S.sale_order(spark, folder).select("order_id", "state"), "order_id").select(
        "order_id", "state", "product_id", "quantity", (F.col("product_id") + 500).alias("bom_id"))
    key = F.col("order_id")
    copies = F.when(key % 31 == 0, 0).when(key % 29 == 0, 2).otherwise(1)
    made = orders.select("order_id", F.when(key % 43 == 0, F.lit(-1)).otherwise(F.col("product_id")).alias("product_id"),
                         F.when(key % 47 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).alias("quantity"), "bom_id",
                         F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).drop("_copy")
    pickings = orders.select("order_id", F.explode(F.array_repeat(
        F.lit(1), F.when(key % 37 == 0, 0).when(key % 41 == 0, 2).otherwise(1))).alias("_copy"))
    return checks.order_flow(orders, made, pickings)


SYNC_SQL = """sync_sums AS (SELECT l_orderkey AS order_id, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey),
lost AS (
  SELECT order_id, count(*) AS n_missing FROM (
    SELECT DISTINCT l_orderkey AS order_id, l_partkey % 20 AS component_id FROM lineitem
    EXCEPT SELECT DISTINCT l_orderkey, l_partkey % 20 FROM lineitem WHERE NOT (l_linenumber = 6 AND l_orderkey % 13 = 0))
  GROUP BY order_id),
synced AS (
  SELECT s.order_id, s.order_id % 53 <> 0 AS there, s.order_id % 53 <> 0 AND s.order_id % 59 <> 0 AS qty_ok,
    s.order_id % 53 <> 0 AND s.order_id % 61 <> 0 AS uom_ok, coalesce(n_missing, 0) = 0 AS parts_ok,
    s.order_id % 53 <> 0 AND s.order_id % 67 <> 0 AS customer_ok, s.order_id % 53 <> 0 AS po_ok
  FROM sync_sums s JOIN orders ON o_orderkey = s.order_id JOIN customer ON c_custkey = o_custkey LEFT JOIN lost ON lost.order_id = s.order_id)"""
SYNC_CHECKS_SQL = check_sql("plant sync", "CAST(order_id AS VARCHAR)", "synced", [
    ("record present", "there", "blocker"), ("target quantity", "qty_ok", "major"), ("unit", "uom_ok", "minor"),
    ("components complete", "parts_ok", "blocker"), ("label customer", "customer_ok", "minor"),
    ("label order number", "po_ok", "minor")])


@job(f"WITH {SYNC_SQL}\n{SYNC_CHECKS_SQL}")
def q_sync_verify(spark, folder):
    line = table(spark, folder, "lineitem")
    key = F.col("order_id")
    sums = line.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum("l_quantity").alias("quantity"))
    names = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_id"), F.col("c_name").alias("customer"))
    erp = sums.join(names, "order_id").select("order_id", "quantity", F.lit("lb").alias("uom"), "customer")
    label = F.to_json(F.struct(F.when(key % 67 == 0, "?").otherwise(F.col("customer")).alias("customer"),
                               F.concat(F.lit("SO"), key.cast("string")).alias("customer_po")))
    plant = erp.filter(key % 53 != 0).select(
        "order_id", F.when(key % 59 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).alias("quantity"),
        F.when(key % 61 == 0, "kg").otherwise("lb").alias("uom"), label.alias("label_context"))
    parts = line.select(F.col("l_orderkey").alias("order_id"), (F.col("l_partkey") % 20).alias("component_id"), "l_linenumber")
    seen = parts.filter(~((F.col("l_linenumber") == 6) & (key % 13 == 0)))
    return checks.sync(erp, plant, parts, seen)


PICK_SQL = """pick_lines AS (
  SELECT picking_id, package_name, sum(quantity) AS qty, count(*) AS n, count(lot_name) AS n_lot FROM move_line
  WHERE package_name IS NOT NULL GROUP BY ALL),
pick_plan AS (
  SELECT picking_id, package_name, qty + CASE WHEN picking_id % 10 = 0 AND package_name LIKE '%-PAL-3' THEN 1 ELSE 0 END AS planned_qty
  FROM pick_lines WHERE NOT (picking_id % 13 = 0 AND package_name LIKE '%-PAL-5')
  UNION ALL SELECT picking_id, min(package_name) || '-X', 1 FROM pick_lines WHERE picking_id % 11 = 0 GROUP BY picking_id),
picked_sum AS (
  SELECT coalesce(a.picking_id, p.picking_id) AS picking_id, count(planned_qty) AS n_planned, count(qty) AS n_actual,
    count(*) FILTER (WHERE planned_qty IS NULL) AS n_extra, count(*) FILTER (WHERE qty IS NULL) AS n_missing,
    bool_and(coalesce(abs(qty - planned_qty) < 0.001, FALSE)) AS qty_ok, bool_and(coalesce(n = n_lot, FALSE)) AS lots_ok
  FROM pick_lines a FULL JOIN pick_plan p ON a.picking_id = p.picking_id AND a.package_name = p.package_name GROUP BY 1)"""
PICK_CHECKS_SQL = check_sql("pick sheet", "CAST(picking_id AS VARCHAR)", "picked_sum", [
    ("pallet count", "n_actual = n_planned", "major"), ("all pallets present", "n_missing = 0", "blocker"),
    ("pallet quantities", "qty_ok", "blocker"), ("lots on all lines", "lots_ok", "major"),
    ("pallet set matches", "n_missing = 0 AND n_extra = 0", "minor")])


@job(f"WITH {PICK_SQL}\n{PICK_CHECKS_SQL}", "move_line")
def q_pick_verify(spark, folder):
    lines = S.move_line(spark, folder)
    picking, name = F.col("picking_id"), F.col("package_name")
    sums = lines.filter(name.isNotNull()).groupBy("picking_id", "package_name").agg(F.sum("quantity").alias("qty"))
    plan = sums.filter(~((picking % 13 == 0) & name.endswith("-PAL-5"))).select(
        "picking_id", "package_name",
        F.when((picking % 10 == 0) & name.endswith("-PAL-3"), F.col("qty") + 1).otherwise(F.col("qty")).alias("planned_qty"))
    extra = sums.filter(picking % 11 == 0).groupBy("picking_id").agg(
        F.concat(F.min("package_name"), F.lit("-X")).alias("package_name")).withColumn("planned_qty", F.lit(1.0))
    return checks.pick(lines, plan.unionByName(extra))


SHIP_SQL = """ship AS (
  SELECT order_id, sum(quantity) AS ordered, coalesce(sum(quantity) FILTER (WHERE state = 'done'), 0) AS shipped, max(ship_date) AS done_at,
    min(lot_name) AS low_lot, max(lot_name) AS high_lot, count(lot_name) AS n_lot, count(*) AS n
  FROM move_line GROUP BY order_id),
shipped AS (SELECT s.order_id, order_status, ship.* EXCLUDE (order_id) FROM sale_order s LEFT JOIN ship ON ship.order_id = s.order_id)"""
SHIP_CHECKS_SQL = check_sql("shipping", "CAST(order_id AS VARCHAR)", "shipped", [
    ("done", "order_status = 'F'", "blocker"), ("date set", "done_at IS NOT NULL", "major"),
    ("no backorder", "ordered - shipped <= 0", "major"), ("one lot kept", "n = n_lot AND low_lot = high_lot", "minor"),
    ("shipped as ordered", "abs(shipped - ordered) < 0.001", "blocker"), ("stock moved out", "ordered - shipped = 0", "major")])


@job(f"WITH {SHIP_SQL}\n{SHIP_CHECKS_SQL}", "move_line", "sale_order")
def q_shipping_verify(spark, folder):
    lines = S.move_line(spark, folder).select(
        "order_id", F.col("quantity").alias("ordered"),
        F.when(F.col("state") == "done", F.col("quantity")).otherwise(0.0).alias("shipped"), "lot_name", "ship_date")
    return checks.shipping(S.sale_order(spark, folder), lines)


INVOICE_SQL = f"""{PER_ORDER_SQL},
invoiced AS (
  SELECT q.order_id, order_status <> 'O' AS made, order_status <> 'O' AND q.order_id % 71 <> 0 AS draft_ok,
    order_status <> 'O' AND (q.order_id % 73 <> 0 OR s.partner_id % 10 = 0) AS partner_ok,
    order_status <> 'O' AND q.order_id % 23 <> 0 AS origin_ok, order_status <> 'O' AND q.order_id % 79 <> 0 AS one_ok,
    order_status <> 'O' AND q.order_id % 17 <> 0 AS qty_ok, order_status <> 'O' AS uom_ok, order_status <> 'O' AND q.order_id % 19 <> 0 AS price_ok
  FROM per_order q JOIN sale_order s USING (order_id))"""
INVOICE_CHECKS_SQL = check_sql("invoice", "CAST(order_id AS VARCHAR)", "invoiced", [
    ("invoice created", "made", "blocker"), ("state is draft", "draft_ok", "minor"), ("partner", "partner_ok", "major"),
    ("origin", "origin_ok", "minor"), ("one product line", "one_ok", "major"), ("quantity", "qty_ok", "blocker"),
    ("unit", "uom_ok", "major"), ("price", "price_ok", "blocker")])


@job(f"WITH {INVOICE_SQL}\n{INVOICE_CHECKS_SQL}", "sale_order")
def q_invoice_verify(spark, folder):
    key = F.col("order_id")
    base = _per_order(spark, folder).join(
        S.sale_order(spark, folder).select("order_id", "partner_id", "order_status"), "order_id").withColumn("uom", F.lit("lb"))
    billed = base.filter(F.col("order_status") != "O")
    root = F.col("partner_id") - F.col("partner_id") % 10
    other = F.when(F.col("partner_id") % 10 == 0, root + 3).otherwise(root)
    heads = billed.select("order_id", F.when(key % 71 == 0, "posted").otherwise("draft").alias("state"),
                          F.when(key % 73 == 0, other).otherwise(F.col("partner_id")).alias("partner_id"),
                          F.when(key % 23 == 0, "SO?").otherwise(F.concat(F.lit("SO"), key.cast("string"))).alias("origin"))
    kinds = F.when(key % 79 == 0, F.array(F.lit("product"), F.lit("product"), F.lit("line_note"))).otherwise(
        F.array(F.lit("product"), F.lit("line_section")))
    lines = billed.select("order_id", F.explode(kinds).alias("display_type"), "uom",
                          F.when(key % 17 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).alias("quantity"),
                          F.when(key % 19 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"))
    return checks.invoice(base, heads, lines, S.partner(spark, folder))


STEP_SQL = """steps AS (
  SELECT event_id, value, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS packs,
    lag(value) OVER w AS value_before, lag(CAST(json_extract_string(props, '$.k') AS DOUBLE)) OVER w AS packs_before,
    lag(event_id) OVER w AS before_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
stepped AS (SELECT * FROM steps WHERE before_id IS NOT NULL)"""
STEP_CHECKS_SQL = check_sql("production step", "CAST(event_id AS VARCHAR)", "stepped", [
    ("quantity grew", "value > value_before", "blocker"), ("packaging grew", "packs - packs_before >= 0.99", "major"),
    ("transfer done", "event_type = 'purchase'", "major")])


@job(f"WITH {STEP_SQL}\n{STEP_CHECKS_SQL}")
def q_step_verify(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("packs"))
    paired = with_previous(events, ["user_id"], ["ts", "event_id"], ["value", "packs"]).filter(F.col("previous").isNotNull())
    return checks.step(paired.select(
        F.col("event_id").alias("step_id"), F.col("previous.value").alias("qty_before"), F.col("value").alias("qty_after"),
        F.col("previous.packs").alias("packs_before"), F.col("packs").alias("packs_after"),
        F.when(F.col("event_type") == "purchase", "done").otherwise("assigned").alias("transfer_state")))


@job(f"""WITH {FLOW_SQL}, {SYNC_SQL}, {PICK_SQL}, {SHIP_SQL}, {INVOICE_SQL.split("," + chr(10), 1)[1]}, {STEP_SQL}, {PALLETS_SQL},
checks AS ({FLOW_CHECKS_SQL} UNION ALL {SYNC_CHECKS_SQL} UNION ALL {PICK_CHECKS_SQL} UNION ALL {SHIP_CHECKS_SQL}
  UNION ALL {INVOICE_CHECKS_SQL} UNION ALL {STEP_CHECKS_SQL} UNION ALL {PALLET_CHECKS_SQL})
SELECT CASE WHEN grouping(stage) = 1 THEN '(all)' ELSE stage END AS stage,
  CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n_checks, count(*) FILTER (WHERE NOT ok) AS n_failed,
  ['', 'minor', 'major', 'blocker'][coalesce(max(CASE severity WHEN 'blocker' THEN 3 WHEN 'major' THEN 2 ELSE 1 END) FILTER (WHERE NOT ok), 0) + 1] AS severity
FROM checks GROUP BY GROUPING SETS ((stage), ())""", "sale_order", "move_line", "package")
def q_check_matrix(spark, folder):
    suites = (q_order_flow_verify, q_sync_verify, q_pick_verify, q_shipping_verify, q_invoice_verify, q_step_verify,
              q_pallet_verify)
    rows = None
    for suite in suites:
        part = suite(spark, folder).select("stage", "ok", "severity")
        rows = part if rows is None else rows.unionByName(part)
    return checks.matrix(rows)
