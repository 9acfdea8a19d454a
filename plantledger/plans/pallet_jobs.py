"""Pallet queries."""

from pyspark.sql import functions as F

from plantledger.operators import pallets
from plantledger.plans.registry import job
from plantledger.plans.views import LINE_ORDER
from plantledger.sources import standins as S
from plantledger.sources.tables import table

UNIT_ORDER = ["order_id", "unit_no", "part_id", "supplier_id", "ship_date", "price"]


@job(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY order_no ORDER BY {LINE_ORDER}) AS unit_index FROM move_line)
SELECT order_no, order_id, unit_no, part_id, unit_index, CAST(ceil(unit_index / 25.0::DOUBLE) AS BIGINT) AS pallet_no,
  order_no || '-PAL-' || CAST(ceil(unit_index / 25.0::DOUBLE) AS BIGINT) AS pallet_id FROM n""", "move_line")
def q_pallet_build(spark, folder):
    units = S.move_line(spark, folder).select("order_no", *UNIT_ORDER)
    return pallets.build(units, "order_no", UNIT_ORDER, 25).drop("supplier_id", "ship_date", "price")


@job(f"""SELECT order_no, order_id, unit_no, part_id,
  row_number() OVER w AS unit_index, ntile(7) OVER w AS parent_no FROM move_line
WINDOW w AS (PARTITION BY order_no ORDER BY {LINE_ORDER})""", "move_line")
def q_unit_spread(spark, folder):
    units = S.move_line(spark, folder).select("order_no", *UNIT_ORDER)
    return pallets.spread(units, "order_no", UNIT_ORDER, 7).drop("supplier_id", "ship_date", "price")


@job("""WITH d AS (SELECT DISTINCT picking_id, order_no, order_id % 100 AS n FROM move_line),
r AS (SELECT *, n - row_number() OVER (PARTITION BY picking_id, order_no ORDER BY n) AS run FROM d),
runs AS (SELECT picking_id, order_no, min(n) AS low, max(n) AS high, count(*) AS c FROM r GROUP BY picking_id, order_no, run)
SELECT picking_id, order_no, CAST(1 AS BIGINT) AS page,
  string_agg(CASE WHEN low = high THEN CAST(low AS VARCHAR) ELSE low || '-' || high END, ', ' ORDER BY low) AS units,
  CAST(sum(c) AS BIGINT) AS n_units, count(*) AS n_runs
FROM runs GROUP BY picking_id, order_no""", "move_line")
def q_unit_ranges(spark, folder):
    units = S.move_line(spark, folder).select(
        "picking_id", "order_no", (F.col("order_id") % 100).alias("n"))
    return pallets.unit_ranges(units, ["picking_id", "order_no"], "n")


CHECK = "SELECT '{0}' AS stage, {1} AS document, '{2}' AS label, coalesce({3}, FALSE) AS ok, '{4}' AS severity FROM {5}"


def check_sql(stage, document, source, checks):
    return "\nUNION ALL ".join(CHECK.format(stage, document, label, ok, severity, source) for label, ok, severity in checks)


PALLETS_SQL = """e AS (
  SELECT picking_id, package_name, min(order_no) AS order_0, min(product_id) AS product_0, min(lot_name) AS lot_0,
    sum(quantity) AS all_qty FROM move_line WHERE package_name IS NOT NULL GROUP BY picking_id, package_name),
w AS (
  SELECT picking_id, package_name, CASE WHEN picking_id % 37 = 0 THEN 'WH/MO/none' ELSE order_0 END AS order_no,
    CASE WHEN picking_id % 41 = 0 AND package_name LIKE '%-PAL-1' THEN -1 ELSE product_0 END AS product_id,
    CASE WHEN picking_id % 43 = 0 AND package_name LIKE '%-PAL-2' THEN 'no such lot' ELSE lot_0 END AS lot_name,
    CASE WHEN picking_id % 31 = 0 AND package_name LIKE '%-PAL-5' THEN 1 ELSE 0 END AS more FROM e),
f AS (
  SELECT w.picking_id, w.package_name, coalesce(sum(m.quantity) FILTER (WHERE m.product_id = w.product_id), 0) AS fg_qty,
    bool_or(m.product_id = w.product_id) AS has_product, bool_or(m.product_id = w.product_id AND m.lot_name = w.lot_name) AS has_lot,
    bool_or(m.order_no = w.order_no) AS has_order
  FROM w JOIN move_line m USING (picking_id, package_name) GROUP BY ALL),
q AS (
  SELECT picking_id, package_name, sum(m.quantity) AS q FROM e JOIN move_line m USING (picking_id, package_name)
  WHERE m.product_id = e.product_0 GROUP BY ALL),
j AS (
  SELECT w.*, f.* EXCLUDE (picking_id, package_name), q.q + w.more AS expected_qty, p.package_name IS NOT NULL AS present,
    CASE WHEN p.picking_id % 29 = 0 AND p.package_name LIKE '%-PAL-3' THEN 'Box' ELSE 'Pallet' END AS package_type,
    CASE WHEN p.picking_id % 19 = 0 AND p.package_name LIKE '%-PAL-1' THEN 0 ELSE gross_weight_lb END AS weight,
    CASE WHEN p.picking_id % 23 = 0 AND p.package_name LIKE '%-PAL-2' THEN NULL ELSE finalized_at END AS finalized_at
  FROM w JOIN f USING (picking_id, package_name) JOIN q USING (picking_id, package_name)
  LEFT JOIN (SELECT * FROM package WHERE NOT (picking_id % 17 = 0 AND package_name LIKE '%-PAL-4')) p USING (picking_id, package_name))"""
PALLET_CHECKS_SQL = check_sql("pallets", "picking_id || '/' || package_name", "j", [
    ("present", "present", "blocker"), ("package type", "present AND package_type = 'Pallet'", "minor"),
    ("weight populated", "present AND weight > 0", "major"), ("finalised", "finalized_at IS NOT NULL", "major"),
    ("has product", "has_product", "blocker"), ("quantity", "abs(fg_qty - expected_qty) < 0.001", "blocker"),
    ("has finished lot", "has_lot", "blocker"), ("order link", "has_order", "major")])


@job(f"WITH {PALLETS_SQL}\n{PALLET_CHECKS_SQL}", "move_line", "package")
def q_pallet_verify(spark, folder):
    lines = S.move_line(spark, folder)
    picking, name = F.col("picking_id"), F.col("package_name")
    contents = lines.filter(name.isNotNull()).select("picking_id", "package_name", "product_id", "quantity", "lot_name", "order_no")
    keys = ["picking_id", "package_name"]
    first = contents.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("order_no", "product_id", "lot_name")])
    measured = (contents.join(first.select(*keys, F.col("product_id").alias("_first")), keys).filter(F.col("product_id") == F.col("_first"))
                .groupBy(*keys).agg(F.sum("quantity").alias("_qty")))
    expected = first.join(measured, keys).select(
        *keys, F.when(picking % 37 == 0, "WH/MO/none").otherwise(F.col("order_no")).alias("order_no"),
        F.when((picking % 41 == 0) & name.endswith("-PAL-1"), -1).otherwise(F.col("product_id")).alias("product_id"),
        F.when((picking % 43 == 0) & name.endswith("-PAL-2"), "no such lot").otherwise(F.col("lot_name")).alias("lot_name"),
        F.when((picking % 31 == 0) & name.endswith("-PAL-5"), F.col("_qty") + 1).otherwise(F.col("_qty")).alias("expected_qty"))
    packages = S.package(lines).filter(~((picking % 17 == 0) & name.endswith("-PAL-4"))).select(
        "picking_id", "package_name",
        F.when((picking % 29 == 0) & name.endswith("-PAL-3"), "Box").otherwise("Pallet").alias("package_type"),
        F.when((picking % 19 == 0) & name.endswith("-PAL-1"), 0.0).otherwise(F.col("gross_weight_lb")).alias("gross_weight_lb"),
        F.when(~((picking % 23 == 0) & name.endswith("-PAL-2")), F.col("finalized_at")).alias("finalized_at"))
    return pallets.verify(expected, packages, contents)


@job("""WITH plant AS (SELECT package_name, lot_name, picking_id, count(*) AS n FROM move_line
  WHERE package_name IS NOT NULL AND picking_id % 9 <> 0 GROUP BY ALL),
erp AS (SELECT package_name, lot_name, picking_id, count(*) AS n FROM move_line
  WHERE package_name IS NOT NULL AND order_id % 7 <> 0 GROUP BY ALL)
SELECT picking_id, package_name, lot_name, coalesce(plant.n, 0) AS plant_units, coalesce(erp.n, 0) AS erp_units,
  coalesce(plant.n, 0) - coalesce(erp.n, 0) AS change,
  CASE WHEN coalesce(plant.n, 0) > coalesce(erp.n, 0) THEN 'pack' WHEN coalesce(plant.n, 0) < coalesce(erp.n, 0) THEN 'unpack' ELSE 'ok' END AS action,
  CAST(0 AS BIGINT) AS left_over
FROM plant FULL JOIN erp USING (picking_id, package_name, lot_name)""", "move_line")
def q_pallet_reconcile(spark, folder):
    keys = ["picking_id", "package_name", "lot_name"]
    lines = S.move_line(spark, folder).filter(F.col("package_name").isNotNull()).withColumn("units", F.lit(1))
    plant = lines.filter(F.col("picking_id") % 9 != 0)
    erp = lines.filter(F.col("order_id") % 7 != 0)
    plan = pallets.reconcile(plant, erp, keys)
    again = pallets.reconcile(plant, pallets.replay(erp, plan, keys), keys)
    return plan.join(again.select(*keys, F.col("change").alias("_again")), keys, "left").withColumn(
        "left_over", F.coalesce("_again", F.lit(0))).drop("_again")


SCANS_SQL = """known AS (SELECT picking_id || '/' || package_name AS pallet_id, gross_weight_lb AS gross, picking_id FROM package),
scans AS (
  SELECT 'S-' || pallet_id AS scan_id, CASE WHEN picking_id % 11 = 0 THEN pallet_id || '-X' WHEN picking_id % 17 = 0 THEN '' ELSE pallet_id END AS pallet_id,
    CASE picking_id % 13 WHEN 0 THEN 0 WHEN 1 THEN -5 WHEN 2 THEN gross * 1.25 WHEN 3 THEN gross * 0.875 ELSE gross + 1 END AS weight FROM known)"""


@job(f"""WITH {SCANS_SQL}
SELECT scan_id, s.pallet_id, weight::DOUBLE AS weight, coalesce(gross, 0) AS expected_lb,
  CASE WHEN s.pallet_id = '' THEN 'reject: no pallet id' WHEN gross IS NULL THEN 'reject: unknown pallet'
    WHEN weight <= 0 THEN 'reject: weight' WHEN abs(weight - gross) > 0.10::DOUBLE * gross THEN 'warn' ELSE 'ok' END AS verdict
FROM scans s LEFT JOIN known k ON k.pallet_id = s.pallet_id""", "package")
def q_weight_check(spark, folder):
    known = S.package(S.move_line(spark, folder)).select(
        F.concat_ws("/", F.col("picking_id").cast("string"), "package_name").alias("pallet_id"), "picking_id",
        (F.col("gross_weight_lb") - 50).alias("net_lb"))
    picking, gross, name = F.col("picking_id"), F.col("net_lb") + 50, F.col("pallet_id")
    scans = known.select(
        F.concat(F.lit("S-"), name).alias("scan_id"),
        F.when(picking % 11 == 0, F.concat(name, F.lit("-X"))).when(picking % 17 == 0, "").otherwise(name).alias("pallet_id"),
        F.when(picking % 13 == 0, 0.0).when(picking % 13 == 1, -5.0).when(picking % 13 == 2, gross * 1.25)
        .when(picking % 13 == 3, gross * 0.875).otherwise(gross + 1).alias("weight"))
    return pallets.weight_check(known, scans)


@job("""WITH shipped AS (SELECT user_id, min(ts) AS shipped_at FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0 GROUP BY user_id),
j AS (
  SELECT e.user_id AS pallet_id, event_id, ts, value - 5 AS weight,
    CASE WHEN ts >= shipped_at THEN 'blocked' WHEN value - 5 <= 0 THEN 'rejected' ELSE 'accepted' END AS state
  FROM events e LEFT JOIN shipped s ON s.user_id = e.user_id WHERE event_type <> 'purchase')
SELECT pallet_id, coalesce(arg_max(weight, (ts, event_id)) FILTER (WHERE state = 'accepted'), 0) AS gross_weight,
  coalesce(strftime(max(ts) FILTER (WHERE state = 'accepted'), '%Y-%m-%d %H:%M:%S'), '') AS finalized_at,
  count(*) FILTER (WHERE state = 'accepted') AS n_accepted, count(*) FILTER (WHERE state = 'blocked') AS n_blocked,
  count(*) FILTER (WHERE state = 'rejected') AS n_rejected
FROM j GROUP BY pallet_id""")
def q_finalize_history(spark, folder):
    events = table(spark, folder, "events")
    scans = events.filter(F.col("event_type") != "purchase").select(
        F.col("user_id").alias("pallet_id"), F.col("event_id").alias("scan_id"), F.col("ts").alias("scanned_at"),
        (F.col("value") - 5).alias("weight"))
    shipments = events.filter((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)).select(
        F.col("user_id").alias("pallet_id"), F.col("ts").alias("shipped_at"))
    return pallets.finalize_history(scans, shipments)


@job("""WITH wanted AS (SELECT picking_id, package_name, sum(quantity) AS quantity FROM move_line WHERE package_name IS NOT NULL GROUP BY ALL),
lines AS (SELECT picking_id, package_name, quantity FROM wanted WHERE picking_id % 3 = 0
  UNION ALL SELECT picking_id, package_name, quantity FROM move_line WHERE picking_id % 3 <> 0),
existing AS (SELECT picking_id, package_name, count(*) AS n_lines, sum(quantity) AS quantity FROM lines GROUP BY ALL)
SELECT picking_id, CASE WHEN picking_id % 3 = 0 THEN 'keep' ELSE 'delete' END AS action, coalesce(package_name, '(loose)') AS package_name, n_lines, quantity FROM existing
UNION ALL SELECT picking_id, 'create', package_name, 1, quantity FROM wanted WHERE picking_id % 3 <> 0""", "move_line")
def q_rewire_plan(spark, folder):
    lines = S.move_line(spark, folder).select("picking_id", "package_name", "quantity")
    wanted = lines.filter(F.col("package_name").isNotNull()).groupBy("picking_id", "package_name").agg(
        F.sum("quantity").alias("quantity"))
    mixed = wanted.filter(F.col("picking_id") % 3 == 0).unionByName(lines.filter(F.col("picking_id") % 3 != 0))
    return pallets.rewire_plan(mixed, wanted)


@job("""SELECT lot_name, picking_id, product_id, count(*) AS n_cases, min(regexp_replace(lot_name, '-[^-]*$', '')) AS made_by,
  row_number() OVER (ORDER BY count(*) DESC, lot_name, picking_id, product_id) AS place
FROM move_line WHERE package_name IS NULL AND lot_name IS NOT NULL AND state <> 'done' GROUP BY lot_name, picking_id, product_id""", "move_line")
def q_open_unassigned(spark, folder):
    lines = S.move_line(spark, folder)
    return pallets.open_unassigned(lines, lines.filter(F.col("lot_name").isNotNull()).select("order_no", "lot_name").distinct())
