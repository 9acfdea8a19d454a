"""Order paper queries."""

from pyspark.sql import functions as F

from plantledger.operators import paper
from plantledger.plans.registry import job
from plantledger.plans.views import BATCH, LINE_ORDER, PALLET_NUMBER, PALLET_PREFIX, PIECES
from plantledger.sources import standins as S
from plantledger.sources.tables import table

PICKED = f"""picked AS (
  SELECT m.*, p.product_name, p.display_name, p.packaging_name, p.packaging_qty, p.count_per_unit,
    coalesce({BATCH.format('lot_name')}, '') AS batch, coalesce(m.move_packaging, p.packaging_name, m.uom) AS unit_label,
    {PIECES} AS pieces
  FROM move_line m LEFT JOIN product p USING (product_id))"""
DIMS = "format('{:g} x {:g} x {:g}', length, width, height)"
DASHED = "CASE WHEN batch <> '' THEN batch ELSE '-' END"


@job(f"""WITH {PICKED},
contents AS (
  SELECT picking_id, package_name, product_id, batch, sum(pieces) AS pieces,
    arg_min(unit_label, (-quantity, {LINE_ORDER}, unit_label)) AS unit_label,
    any_value(product_name) AS product_name, min((-quantity, {LINE_ORDER}, unit_label)) AS first_at
  FROM picked WHERE package_name IS NOT NULL GROUP BY ALL),
labels AS (
  SELECT picking_id, package_name, unit_label, sum(pieces) AS n, min((-quantity, {LINE_ORDER})) AS first_at
  FROM picked WHERE package_name IS NOT NULL GROUP BY ALL),
units AS (
  SELECT picking_id, package_name, string_agg(n || ' ' || unit_label, ' | ' ORDER BY first_at, unit_label) AS units
  FROM labels GROUP BY ALL),
pallets AS (
  SELECT *, row_number() OVER (PARTITION BY picking_id ORDER BY {PALLET_PREFIX.format('package_name')},
    {PALLET_NUMBER.format('package_name')}, package_name) AS row_no FROM package)
SELECT picking_id, row_no, replace(replace(package_name, 'WH/MO/', ''), 'WH/', '') AS pallet,
  row_number() OVER (PARTITION BY picking_id, package_name ORDER BY first_at, product_id, batch) AS content_no,
  product_name, format('{{:g}}', pieces::DOUBLE) AS qty, unit_label, {DASHED} AS batch, units, {DIMS} AS dims,
  printf('%.1f', gross_weight_lb) AS weight
FROM contents JOIN pallets USING (picking_id, package_name) JOIN units USING (picking_id, package_name)
UNION ALL
SELECT picking_id, coalesce(n, 0) + row_number() OVER (PARTITION BY picking_id ORDER BY {LINE_ORDER}, pieces),
  'NO PALLET', 1, product_name, format('{{:g}}', pieces::DOUBLE), unit_label, {DASHED},
  pieces || ' ' || unit_label, '-', '-'
FROM picked LEFT JOIN (SELECT picking_id, count(*) AS n FROM package GROUP BY picking_id) USING (picking_id)
WHERE package_name IS NULL""", "move_line", "package", "product")
def q_pick_checklist(spark, folder):
    lines = S.move_line(spark, folder)
    return paper.pick_checklist(lines, S.product(spark, folder), S.package(lines))


@job(f"""WITH {PICKED},
weight AS (SELECT picking_id, count(*) AS pallets, sum(gross_weight_lb) AS lb FROM package GROUP BY picking_id),
pieces AS (SELECT picking_id, CASE WHEN grouping(unit_label) = 1 THEN '(total)' ELSE unit_label END AS unit_label,
  CAST(sum(pieces) AS BIGINT) AS pieces
  FROM picked GROUP BY GROUPING SETS ((picking_id, unit_label), (picking_id)))
SELECT picking_id, unit_label, pieces, coalesce(pallets, 0) AS pallets, printf('%.1f', coalesce(lb, 0)::DOUBLE) AS weight
FROM pieces LEFT JOIN weight USING (picking_id)""", "move_line", "package", "product")
def q_pick_totals(spark, folder):
    lines = S.move_line(spark, folder)
    return paper.pick_totals(lines, S.product(spark, folder), S.package(lines))


@job(f"""WITH {PICKED},
ranked AS (
  SELECT *, CASE WHEN package_name IS NULL THEN 1 ELSE 0 END AS loose,
    CASE WHEN package_name IS NULL THEN '' ELSE {PALLET_PREFIX.format('package_name')} END AS prefix,
    CASE WHEN package_name IS NULL THEN 0 ELSE {PALLET_NUMBER.format('package_name')} END AS number,
    CASE WHEN package_name IS NULL THEN 0 ELSE -quantity END AS fall
  FROM picked),
groups AS (
  SELECT picking_id, product_id, batch, CAST(sum(pieces) AS BIGINT) AS pieces,
    count(DISTINCT package_name) AS on_pallets,
    min((loose, prefix, number, fall, {LINE_ORDER})) AS first_at,
    arg_min(uom, ({LINE_ORDER}, uom)) AS uom, any_value(product_name) AS product_name,
    any_value(display_name) AS display_name, any_value(packaging_name) AS packaging_name,
    any_value(packaging_qty) AS packaging_qty
  FROM ranked GROUP BY picking_id, product_id, batch)
SELECT picking_id, row_number() OVER (PARTITION BY picking_id ORDER BY first_at, product_id, batch) AS position,
  product_name, split_part(display_name, chr(10), 1) AS description, split_part(display_name, chr(10), 2) AS more_lines,
  {DASHED} AS lot, pieces,
  CASE WHEN packaging_name IS NOT NULL AND coalesce(packaging_qty, 0) <> 0 THEN packaging_name ELSE uom END AS unit_label,
  on_pallets
FROM groups""", "move_line", "product")
def q_order_summary(spark, folder):
    return paper.order_summary(S.move_line(spark, folder), S.product(spark, folder))


DELIVERY = f"""lots AS (
  SELECT picking_id, product_id, string_agg(batch, ', ' ORDER BY batch) AS lots
  FROM (SELECT DISTINCT picking_id, product_id, {BATCH.format('lot_name')} AS batch FROM move_line
        WHERE lot_name IS NOT NULL) GROUP BY ALL),
delivery AS (
  SELECT m.picking_id, product_name, CAST(1 AS BIGINT) AS page, split_part(display_name, chr(10), 1) AS description,
    split_part(display_name, chr(10), 2) AS more_lines, coalesce(lots, '') AS lots,
    format('{{:g}}', ordered) || ' ' || uom AS order_qty, format('{{:g}}', shipped) || ' ' || uom AS shipped_qty,
    CASE WHEN n_pallets = 1 THEN '1 pallet' WHEN n_pallets > 1 THEN n_pallets || ' pallets'
      WHEN packaging_name IS NOT NULL AND coalesce(packaging_qty, 0) <> 0
        THEN format('{{:g}}', shipped / packaging_qty) || ' ' || packaging_name ELSE '-' END AS packed,
    coalesce(s_name, '') AS ship_from
  FROM move m LEFT JOIN product p USING (product_id) LEFT JOIN supplier ON s_suppkey = supplier_id
    LEFT JOIN lots l ON l.picking_id = m.picking_id AND l.product_id = m.product_id)"""


def _suppliers(spark, folder):
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"))


@job(f"WITH {DELIVERY} SELECT * FROM delivery", "move_line", "move", "product")
def q_delivery_lines(spark, folder):
    lines = S.move_line(spark, folder)
    return paper.delivery_lines(S.move(lines), lines, S.product(spark, folder), _suppliers(spark, folder))


@job(f"WITH {DELIVERY} SELECT * EXCLUDE (ship_from) FROM delivery", "move_line", "move", "product")
def q_blind_ship_lines(spark, folder):
    return paper.blind_ship_lines(q_delivery_lines(spark, folder))


@job("""WITH lines AS (
  SELECT *, CASE line_no WHEN 6 THEN 'line_section' WHEN 7 THEN 'line_note' END AS display_type,
    row_number() OVER (PARTITION BY order_id ORDER BY line_no, product_id, supplier_id, ship_date, price) AS position
  FROM sale_order_line),
totals AS (
  SELECT order_id, round(sum(price_subtotal), 2) AS untaxed, round(sum(tax), 2) AS tax_amount,
    max(discount > 0) AS display_discount
  FROM lines WHERE display_type IS NULL GROUP BY order_id)
SELECT order_id, position, coalesce(display_type, 'product') AS display_type,
  CASE WHEN display_type IS NULL THEN count(*) FILTER (WHERE display_type IS NULL)
    OVER (PARTITION BY order_id ORDER BY position) ELSE 0 END AS row_no,
  split_part(display_name, chr(10), 1) AS name, split_part(display_name, chr(10), 2) AS more_lines,
  CASE WHEN display_type IS NULL THEN format('{:g}', product_uom_qty) || coalesce(' (' ||
    format('{:g}', product_uom_qty / packaging_qty) || ' ' || packaging_name || ')', '') ELSE '' END AS qty,
  CASE WHEN display_type IS NULL AND discount > 0 THEN 'Discount: ' || format('{:g}', discount * 100) || '%'
    ELSE '' END AS discount_text,
  CASE WHEN display_type IS NULL THEN format('{:,.2f}', round(price_subtotal, 2)::DOUBLE) ELSE '' END AS subtotal,
  coalesce(display_discount, FALSE) AS display_discount,
  format('{:,.2f}', coalesce(untaxed, 0)::DOUBLE) AS untaxed, format('{:,.2f}', coalesce(tax_amount, 0)::DOUBLE) AS tax,
  format('{:,.2f}', coalesce(untaxed + tax_amount, 0)::DOUBLE) AS total
FROM lines LEFT JOIN totals USING (order_id) LEFT JOIN product USING (product_id)""", "sale_order_line", "product")
def q_sale_lines(spark, folder):
    kind = F.when(F.col("line_no") == 6, "line_section").when(F.col("line_no") == 7, "line_note")
    lines = S.sale_order_line(spark, folder).withColumn("display_type", kind)
    return paper.sale_lines(lines, S.product(spark, folder))


@job(f"""WITH inv AS (
  SELECT order_id AS invoice_id, order_id * 1000 + product_id % 20 AS sale_line_id, min(product_id) AS product_id,
    sum(product_uom_qty) AS quantity, sum(price_subtotal) AS subtotal,
    CAST(floor(order_id / 100) AS BIGINT) AS picking_id, product_id % 20 AS fold_id
  FROM sale_order_line WHERE line_status = 'F' GROUP BY order_id, product_id % 20),
lots AS (
  SELECT picking_id, product_id AS fold_id, string_agg(batch, ', ' ORDER BY batch) AS lots
  FROM (SELECT DISTINCT picking_id, product_id, {BATCH.format('lot_name')} AS batch FROM move_line
        WHERE lot_name IS NOT NULL) GROUP BY ALL)
SELECT invoice_id, sale_line_id, product_name, CAST(1 AS BIGINT) AS page, split_part(display_name, chr(10), 1) AS name,
  coalesce(lots, '') AS lots, format('{{:g}}', quantity) AS qty,
  format('{{:,.2f}}', round(subtotal, 2)::DOUBLE) AS subtotal
FROM inv LEFT JOIN lots USING (picking_id, fold_id) LEFT JOIN product USING (product_id)""",
     "sale_order_line", "move_line", "product")
def q_invoice_lines(spark, folder):
    fold = F.col("product_id") % 20
    picking = F.floor(F.col("order_id") / 100).cast("bigint")
    sold = S.sale_order_line(spark, folder).withColumn("sale_line_id", F.col("order_id") * 1000 + fold)
    invoice = sold.filter(F.col("line_status") == "F").groupBy(F.col("order_id").alias("invoice_id"), "sale_line_id").agg(
        F.min("product_id").alias("product_id"), F.sum("product_uom_qty").alias("quantity"),
        F.sum("price_subtotal").alias("subtotal"))
    sale = sold.select("sale_line_id", (picking * 1000 + fold).alias("move_id")).distinct()
    stock = S.move_line(spark, folder).select("picking_id", F.col("product_id").alias("fold_id"), "lot_name")
    moves = stock.select("picking_id", "fold_id").distinct().withColumn(
        "move_id", F.col("picking_id") * 1000 + F.col("fold_id"))
    return paper.invoice_lines(invoice, sale, moves, stock, S.product(spark, folder))


@job("""WITH head AS (
  SELECT order_id, CAST(amount_total AS DECIMAL(18,2)) AS total, state = 'draft' AS is_draft,
    order_id % 50 = 0 AS is_refund_doc FROM sale_order),
paid AS (SELECT order_id, sum(amount) AS paid, count(*) AS n FROM payment GROUP BY order_id),
bal AS (
  SELECT head.*, n, total - coalesce(paid, 0) AS residual,
    CASE WHEN is_draft AND is_refund_doc THEN 'Draft Credit Note' WHEN is_draft THEN 'Draft Invoice'
      WHEN is_refund_doc THEN 'Credit Note' ELSE 'Invoice' END AS title
  FROM head LEFT JOIN paid USING (order_id))
SELECT order_id, title, CAST(entry_no AS BIGINT) AS row_no,
  CASE WHEN is_exchange THEN 'Exchange Difference:'
    WHEN is_refund THEN 'Reversed on ' || strftime(date, '%m/%d/%Y') || ':'
    ELSE 'Paid on ' || strftime(date, '%m/%d/%Y') || ':' END AS label,
  format('{:,.2f}', amount::DOUBLE) AS amount
FROM payment JOIN bal USING (order_id) WHERE NOT is_draft
UNION ALL
SELECT order_id, title, coalesce(n, 0) + 1, 'Remaining Balance:', format('{:,.2f}', residual::DOUBLE) FROM bal
WHERE NOT is_draft AND (n IS NOT NULL OR (residual <> 0 AND residual <> total))""", "sale_order", "payment")
def q_invoice_balance(spark, folder):
    invoices = S.sale_order(spark, folder).select(
        "order_id", "amount_total", (F.col("state") == "draft").alias("is_draft"),
        (F.col("order_id") % 50 == 0).alias("is_refund_doc"))
    return paper.invoice_balance(invoices, S.payment(spark, folder))


@job(f"""WITH head AS (
  SELECT picking_id, package_name, min(order_no) AS first_order, count(*) AS case_count,
    coalesce(string_agg(DISTINCT lot_name, ', ' ORDER BY lot_name), '') AS lots
  FROM move_line WHERE package_name IS NOT NULL GROUP BY ALL)
SELECT picking_id, replace(replace(package_name, 'WH/MO/', ''), 'WH/', '') AS pallet, first_order, case_count, lots,
  {DIMS} AS dims, printf('%.1f', gross_weight_lb) AS weight, strftime(finalized_at, '%m/%d/%Y %H:%M') AS finalized,
  row_number() OVER (PARTITION BY picking_id, package_name ORDER BY {LINE_ORDER}, quantity, uom) AS line_no,
  coalesce(lot_name, '-') AS lot, split_part(display_name, chr(10), 1) AS product,
  format('{{:g}}', quantity) || ' ' || uom AS qty
FROM move_line JOIN head USING (picking_id, package_name) JOIN package USING (picking_id, package_name)
  LEFT JOIN product USING (product_id)""", "move_line", "package", "product")
def q_pallet_sheet(spark, folder):
    lines = S.move_line(spark, folder)
    return paper.pallet_sheet(lines, S.package(lines), S.product(spark, folder))


@job("""WITH resolved AS (
  SELECT p.partner_id, CASE WHEN p.street IS NOT NULL THEN p.partner_name ELSE c.partner_name END AS name,
    coalesce(p.street, c.street, '') AS street
  FROM partner p LEFT JOIN partner c ON c.partner_id = p.commercial_id)
SELECT o_orderkey AS document_id, b.name AS bill_name, b.street AS bill_street, s.name AS sold_name,
  s.street AS sold_street, h.name AS ship_name, h.street AS ship_street
FROM orders LEFT JOIN resolved b ON b.partner_id = o_custkey
  LEFT JOIN resolved s ON s.partner_id = CASE WHEN o_orderkey % 8 = 0 THEN o_custkey ELSE o_custkey - o_custkey % 10 END
  LEFT JOIN resolved h ON h.partner_id = o_custkey - o_custkey % 10 + o_orderkey % 10""", "partner")
def q_address_fallback(spark, folder):
    key, contact = F.col("o_orderkey"), F.col("o_custkey")
    documents = table(spark, folder, "orders").select(
        key.alias("document_id"), contact.alias("bill_id"),
        F.when(key % 8 != 0, contact - contact % 10).alias("sold_id"),
        (contact - contact % 10 + key % 10).alias("ship_id"))
    return paper.addresses(documents, S.partner(spark, folder))
