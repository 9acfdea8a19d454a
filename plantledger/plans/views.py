"""SQL text of the stand-in views, and a helper that puts the needed ones in front of a query."""

from __future__ import annotations

BATCH = "regexp_replace({0}, '-[^-]*$', '')"
LINE_ORDER = "order_id, unit_no, part_id, supplier_id, ship_date, price"
PALLET_PREFIX = "CASE WHEN contains({0}, '-PAL-') THEN regexp_extract({0}, '^(.*)-PAL-', 1) ELSE {0} END"
PALLET_NUMBER = ("CASE WHEN regexp_matches({0}, '-PAL-[0-9]+$') "
                 "THEN CAST(regexp_extract({0}, '-PAL-([0-9]+)$', 1) AS INTEGER) ELSE 99999 END")
PIECES = """CAST(CASE
  WHEN regexp_matches(lower(uom), 'lb|kg|pound|ft|foot|feet') THEN 1
  WHEN regexp_matches(lower(uom), 'thousand|million') THEN
    CASE WHEN coalesce(count_per_unit, 0) <> 0 THEN greatest(1, round_even(quantity
      * (CASE WHEN contains(lower(uom), 'million') THEN 1000000.0::DOUBLE ELSE 1000.0::DOUBLE END)
      / count_per_unit::DOUBLE, 0)) ELSE 1 END
  ELSE greatest(1, round_even(quantity, 0)) END AS BIGINT)"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "move_line": ((), """
  SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS picking_id, l_partkey % 20 AS product_id,
    'WH/MO/' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 5, '0') AS order_no,
    CASE WHEN l_linenumber <> 7 THEN 'WH/MO/' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 5, '0')
      || '-U' || CAST(l_linenumber AS VARCHAR) END AS lot_name,
    CASE WHEN l_linenumber <= 5 THEN 'WH/MO/' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 5, '0')
      || '-PAL-' || CAST(l_linenumber AS VARCHAR) END AS package_name,
    l_quantity AS quantity,
    CASE l_returnflag WHEN 'A' THEN 'lb' WHEN 'N' THEN 'Thousands' ELSE 'Case' END AS uom,
    CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'assigned' END AS state,
    l_orderkey AS order_id, l_linenumber AS unit_no, l_partkey AS part_id, l_suppkey AS supplier_id,
    l_shipdate AS ship_date, l_extendedprice AS price, CASE WHEN l_partkey % 9 = 0 THEN 'Bundle' END AS move_packaging
  FROM lineitem"""),
    "move": (("move_line",), f"""
  SELECT picking_id, product_id, sum(quantity) AS ordered,
    coalesce(sum(quantity) FILTER (WHERE state = 'done'), 0) AS shipped,
    count(DISTINCT package_name) AS n_pallets,
    arg_min(uom, ({LINE_ORDER}, uom)) AS uom,
    arg_min(supplier_id, ({LINE_ORDER}, uom)) AS supplier_id
  FROM move_line GROUP BY picking_id, product_id"""),
    "package": (("move_line",), f"""
  SELECT picking_id, package_name, sum(quantity) + 50 AS gross_weight_lb, max(ship_date) AS finalized_at,
    40.0::DOUBLE AS length, 48.0::DOUBLE AS width,
    CASE WHEN {PALLET_NUMBER.format('package_name')} = 5 THEN 46.0::DOUBLE ELSE 52.0::DOUBLE END AS height
  FROM move_line WHERE package_name IS NOT NULL GROUP BY picking_id, package_name"""),
    "product": ((), """
  SELECT p_partkey AS product_id, CAST(p_partkey AS VARCHAR) AS product_name,
    p_name || chr(10) || p_brand AS display_name,
    CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'Roll' ELSE 'Case' END AS packaging_name,
    CAST(p_size AS BIGINT) AS packaging_qty,
    CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS BIGINT) * 100 END AS count_per_unit,
    CASE WHEN p_type = 'PROMO' THEN 'phantom' ELSE 'normal' END AS bom_type
  FROM part"""),
    "quant": ((), """
  SELECT l_partkey % 200 AS product_id, l_suppkey % 20 AS lot_key,
    CASE WHEN l_suppkey % 20 <> 13 THEN l_suppkey % 20 END AS lot,
    CASE WHEN l_linestatus = 'F' THEN 'Stock' ELSE 'customer' END AS location,
    sum(l_quantity) AS quantity,
    coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS reserved,
    min(l_shipdate) AS in_date
  FROM lineitem GROUP BY l_partkey % 200, l_suppkey % 20, l_linestatus"""),
    "stock_balance": ((), """
  SELECT c_custkey AS product_id, c_nationkey AS location_id, c_acctbal AS quantity, c_mktsegment AS segment,
    n_regionkey <= 2 AS internal, c_mktsegment = 'MACHINERY' AS is_kit
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "sale_order": ((), """
  SELECT o_orderkey AS order_id, CASE WHEN o_orderpriority LIKE '5%' THEN 'draft' ELSE 'sale' END AS state,
    CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'P' THEN 'partial' ELSE 'pending' END AS delivery_status,
    o_orderdate AS commitment_date, o_totalprice AS amount_total, o_custkey AS partner_id,
    o_orderstatus AS order_status
  FROM orders"""),
    "sale_order_line": ((), """
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS supplier_id,
    l_quantity AS product_uom_qty, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS qty_delivered,
    l_extendedprice AS price, l_discount AS discount,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1.00::DECIMAL(3,2) - CAST(l_discount AS DECIMAL(4,2)))
      AS DECIMAL(22,4)) AS price_subtotal,
    CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1.00::DECIMAL(3,2) - CAST(l_discount AS DECIMAL(4,2)))
      AS DECIMAL(22,4)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(26,6)) AS tax,
    l_shipdate AS ship_date, l_linestatus AS line_status, l_returnflag AS return_flag
  FROM lineitem"""),
    "production": ((), """
  SELECT l_orderkey AS order_id, sum(l_quantity) AS product_qty,
    sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS qty_produced, max(l_shipdate) AS date_finished
  FROM lineitem GROUP BY l_orderkey"""),
    "payment": ((), """
  SELECT o_orderkey AS order_id, 1 AS entry_no,
    CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(20,2))
      ELSE CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.6::DECIMAL(2,1), 2) AS DECIMAL(20,2)) END AS amount,
    FALSE AS is_refund, FALSE AS is_exchange, o_orderdate + INTERVAL 30 DAY AS date
  FROM orders WHERE o_orderstatus IN ('F', 'P')
  UNION ALL
  SELECT o_orderkey, 2, CAST(-round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.1::DECIMAL(2,1), 2) AS DECIMAL(20,2)),
    TRUE, FALSE, o_orderdate + INTERVAL 45 DAY
  FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 = 0"""),
    "partner": ((), """
  SELECT c_custkey AS partner_id, c_name AS partner_name, c_custkey - c_custkey % 10 AS commercial_id,
    CASE WHEN c_custkey % 3 <> 1 THEN CAST(c_custkey AS VARCHAR) || ' Main St' END AS street,
    c_nationkey AS nation_id
  FROM customer"""),
    "queue": ((), """
  SELECT event_id AS job_id, user_id AS entity,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'permanently_failed' ELSE 'pending' END AS status,
    event_id % 4 AS retries, ts AS updated_at
  FROM events"""),
}


def _ordered(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        _ordered(VIEWS[name][0], seen)
        if name not in seen:
            seen.append(name)
    return seen


def query(body: str, *names: str) -> str:
    """``body`` with the views it uses stated in front of it."""
    views = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in _ordered(names, []))
    return f"WITH {views}\nSELECT * FROM (\n{body}\n) AS result" if views else body
