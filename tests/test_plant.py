"""Production, pallets, tracing, paper and checks on the known cases."""

import pytest
from pyspark.sql import functions as F

from plantledger.operators import checks, pallets, paper, production, trace


def test_blend_of_one_layer_set(spark):
    """A five-layer film of 100 lb: the shares below are layer and hopper shares multiplied out."""
    shares = {"base": [9.8, 15.0, 17.0, 8.6], "filler": [3.0, 3.0], "repro": [38.0], "film": [1.0],
              "antiblock": [0.2, 0.4], "brown": [2.0], "slip": [2.0]}
    hoppers = [(name, share / 100) for name, parts in shares.items() for share in parts]
    blend = spark.createDataFrame([(1, [(1.0, hoppers)])],
                                  "product_id int, layers array<struct<share:double,hoppers:array<struct<material_id:string,share:double>>>>")
    rolls = spark.createDataFrame([("W", 1, 60.0), ("W", 1, 40.0)], "work_order string, product_id int, weight double")
    got = {r.material_id: round(r.consumed, 2) for r in production.blend_allocate(rolls, blend).collect()}
    assert got == {"base": 50.40, "filler": 6.00, "repro": 38.00, "film": 1.00, "antiblock": 0.60,
                   "brown": 2.00, "slip": 2.00}


def test_bom_demand(spark, rows):
    orders = spark.createDataFrame([(1, 5, 3000.0), (1, 5, 500.0)], "order_id int, product_id int, quantity double")
    bom = spark.createDataFrame([(5, 70.0)], "product_id int, bom_qty double")
    parts = spark.createDataFrame([(5, [("blend", 70.0, "lb"), ("core", 16.25, "in"), ("plug", 2.0, "Units")])],
                                  "product_id int, components array<struct<component_id:string,qty:double,uom:string>>")
    assert rows(production.bom_demand(orders, bom, parts), "component_id", "demand", "total_lb") == [
        ("blend", 3500.0, 3500.0), ("core", 812.5, 3500.0), ("plug", 100.0, 3500.0)]


def test_bom_demand_deals_rows_to_bounded_tasks(spark, rows, monkeypatch):
    """Orders without a number, repeated lines and a component in two units; more tasks than adaptive execution would leave."""
    monkeypatch.setattr("plantledger.session.TASK_ROWS", 20)
    orders = spark.range(400).select(F.when(F.col("id") % 40 != 0, F.col("id") % 200).alias("order_id"), (F.col("id") % 25).alias("product_id"), F.lit(2.0).alias("quantity"))
    bom = spark.range(25).select(F.col("id").alias("product_id"), F.lit(1.0).alias("bom_qty"))
    lines = bom.select("product_id", F.expr("array(named_struct('component_id', product_id % 3, 'qty', 1D, 'uom', 'lb'), "
                                            "named_struct('component_id', product_id % 3, 'qty', 3D, 'uom', 'Units'))").alias("components"))
    demand = production.bom_demand(orders, bom, lines)
    assert demand.rdd.getNumPartitions() == 40
    per_order = {r[0]: (r[1], r[2]) for r in demand.groupBy("order_id").agg(F.max("total_lb"), F.sum(F.when(F.col("uom") == "lb", F.col("demand")))).collect()}
    assert per_order.pop(None) == (0.0, 20.0)
    assert len(per_order) == 195 and all(total == pounds == 4.0 for total, pounds in per_order.values())


def test_pack_plan(spark, rows):
    orders = spark.createDataFrame([(1, 5, 3500.0), (2, 6, 26.0)], "order_id int, product_id int, quantity double")
    packs = spark.createDataFrame([(5, "ROLL", 70, 2), (5, "roll", 10, 3), (6, "Case", 10, 1)],
                                  "product_id int, packaging_name string, packaging_qty int, sequence int")
    assert rows(production.pack_plan(orders, packs, 25), "order_id", "rolls", "pallets") == [(1, 50, 2), (2, 26, 2)]


def test_consumption_verdicts(spark, rows):
    actual = spark.createDataFrame([(1, "A", 5.0), (2, "B", 5.0), (3, "C", 4.0)], "material_id int, lot string, quantity double")
    expected = spark.createDataFrame([(1, 5.0, "A"), (2, 5.0, "X"), (3, 5.0, "X"), (4, 1.0, "Z")],
                                     "material_id int, expected_qty double, expected_lot string")
    assert rows(production.consumption_check(actual, expected), "material_id", "status") == [
        (1, "PASS"), (2, "LOT MISMATCH"), (3, "QTY MISMATCH"), (4, "MISSING")]


def test_unit_ranges(spark, rows):
    units = spark.createDataFrame([("P", n) for n in (10, 1, 2, 3, 5, 7, 8, 7)], "k string, n int")
    assert rows(pallets.unit_ranges(units, ["k"], "n"), "units", "n_units", "n_runs") == [("1-3, 5, 7-8, 10", 7, 4)]


@pytest.mark.parametrize("n, parents, sizes", [(8, 3, [3, 3, 2]), (2, 3, [1, 1]), (9, 3, [3, 3, 3])])
def test_spread(spark, n, parents, sizes):
    units = spark.range(n).select(F.lit("o").alias("k"), "id")
    got = pallets.spread(units, "k", ["id"], parents).groupBy("parent_no").count().orderBy("parent_no").collect()
    assert [r["count"] for r in got] == sizes


def test_reconcile_life_of_two_pallets(spark, rows):
    """Three units, a fourth stacked, two moved to another pallet, one taken off; each replay leaves no difference."""
    schema = "pallet string, lot string, units int"
    states = [[("A", "L", 3)], [("A", "L", 4)], [("A", "L", 2), ("B", "L", 2)], [("A", "L", 1), ("B", "L", 2)]]
    keys, erp = ["pallet", "lot"], spark.createDataFrame([], schema)
    for state in states:
        plant = spark.createDataFrame(state, schema)
        plan = pallets.reconcile(plant, erp, keys)
        erp = pallets.replay(erp, plan, keys)
        assert rows(erp) == sorted(state)
        assert pallets.reconcile(plant, erp, keys).filter("action <> 'ok'").count() == 0


def test_weight_rejections(spark, rows):
    packages = spark.createDataFrame([("P1", 950.0)], "pallet_id string, net_lb double")
    scans = spark.createDataFrame([(1, "P1", 0.0), (2, "P1", -5.0), (3, "NOPE", 100.0), (4, "", 100.0), (5, "P1", 1005.0), (6, "P1", 1150.0)],
                                  "scan_id int, pallet_id string, weight double")
    assert [r[1] for r in rows(pallets.weight_check(packages, scans), "scan_id", "verdict")] == [
        "reject: weight", "reject: weight", "reject: unknown pallet", "reject: no pallet id", "ok", "warn"]


def line(picking, product, lot, package, quantity, uom, i):
    return (picking, product, "MO", lot, package, float(quantity), uom, "done", i, 1, product, 1, float(i))


LINE = ("picking_id int, product_id int, order_no string, lot_name string, package_name string, quantity double, uom string, "
        "state string, order_id int, unit_no int, part_id int, supplier_id int, price double")


def pick_lines(spark):
    """12 pallets of A, 8 of B and 2 mixed; 24 cases a pallet, 18 on every fifth, 12 + 10 on the mixed ones."""
    data, i = [], 0
    for n in range(1, 23):
        parts = [(1, 12), (2, 10)] if n > 20 else [(1 if n <= 12 else 2, 18 if n % 5 == 0 else 24)]
        for product, quantity in parts:
            i += 1
            data.append(line(1, product, f"WH/MO/0000{product}-U{n}", f"WH/MO/00001-PAL-{n}", quantity, "Case", i))
    return spark.createDataFrame(data, LINE).withColumn("ship_date", F.lit("2024-01-01").cast("timestamp_ntz"))


PRODUCTS = ("product_id int, product_name string, display_name string, packaging_name string, packaging_qty int, "
            "count_per_unit int, bom_type string")


def products(spark):
    return spark.createDataFrame([(1, "A", "Film A\nclear", None, None, None, "normal"), (2, "B", "Film B", None, None, None, "normal")], PRODUCTS)


def test_pick_sheet_natural_order_and_totals(spark, rows):
    from plantledger.sources.standins import package
    lines = pick_lines(spark)
    sheet = paper.pick_checklist(lines, products(spark), package(lines))
    order = [r.pallet for r in sheet.filter("content_no = 1").orderBy("row_no").collect()]
    assert order == [f"00001-PAL-{n}" for n in range(1, 23)]
    mixed = rows(sheet.filter("pallet = '00001-PAL-21'"), "content_no", "product_name", "qty", "units")
    assert mixed == [(1, "A", "12", "22 Case"), (2, "B", "10", "22 Case")]
    totals = rows(paper.pick_totals(lines, products(spark), package(lines)), "unit_label", "pieces", "pallets")
    expected = sum(r.quantity for r in lines.collect())
    assert totals == [("(total)", int(expected), 22), ("Case", int(expected), 22)]
    summary = rows(paper.order_summary(lines, products(spark)), "position", "product_name", "description", "lot", "pieces", "on_pallets")
    assert summary == [(1, "A", "Film A", "WH/MO/00001", 300, 14), (2, "B", "Film B", "WH/MO/00002", 200, 10)]


def test_trace_backward_flags(spark, rows):
    used = spark.createDataFrame([("F", "resin", "L-0042", 2.5), ("F", "resin", None, 0.5), ("F", "slip", None, 1.0),
                                  ("F", "repro", "FIX_DATA_7_AUTO", 1.0)], "order_no string, product_id string, lot_name string, quantity double")
    assert rows(trace.backward(used), "product_id", "total", "lots", "traced") == [
        ("repro", 1.0, "FIX_DATA_7_AUTO", False), ("resin", 3.0, "(no lot), L-0042", True), ("slip", 1.0, "(no lot)", False)]


def test_trace_forward_needs_a_done_delivery(spark, rows):
    used = spark.createDataFrame([("R", 1, 5.0), ("R", 1, 1.0), ("R", 2, 7.0)], "raw_lot string, order_id int, quantity double")
    made = spark.createDataFrame([(1, "F1"), (2, "F2")], "order_id int, finished_lot string")
    sent = spark.createDataFrame([("F1", 11, "done"), ("F2", 11, "assigned")], "finished_lot string, partner_id int, state string")
    people = spark.createDataFrame([(11, 10)], "partner_id int, commercial_id int")
    assert rows(trace.forward(used, made, sent, people)) == [("R", 10, 1, 1, 6.0)]


def test_trace_forward_counts_an_order_once(spark, rows):
    used = spark.createDataFrame([("R", 1, 10.0)], "raw_lot string, order_id int, quantity double")
    made = spark.createDataFrame([(1, "F1"), (1, "F2")], "order_id int, finished_lot string")
    sent = spark.createDataFrame([("F1", 11, "done"), ("F1", 12, "done"), ("F2", 11, "done"), ("F2", 13, "done")],
                                 "finished_lot string, partner_id int, state string")
    people = spark.createDataFrame([(11, 10), (12, 10), (13, 20)], "partner_id int, commercial_id int")
    assert rows(trace.forward(used, made, sent, people)) == [("R", 10, 1, 2, 10.0), ("R", 20, 1, 1, 10.0)]


def test_invoice_balance_rows(spark, rows):
    invoices = spark.createDataFrame([(1, 100.0, False, False), (2, 100.0, False, False), (3, 100.0, True, False)],
                                     "order_id int, amount_total double, is_draft boolean, is_refund_doc boolean")
    entries = spark.createDataFrame([(1, 1, 60.0, False, False), (1, 2, -10.0, True, False), (3, 1, 5.0, False, False)],
                                    "order_id int, entry_no int, amount double, is_refund boolean, is_exchange boolean")
    entries = entries.withColumn("amount", F.col("amount").cast("decimal(20,2)")).withColumn("date", F.lit("2024-03-04").cast("timestamp_ntz"))
    assert rows(paper.invoice_balance(invoices, entries)) == [
        (1, "Invoice", 1, "Paid on 03/04/2024:", "60.00"), (1, "Invoice", 2, "Reversed on 03/04/2024:", "-10.00"),
        (1, "Invoice", 3, "Remaining Balance:", "50.00")]


def test_matrix_is_computed(spark, rows):
    found = spark.createDataFrame([("a", True, "blocker"), ("a", True, "minor"), ("b", False, "minor"), ("b", False, "major")],
                                  "stage string, ok boolean, severity string")
    assert rows(checks.matrix(found)) == [("(all)", "FAIL", 4, 2, "major"), ("a", "PASS", 2, 0, ""), ("b", "FAIL", 2, 2, "major")]


def test_pick_sheet_aggregates_lines_once_for_each_breakdown(spark):
    lines = spark.createDataFrame(
        [(1, 7, "A-PAL-1", "A-1", 5.0, "Case", order, 1, 3, 2, "2024-01-01", 9.0, pack) for order, pack in ((1, None), (1, None), (2, "Bundle"))]
        + [(1, 8, "A-PAL-1", None, 4.0, "Case", 1, 2, 3, 2, "2024-01-01", 9.0, None), (1, 7, None, "B-1", 2.0, "Case", 3, 1, 3, 2, "2024-01-01", 9.0, None),
           (2, 7, None, "B-1", 2.0, "Case", 3, 1, 3, 2, "2024-01-01", 9.0, None)],
        "picking_id long, product_id long, package_name string, lot_name string, quantity double, uom string, order_id long, unit_no long, part_id long, "
        "supplier_id long, ship_date string, price double, move_packaging string")
    products = spark.createDataFrame([(7, "seven", None, "Roll")], "product_id long, product_name string, count_per_unit long, packaging_name string")
    packages = spark.createDataFrame([(1, "A-PAL-1", 40.0, 48.0, 52.0, 64.0), (1, "A-PAL-2", 40.0, 48.0, 52.0, 50.0)],
                                     "picking_id long, package_name string, length double, width double, height double, gross_weight_lb double")
    sheet = paper.pick_checklist(lines, products, packages)
    units = "10 Roll | 5 Bundle | 4 Case"
    assert sorted(map(tuple, sheet.collect()), key=repr) == sorted([
        (1, 1, "A-PAL-1", 1, "seven", "15", "Roll", "A", units, "40 x 48 x 52", "64.0"),
        (1, 1, "A-PAL-1", 2, None, "4", "Case", "-", units, "40 x 48 x 52", "64.0"),
        (1, 3, "NO PALLET", 1, "seven", "2", "Roll", "B", "2 Roll", "-", "-"),
        (2, 1, "NO PALLET", 1, "seven", "2", "Roll", "B", "2 Roll", "-", "-")], key=repr)
    plan = sheet._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3  # labels, their lists, pallets of a picking


def test_matrix_doubles_stages_and_not_checks(spark, rows):
    """A stage may be null, and the row of all stages keeps the gravest failure."""
    found = spark.createDataFrame([("a", True, "blocker"), ("a", False, "minor"), (None, False, "major"), (None, True, "minor"), ("b", True, "blocker")],
                                  "stage string, ok boolean, severity string")
    matrix = checks.matrix(found)
    assert rows(matrix, "stage", "status", "n_checks", "n_failed", "severity") == sorted([
        ("(all)", "FAIL", 5, 2, "major"), ("a", "FAIL", 2, 1, "minor"), ("b", "PASS", 1, 0, ""), (None, "FAIL", 2, 1, "major")], key=repr)
    assert checks.matrix(found.filter("false")).count() == 0
    assert "Aggregate" in matrix._jdf.queryExecution().optimizedPlan().toString().split("Expand")[1]
