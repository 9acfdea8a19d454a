"""Pre-flight, load, parity, text and stock operators on small fixtures and by property."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plantledger.functions import text as X
from plantledger.operators import inventory, migrate, parity, quality, textjobs
from plantledger.sources import load, sinks, versions
from plantledger.sources.tables import by_ids, missing_and_extra, read_snapshot, read_snapshot_folder, search


def test_orphans_then_null_then_none(spark, rows):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, 11), (4, None), (5, 12)], "id int, fk int")
    parent = spark.createDataFrame([(10,), (None,)], "pk int")
    assert rows(quality.orphan_keys(child, parent, "fk", "pk")) == [(11, 2), (12, 1)]
    fixed = quality.null_orphans(child, parent, "fk", "pk")
    assert rows(fixed) == [(1, 10, False), (2, None, True), (3, None, True), (4, None, False), (5, None, True)]
    assert rows(quality.orphan_keys(fixed, parent, "fk", "pk")) == []
    assert fixed.select("id", "fk").exceptAll(quality.null_orphans(fixed.drop("was_orphan"), parent, "fk", "pk").select("id", "fk")).count() == 0


def test_missing_parent_table_is_skipped(spark, rows):
    child = spark.createDataFrame([(1,)], "fk int")
    got = quality.fk_orphans([("c", child, "fk", "p", child, "fk"), ("c", child, "fk", "gone", None, "x")])
    assert rows(got) == [("c", "fk", "p", 0, 0)]


def test_coerce(spark, rows):
    df = spark.createDataFrame([("1", "2024-01-01", "1.5", "1", '{"a":1}', "x"), ("2", "", "", "", "", "x"),
                                ("3", "soon", "n/a", "0", "{", "x"), ("4", "2024-01-01T00:00:00Z", "2", "f", "{", "x")],
                               "id string, at string, v string, f string, j string, old string")
    good, rejects = migrate.coerce(df, {"id": "bigint", "at": "date", "v": "double", "f": "bool", "j": "json", "absent": "bool"})
    assert good.columns == ["id", "at", "v", "f", "j", "j_malformed"]
    assert rows(good, "id", "v", "f", "j_malformed") == [(1, 1.5, True, False), (2, None, None, False), (4, 2.0, False, True)]
    assert rows(rejects, "id", "reason") == [("3", "at, v")]


def test_first_wins_and_next_keys(spark, rows):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert rows(migrate.first_wins([("a", a), ("b", b)], ["k"])) == [(1, "a", "a"), (2, "b", "b")]
    assert rows(migrate.next_keys({"b": (b, "k"), "none": (b.filter("k > 9"), "k")})) == [("b", 3), ("none", 1)]


def test_parity_of_equal_sides_is_green(spark, rows):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v"),
                                 F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id)").alias("ts"))
    windows = parity.window_parity(df, df.orderBy(F.desc("v")).repartition(3), "ts", "v")
    assert windows.filter("not match").count() == 0
    assert parity.row_diff(df, df, "id").count() == 0
    assert {r.status for r in parity.column_profile_diff(df, df).collect()} == {"same"}
    assert rows(parity.drift_status(windows.select(F.lit("t").alias("table_name"), "match"))) == [("(all)", "green", 0), ("t", "green", 0)]


def test_json_diff_ignores_order_and_volatile_keys(spark, rows):
    a = {"updated_at": "1", "rolls": [{"roll_id": "a", "w": 1}, {"roll_id": "b", "w": 2}], "n": [1, 2], "x": {"y": None}}
    b = {"updated_at": "2", "rolls": [{"w": 2, "roll_id": "b"}, {"roll_id": "a", "w": 1}], "n": [1, 2], "x": {"y": None}}
    c = {**b, "rolls": [{"roll_id": "a", "w": 5}], "z": True}

    def frame(doc):
        return spark.createDataFrame([(1, json.dumps(doc))], "k int, doc string")
    assert parity.json_diff(frame(a), frame(b), "k", "doc").count() == 0
    assert rows(parity.json_diff(frame(a), frame(c), "k", "doc"), "path", "status", "source_value", "target_value") == [
        ("$.rolls[roll_id=a].w", "changed", "1", "5"), ("$.rolls[roll_id=b].roll_id", "removed", "b", ""),
        ("$.rolls[roll_id=b].w", "removed", "2", ""), ("$.z", "added", "", "true")]


def test_json_at_any_depth_and_by_type(spark, rows):
    def diff(a, b):
        one, other = (spark.createDataFrame([(1, x)], "k int, doc string") for x in (a, b))
        return rows(parity.json_diff(one, other, "k", "doc"), "path", "status", "source_type", "target_type", "source_value", "target_value")
    nest, end = '{"a":' * 300, "}" * 300
    assert diff(f'{nest}{{"x_at":1,"l":[{{"id":1}},{{"id":2}}]}}{end}', f'{nest}{{"l":[{{"id":2}},{{"id":1}}],"x_at":2}}{end}') == []
    assert diff(nest + "1" + end, nest + '"1"' + end) == [("$" + ".a" * 300, "changed", "number", "string", "1", "1")]
    assert diff('{"b":true}', '{"b":"true"}') == [("$.b", "changed", "boolean", "string", "true", "true")]
    assert diff('{"b":[],"c":{}}', "{}") == [("$", "added", "", "object", "", "{}"), ("$.b", "removed", "array", "", "[]", ""),
                                             ("$.c", "removed", "object", "", "{}", "")]
    assert diff('{"cut', '{"cu') == [("$", "changed", "text", "text", '{"cut', '{"cu')]
    assert diff("<p>2024-01-02T03:04:05Z", "<p>2025-01-02T03:04:05Z") == []
    assert diff("at 2024-01-02T03:04:05Z", "at 2025-01-02T03:04:05Z") == [] and diff("1", "1.0") == []


def paths(spark, a, b):
    one, other = (spark.createDataFrame([(1, x)], "k int, doc string") for x in (a, b))
    return parity.json_diff(one, other, "k", "doc").select("path", "status", "source_value", "target_value")


def test_json_paths_tell_places_and_numbers_apart(spark, rows):
    def diff(a, b):
        return rows(paths(spark, a, b))
    assert diff('{"a.b":1}', '{"a":{"b":1}}') == [("$.a.b", "added", "", "1"), ('$["a.b"]', "removed", "1", "")]
    assert diff('{"a":[1]}', '{"a[0]":1}') == [("$.a[0]", "removed", "1", ""), ('$["a[0]"]', "added", "", "1")]
    assert diff('{"a":1,"a":2}', '{"a":2}') == [("$.a", "changed", "1", "2"), ("$.a(2)", "removed", "2", "")]
    assert diff('{"a":1e999}', '{"a":2e999}') == [("$.a", "changed", "1e999", "2e999")]
    assert diff('{"a":[1.0,100,-0.50,1e2,0e9,12345678901234567890123]}', '{"a":[10e-1,1E2,-5e-1,100.00,0,12345678901234567890123.0]}') == []
    assert diff('{"a":12345678901234567890123}', '{"a":12345678901234567890124}') != [] and diff('{"a":1e99999999999999999999}', '{"a":2e99999999999999999999}') != []
    assert diff("null", "null ") == [] and diff("null", '"null"') == [("$", "changed", "null", "null")]


def test_json_lists_of_objects_without_a_name_are_multisets(spark, rows):
    def diff(a, b):
        return rows(paths(spark, json.dumps(a), json.dumps(b)))
    assert diff([{"w": 1}, {"w": 2, "l": [{"x": 1}, {"x": 2}]}], [{"l": [{"x": 2}, {"x": 1}], "w": 2}, {"w": 1}]) == []
    gone, = diff([{"w": 1}, {"w": 1}, {"w": 2}], [{"w": 2}, {"w": 1}])
    assert gone[1:] == ("removed", "1", "") and gone[0].startswith("$[*")
    # the same leaves, dealt to the elements in another way
    assert len(diff([{"a": 1, "b": 1}, {"a": 2, "b": 2}], [{"a": 1, "b": 2}, {"a": 2, "b": 1}])) == 8
    assert len(diff([{"id": 1, "a": 1, "b": 1}, {"id": 1, "a": 2, "b": 2}], [{"id": 1, "a": 1, "b": 2}, {"id": 1, "a": 2, "b": 1}])) > 0
    assert diff([{"id": "5", "v": 1}, {"id": 5, "v": 2}], [{"id": 5, "v": 2}, {"id": "5", "v": 3}]) == [('$[id="5"].v', "changed", "1", "3")]
    assert diff([1, 2], [2, 1]) == [("$[0]", "changed", "1", "2"), ("$[1]", "changed", "2", "1")]


def test_deep_json_is_one_leaf(spark, rows):
    deep = "[" * 200_000 + "]" * 200_000
    assert rows(paths(spark, deep, deep + " ")) == []
    (path, status, a, b), = rows(paths(spark, deep, "[" * 3_000 + "1" + "]" * 3_000))
    assert (path, status, len(a), len(b)) == ("$", "changed", 400_000, 6_001)
    assert rows(paths(spark, "[" * 1_900 + "1" + "]" * 1_900, "[" * 1_900 + "2" + "]" * 1_900)) == [("$" + "[0]" * 1_900, "changed", "1", "2")]


def test_json_null_and_missing_documents(spark, rows):
    a = spark.createDataFrame([(1, None), (2, '{"x":1}'), (3, "{}")], "k int, doc string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "[]")], "k int, doc string")
    assert rows(parity.json_diff(a, b, "k", "doc"), "k", "path", "status") == [(2, "$.x", "removed"), (3, "$", "removed"), (4, "$", "added")]


def test_text_patch_twice_changes_nothing(spark, rows):
    rules = [X.Rule("price", r"p_retailprice(?!_net)", "p_retailprice_net"), X.Rule("brand", "Brand#([0-9])", "Brand-$1")]
    df = spark.createDataFrame([(1, "p_retailprice"), (2, "p_retailprice_net"), (3, "Brand#1")], "id int, t string")
    once = textjobs.patch(df, "id", "t", rules, "#")
    assert rows(once, "id", "new_text") == [(1, "p_retailprice_net"), (3, "Brand-1")]
    assert textjobs.patch(once.select("id", F.col("new_text").alias("t")), "id", "t", rules, "#").count() == 0


def test_text_drift_forgives_serialiser_noise(spark, rows):
    a = spark.createDataFrame([(1, '<t a="1"><b></b></t>'), (2, "<p>x\n<br>"), (3, "<t>1</t>"), (4, "same")], "k int, x string")
    b = spark.createDataFrame([(1, "<t a='1'><b/></t>"), (2, "<p>x  \r\n<br>"), (3, "<t>2</t>")], "k int, x string")
    assert rows(textjobs.text_drift(a, b, "k", "x"), "k", "status", "changed_lines") == [
        (1, "OK", 0), (2, "OK", 0), (3, "DRIFT", 2), (4, "missing in target", 0)]


def test_kit_flip_restore_round_trip(spark, rows, tmp_path):
    boms, path = spark.createDataFrame([(1, "phantom"), (2, "normal"), (3, "phantom")], "product_id int, bom_type string"), str(tmp_path / "m")
    flipped = inventory.kit_flip(boms, path, "one")
    assert rows(flipped, "product_id", "bom_type") == [(1, "normal"), (2, "normal"), (3, "normal")]
    with pytest.raises(ValueError):
        inventory.kit_flip(boms, path, "two")
    assert rows(inventory.kit_restore(flipped.filter("product_id <> 3"), path, "back")) == [(1, "flipped"), (3, "missing")]
    assert rows(inventory.kit_restore(flipped, path, "back again")) == []
    # closed markers do not stand in the way of the next flip, and a run's id is used once
    inventory.kit_flip(boms, path, "three")
    with pytest.raises(Exception):
        versions.record(boms, path, "one")
    assert rows(versions.open_entries(spark, path, inventory.MARKED, ["product_id"]), "run_id", "product_id") == [("three", 1), ("three", 3)]


def test_preflight_of_each_kind_of_key(spark, rows):
    parent = spark.createDataFrame([(1,), (None,), (1,)], "k int")
    names = spark.createDataFrame([("a",), ("b",)], "k string")
    child = spark.createDataFrame([(1, 1, "a", "1", "2024-01-02"), (1, 1, "z", "x", "1700000000"), (2, 9, None, None, None), (None, None, "a", "2.5", "")],
                                  "id int, fk bigint, name string, n string, day string")
    audits = {"c": quality.Audit(child, ["id"], [("fk", parent, "k"), ("name", names, "k"), ("id", None, "x")], {"n": "INTEGER", "name": "TEXT"}, ["day"]),
              "text": quality.Audit(child, ["name", "n"], [], {}, []), "three": quality.Audit(child.limit(1), ["id", "fk", "name"]), "none": quality.Audit(child.limit(0), ["id"])}
    assert rows(quality.preflight(audits)) == [("c", 4, 2, 1, 1, 1, 1, "BLOCKER"), ("text", 4, 0, 0, 0, 0, 1, "BLOCKER"), ("three", 1, 0, 0, 0, 0, 0, "OK")]


def test_load_counts_while_it_writes(spark, rows, tmp_path):
    text = spark.createDataFrame([("1", "2024-01-02", "1.5", "{}"), ("x", "soon", "2", "{"), ("3", "", "n/a", None), ("4", None, "", "{")],
                                 "id string, day string, v string, j string")
    target = {"id": "bigint", "day": "date", "v": "double", "j": "json"}
    jobs = [load.Load("good", lambda: text, target), load.Load("gone", lambda: spark.read.parquet(str(tmp_path / "none")), target)]
    for run in ("a", "a", "b"):  # a run that is repeated writes over itself
        stats = load.load_all(spark, jobs, str(tmp_path / "load"), run)
    found = {r.table_name: r for r in stats.collect()}
    good = found["good"]
    assert (good.status, good.rows_read, good.rows_loaded, good.rows_rejected, good.bad_bigint, good.bad_date, good.bad_double, good.kept_malformed) == ("ok", 4, 2, 2, 1, 1, 1, 1)
    assert found["gone"].status == "failed" and found["gone"].rows_read == 0 and "none" in found["gone"].error
    typed = migrate.judged(text, target)[0].drop("text", "reason").schema
    assert rows(load.loaded(spark, str(tmp_path / "load"), "good", typed), "id", "v") == [(1, 1.5)] * 2 + [(4, None)] * 2
    refused = load.rejected(spark, str(tmp_path / "load"), "good").filter("run = 'a'")
    assert rows(refused.select(F.col("text")["id"], "reason")) == [("3", "v"), ("x", "id, day")]
    assert load.outcomes(spark, str(tmp_path / "load"), "gone").count() == 0


def test_packaging_plan(spark, rows):
    source = spark.createDataFrame([(1, "Roll", 70, 5, "C5"), (2, "Roll", 70, 6, "C6"), (3, "Roll", 1, 7, None), (4, "Case", 1, 5, "C5"), (5, "Roll", 9, 5, None)],
                                   "packaging_id int, name string, qty int, product_id int, code string")
    targets = spark.createDataFrame([(5, "C5"), (60, "C6"), (61, "C6")], "product_id int, code string")
    existing = spark.createDataFrame([(5, "Case")], "product_id int, name string")
    assert rows(migrate.packaging_plan(source, targets, existing), "packaging_id", "target_id", "action") == [
        (1, 5, "create"), (2, 60, "create"), (3, -1, "skip: no product"), (4, 5, "skip: exists"), (5, 5, "skip: exists")]


def test_sources_and_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert rows(search(df, F.col("id") > 1, ["v"], [F.desc("id")], 1)) == [("c",)]
    assert rows(by_ids(df, spark.createDataFrame([(1,), (1,)], "id int"), "id")) == [(1, "a")]
    assert missing_and_extra(df, spark.createDataFrame([], "id int, w string").schema) == (["w"], ["v"])
    sinks.append(df, df.limit(0), str(tmp_path / "t"))
    sinks.append(df, df.filter("id = 1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "rows")).count() == 6
    assert spark.read.parquet(str(tmp_path / "t" / "rejects")).count() == 1
    incoming = spark.createDataFrame([(1, "z"), (4, "d"), (4, "e")], "id int, v string")
    assert rows(sinks.merge_by_key(df, incoming, ["id"], ["v"])) == [(1, "z"), (2, "b"), (3, "c"), (4, "e")]
    assert rows(sinks.merge_by_key(df, incoming, ["id"], ["v"], "skip")) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    doc = {"snapshot_at": "now", "packagings": [{"id": 1, "name": "Roll", "product_id": 5, "qty": 70}], "saved_values": [{"name": "MO/1", "value": 2.5}]}
    path = tmp_path / "snapshot.json"
    path.write_text(json.dumps(doc, indent=1))
    packagings, values = read_snapshot(spark, str(path))
    assert rows(packagings, "id", "name", "qty") == [(1, "Roll", 70.0)] and rows(values) == [("MO/1", 2.5)]
    products = spark.createDataFrame([(5, "C5")], "product_id bigint, product_code string")
    sinks.write_snapshot(packagings.drop("product_code"), products, values, str(tmp_path / "snap"))
    again, _ = read_snapshot_folder(spark, str(tmp_path / "snap"))
    assert rows(again, "id", "product_code", "qty") == [(1, "C5", 70.0)]
    sinks.write_marker(df.select("id"), str(tmp_path / "m"), "r1")
    with pytest.raises(Exception):
        sinks.write_marker(df.select("id"), str(tmp_path / "m"), "r1")
    log = sinks.action_log(df, "id", F.col("v"), F.lit("done"), F.lit(""))
    sinks.write_report(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_volatile_suffix_option(spark):
    a = spark.createDataFrame([(1, '{"batch_attr":1,"seen_at":1}')], "k int, doc string")
    b = spark.createDataFrame([(1, '{"batch_attr":2,"seen_at":2}')], "k int, doc string")
    assert parity.json_diff(a, b, "k", "doc").count() == 0
    assert parity.json_diff(a, b, "k", "doc", suffix_only=True).select("path").collect() == [("$.batch_attr",)]


def test_newest_with_free_stock(spark, rows):
    made = spark.createDataFrame([(1, "L1"), (2, "L2"), (3, "L3")], "production_id int, lot string")
    quants = spark.createDataFrame([("L1", 9.0, None), ("L2", 3.0, None), ("L2", 1.0, None), ("L3", 9.0, "P"), ("L3", 3.0, None)],
                                   "lot string, quantity double, package_name string")
    assert rows(inventory.newest_with_free_stock(made, quants, 4.0), "production_id", "free") == [(2, 4.0)]


def test_row_diff_tells_values_apart_and_counts_copies(spark, rows):
    def diff(a, b):
        schema = "k int, x string, y string"
        return rows(parity.row_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k"))
    assert diff([(1, None, "a")], [(1, "NULL", "a")]) == [(1, "x", None, "NULL")]
    assert diff([(1, "p|y=q", "r")], [(1, "p", "q|y=r")]) == [(1, "x", "p|y=q", "p"), (1, "y", "r", "q|y=r")]
    assert diff([(1, "a", "b"), (1, "c", "d")], [(1, "c", "d"), (1, "a", "z")]) == [(1, "y", "b", "z")]
    assert diff([(1, "a", "b")] * 3, [(1, "a", "b")]) == [(1, "(row)", "present", "missing")] * 2


def test_window_parity_hashes_whole_rows_and_rows_without_time(spark, rows):
    schema = "id int, ts timestamp, v double, p string"
    data = [(1, datetime(2024, 1, 1, 0, 1), 1.0, "a"), (2, None, 1.0, "b"), (3, None, 1.0, "c")]
    a = spark.createDataFrame(data, schema)
    assert all(r[-1] for r in rows(parity.window_parity(a, a, "ts", "v")))
    changed = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 1), 1.0, "z"), *data[1:]], schema)
    assert [r[-1] for r in rows(parity.window_parity(a, changed, "ts", "v"), "window_start", "match")] == [True, False, False]
    short = spark.createDataFrame(data[:2], schema)
    assert rows(parity.window_parity(a, short, "ts", "v"), "window_start", "source_n", "target_n", "match")[0] == ("(no time)", 2, 1, False)


def test_hashing_a_document_does_not_grow_with_equal_names(monkeypatch):
    """Field names are looked at once, and whole numbers need no decimal; the hash is the one it always was."""
    from plantledger.functions import trees

    looked = []
    volatile = type("Volatile", (), {"search": lambda self, name: looked.append(name)})()
    monkeypatch.setattr(trees, "Decimal", None)
    found = [trees.tree('{"a": [{"id": %d, "b": 12}, {"id": 7, "b": "x"}]}' % i, volatile, ("id",)).digest() for i in (1, 2, 3)]
    assert len(set(found)) == 3 and sorted(looked) == ["a", "b", "id"]
    monkeypatch.undo()
    assert [trees.plain_number(n) for n in ("-0", "0", "00", "120", "9" * 25 + "0", "1.50", "1e2")] == ["0", "0", "0", "120", "9" * 25 + "0", "1.5", "100"]
