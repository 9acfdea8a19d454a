"""Expressions against hand-worked values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plantledger.functions import quantities as Q
from plantledger.functions import text as X
from plantledger.functions import values as V


def one(spark, values, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]


def test_batch_of(spark):
    lots = ["WH/MO/01547-U1270", "WH/MO/01547-R3", "MO/00592-001", "WH/MO/01220", "A-B-C", None]
    got = one(spark, [(x,) for x in lots], "lot string", X.batch_of(F.col("lot")))
    assert [g[0] for g in got] == ["WH/MO/01547", "WH/MO/01547", "MO/00592", "WH/MO/01220", "A-B", None]


def test_pallet_names(spark):
    names = ["WH/MO/01516-PAL-2", "WH/MO/01516-PAL-10", "PLT-7", "X-PAL-b", "A-PAL-1-PAL-3", "Y-PAL-12345678901234567890"]
    got = one(spark, [(x,) for x in names], "p string", X.pallet_prefix(F.col("p")), X.pallet_number(F.col("p")),
              X.display_id(F.col("p")))
    none = int(X.NO_NUMBER)
    assert got == [("WH/MO/01516", 2, "01516-PAL-2"), ("WH/MO/01516", 10, "01516-PAL-10"), ("PLT-7", none, "PLT-7"),
                   ("X", none, "X-PAL-b"), ("A-PAL-1", 3, "A-PAL-1-PAL-3"), ("Y", 12345678901234567890, "Y-PAL-12345678901234567890")]


def test_pieces(spark):
    lines = [(70.0, "lb", None), (0.4, "Case", None), (2.5, "Case", None), (24.0, "Thousands", 250), (24.0, "Thousands", None),
             (2.0, "Million", 1000), (24.0, "Thousands", 0), (None, "Roll", None), (12.0, "Feet", 9), (3.5, "Roll", None)]
    got = one(spark, lines, "q double, u string, c bigint", Q.pieces_of(F.col("q"), F.col("u"), F.col("c")))
    assert [g[0] for g in got] == [1, 1, 2, 96, 1, 2000, 1, 1, 1, 4]


def test_number_text_matches_general_format(spark):
    random.seed(7)
    values = [0.0, 1.0, 96.0, 0.5, 1e6, 999999.0, 123456.7, 1234567.0, 1e-5, 0.0001, -2.5, 1e20, 100.0, 12.3456789, 1234565.0, 100000.5, 0.1234565, 100001.5, -1234575.0]
    values += [random.uniform(-1, 1) * 10 ** random.randint(-6, 9) for _ in range(300)]
    got = one(spark, [(v,) for v in values], "x double", F.col("x"), X.number_text(F.col("x")))
    for value, text in got:
        assert text == f"{value:g}", value


def test_text_helpers(spark):
    got = one(spark, [("a\nb\nc", "A,b, c", "postgres://user:secret@host/db", "a/b c")], "t string, l string, u string, s string",
              X.first_line(F.col("t")), X.other_lines(F.col("t")), X.drop_items(F.col("l"), ["b"]),
              X.mask_password(F.col("u")), X.safe_token(F.col("s")))
    assert got == [("a", "b\nc", "A, c", "postgres://user:***@host/db", "a_b_c")]
    got = one(spark, [("a\nb\n", "x://u:p@ss@h/p@q")], "t string, u string", X.other_lines(F.col("t")), X.mask_password(F.col("u")))
    assert got == [("b", "x://u:***@h/p@q")]
    got = one(spark, [("only",), (None,)], "t string", X.first_line(F.col("t")), X.other_lines(F.col("t")))
    assert got == [("only", ""), ("", "")]


def test_dims_money_weight(spark):
    got = one(spark, [(40.0, 48.0, 52.0, 5355.0)], "l double, w double, h double, m double",
              X.dims_text(F.col("l"), F.col("w"), F.col("h")), X.money_text(F.col("m")), X.weight_text(F.col("l")))
    assert got == [("40 x 48 x 52", "5,355.00", "40.0")]
    got = one(spark, [(40.0, None, 52.0, 0.25), (None, None, None, None), (None, 1.0, None, 0.0), (1.0, 2.0, 3.0, 0.35)], "l double, w double, h double, g double",
              X.dims_text(F.col("l"), F.col("w"), F.col("h")), X.weight_text(F.col("g")))
    assert got == [("40 x - x 52", "0.2"), ("-", "-"), ("- x 1 x -", "-"), ("1 x 2 x 3", "0.4")]


def test_scrub_times(spark):
    got = one(spark, [(' {"a":"2026-05-01T10:00:00.5Z","b":1} ',), ("seen 2026-05-01T10:00:00, not 2026-05-01 or x2026-05-01T10:00:00",)], "t string",
              X.scrub_times(F.col("t")))
    assert got == [('{"a":"(time)","b":1}',), ("seen (time), not 2026-05-01 or x2026-05-01T10:00:00",)]


@pytest.mark.parametrize("text, kind", [
    ("2024-01-02T03:04:05Z", "iso_z"), ("2024-01-02T03:04:05.123", "iso_no_z"), ("2024-01-02 03:04:05", "sql_space"),
    ("2024-01-02", "date_only"), ("1704164645", "epoch_seconds"), ("1704164645000", "epoch_ms"), ("", "unknown"),
    ("01/02/2024", "unknown"), (None, None)])
def test_date_class(spark, text, kind):
    assert one(spark, [(text,)], "t string", V.date_class(F.col("t"))) == [(kind,)]


def test_parse_date(spark):
    texts = ["2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05", "2024-01-02 03:04:05.123456", "2024-01-02", "1704164645", "", "x",
             "2024-02-31", "2024-01-02 03:04:05Z"]
    got = one(spark, [(t,) for t in texts], "t string", F.date_format(V.parse_date(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSS"))
    assert [g[0] for g in got] == ["2024-01-02 03:04:05.500", "2024-01-02 03:04:05.000", "2024-01-02 03:04:05.123",
                                   "2024-01-02 00:00:00.000", None, None, None, None, None]


def test_flags_and_json(spark):
    got = one(spark, [(t,) for t in ["0", "1", "", "false", "yes", None]], "t string", V.to_bool(F.col("t")))
    assert [g[0] for g in got] == [False, True, None, False, True, None]
    got = one(spark, [('{"a":{"b":"x"}}',), ('{"a":',), ("",), (None,)], "t string", V.json_malformed(F.col("t")),
              V.json_field(F.col("t"), "$.a.b"))
    assert got == [(False, "x"), (True, None), (False, None), (False, None)]


def test_storage_and_hints(spark):
    got = one(spark, [(t,) for t in ["5", "-5", "5.0", "1e3", ".5", "n/a", "", None]], "t string", V.storage_class(F.col("t")))
    assert [g[0] for g in got] == ["integer", "integer", "real", "real", "real", "text", "text", None]
    assert V.accepted_storage("varchar(255)") == ("text",) and V.accepted_storage("GEOMETRY") == ()
    assert V.date_columns({"created_at": "TEXT", "name": "TEXT", "x": "timestamp(6)", "start_time": "INTEGER", "day": ""}) == ["created_at", "x", "day"]


def test_rules_count_and_rewrite(spark):
    rules = [X.Rule("price", r"p_retailprice(?!_net)", "p_retailprice_net"), X.Rule("brand", "Brand#([0-9])", "Brand-$1")]
    text, hits = X.apply_rules(F.col("t"), rules)
    got = one(spark, [("p_retailprice",), ("p_retailprice_net",), ("Brand#1 Brand#23",)], "t string", text, *hits)
    assert got == [("p_retailprice_net", 1, 0), ("p_retailprice_net", 0, 0), ("Brand-1 Brand-23", 0, 2)]


def test_pack_arithmetic(spark):
    got = one(spark, [(3500.0, 70.0, 16.25)], "q double, r double, c double", Q.full_rolls(F.col("q"), F.col("r")),
              Q.pallets_for(Q.full_rolls(F.col("q"), F.col("r")), F.lit(25)), Q.scale(F.col("q"), F.col("r")) * F.col("c"))
    assert got == [(50, 2, 812.5)]
    assert math.isclose(got[0][2], 812.5)
