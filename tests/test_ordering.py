"""Ordering over slices gives what a plain window gives."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantledger.operators import ordering as O
from plantledger.operators import pallets


@pytest.fixture(scope="module", autouse=True)
def many_slices(spark):
    """Adaptive execution would merge this little data into one slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_heavy_group_spans_slices(skewed):
    sliced = O._sliced(skewed, ["k"], ["ts", "id"])
    assert sliced.cut
    sizes = dict(sliced.rows.filter("k = 'hot'").groupBy(O.SLICE).count().collect())
    assert len(sizes) >= 6 and max(sizes.values()) < 900
    assert sliced.rows.filter("k <> 'hot' and k is not null").select(O.SLICE).distinct().count() == 1


def test_equal_first_columns_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.lit("WH/MO/").alias("lot"), F.lit(None).cast("int").alias("n"), "id")
    numbered = O.number_rows(df, ["k"], ["lot", "-n", "-id"])
    spread = numbered.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(spread) >= 6 and max(r["count"] for r in spread) < 10_000
    assert numbered.filter("row_no <> 20000 - id").count() == 0


def test_the_input_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(3000).select((F.col("id") % 2).alias("k"), "id").mapInArrow(passed, "k long, id long")
    assert O.number_rows(df, ["k"], ["id"]).filter("row_no = 1500").count() == 2
    assert seen.value == 3000


def test_running_sums(skewed, rows):
    order = W.partitionBy("k").orderBy(*O._sort(["-ts", "id"])).rowsBetween(W.unboundedPreceding, 0)
    odd = F.col("id") % 2
    plain = skewed.select("k", "id", F.sum(F.lit(1)).over(order).alias("n"), F.sum(odd).over(order).alias("odd"))
    assert rows(O.running_sums(skewed, ["k"], ["-ts", "id"], {"n": F.lit(1), "odd": odd}), "k", "id", "n", "odd") == rows(plain)


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(3)
    data = [("hot" if random.random() < 0.6 else (None if random.random() < 0.1 else f"k{random.randint(0, 9)}"),
             random.randint(0, 400), i, float(i % 17)) for i in range(6000)]
    df = spark.createDataFrame(data, "k string, ts int, id int, v double").withColumns({
        "ts": F.expr("nullif(ts, 77)"), "name": F.expr("case when id % 11 > 0 then substring(md5(string(ts)), 1, 5) end"),
        "at": F.expr("timestamp_seconds(1700000000 + ts * 7919)"), "pair": F.expr("case when ts % 9 > 0 then struct(ts, name) end")})
    return df.repartition(5).cache()


ORDERS = [["ts", "id"], ["-ts", "id"], ["ts", "-id"], ["-v", "-ts", "id"], ["name", "id"], ["-name", "id"], ["at", "id"], ["pair", "id"]]


@pytest.mark.parametrize("order", ORDERS)
def test_number_rows(skewed, rows, order):
    plain = skewed.withColumn("row_no", F.row_number().over(W.partitionBy("k").orderBy(*O._sort(order))))
    assert rows(O.number_rows(skewed, ["k"], order), "k", "id", "row_no") == rows(plain, "k", "id", "row_no")


@pytest.mark.parametrize("order", ORDERS)
def test_with_previous(skewed, rows, order):
    plain = skewed.withColumn("previous", F.lag(F.struct("v", "id")).over(W.partitionBy("k").orderBy(*O._sort(order))))
    assert rows(O.with_previous(skewed, ["k"], order, ["v", "id"]), "k", "id", "previous") == rows(plain, "k", "id", "previous")


def test_latest(skewed, rows):
    got = O.latest(skewed, ["k"], ["ts", "id"])
    ranked = skewed.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy(F.desc("ts"), F.desc("id"))))
    assert rows(got, "k", "ts", "id", "v") == rows(ranked.filter("n = 1"), "k", "ts", "id", "v")


def test_text_list_pages(spark, rows):
    df = spark.createDataFrame([("a", x) for x in "edcba"] + [("a", "a"), ("a", None), ("b", "z")], "k string, v string")
    assert rows(O.text_list(df, ["k"], "v", "t", 2)) == [("a", 1, "a, b"), ("a", 2, "c, d"), ("a", 3, "e"), ("b", 1, "z")]


def test_amounts_stand_on_the_first_page(spark, rows):
    units = spark.createDataFrame([("a", i * 2) for i in range(25)], "k string, n int")
    assert rows(pallets.unit_ranges(units, ["k"], "n", 10), "page", "n_units", "n_runs") == [(1, 25, 25), (2, None, None), (3, None, None)]


def test_no_rows(spark):
    for empty in (spark.createDataFrame([], "k int, n int"), spark.range(5).selectExpr("id k", "id n").filter("false")):
        assert O.number_rows(empty, ["k"], ["n"]).count() == 0 and O.with_previous(empty, ["k"], ["n"], ["n"]).count() == 0


def test_a_task_orders_a_bounded_number_of_rows(spark, monkeypatch):
    """Keys without a heavy one: partitions follow the rows, whatever adaptive execution would join."""
    monkeypatch.setattr("plantledger.session.TASK_ROWS", 100)
    units = spark.range(4_000).select((F.col("id") % 1_000).alias("k"), (F.floor(F.col("id") / 1_000) * 2).cast("int").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        sliced = O._sliced(units, ["k"], ["n"])
        sizes = [r["count"] for r in sliced.rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(sizes) >= 30 and max(sizes) < 300
        assert pallets.unit_ranges(units, ["k"], "n").select("units", "n_units").distinct().collect() == [("0, 2, 4, 6", 4)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def test_a_cut_key_beside_a_column_named_at(skewed):
    """The column of the earlier sums had that name, which failed wherever a key was cut."""
    named = skewed.withColumn("_at", F.col("id"))
    assert O._sliced(named, ["k"], ["ts", "id"]).cut
    assert O.number_rows(named, ["k"], ["ts", "id"]).filter("k = 'hot'").agg(F.count_distinct("row_no") == F.max("row_no")).first()[0]
