"""Replication in several batches equals one load; a batch that runs twice changes nothing."""

import pytest
from pyspark.sql import functions as F

from plantledger.operators.ordering import latest
from plantledger.streaming import replicate as R
from plantledger.operators import parity
from plantledger.streaming import queue, watch, windows

ORDER = ["ts", "id"]


@pytest.fixture
def feed(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 13).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("ts"),
                                 "id", (F.col("id") * 2).alias("v"))
    for i in range(4):
        df.filter((F.col("id") >= i * 100) & (F.col("id") < (i + 1) * 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed" / f"part={i}"))
    return df, str(tmp_path / "feed" / "part=*"), str(tmp_path / "table")


def stream_of(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("policy", ["update", "skip"])
def test_batches_equal_one_load(spark, rows, feed, policy):
    df, source, path = feed
    R.replicate(stream_of(spark, df, source), path, ["k"], ORDER, policy)
    got = rows(R.read_table(spark, path, df.schema, ["k"], ORDER, policy))
    if policy == "update":
        assert got == rows(latest(df, ["k"], ORDER))
    else:
        assert got == rows(latest(df.filter("id < 100"), ["k"], ORDER, newest=False))
    assert R.state(spark, path).select("rows_last", "rows_total").first() == (100, 400)
    # nothing new arrives: a second run changes nothing
    R.replicate(stream_of(spark, df, source), path, ["k"], ORDER, policy)
    assert rows(R.read_table(spark, path, df.schema, ["k"], ORDER, policy)) == got
    R.compact(spark, path, path + "-base", df.schema, ["k"], ORDER, 1, policy)
    assert rows(R.read_table(spark, path, df.schema, ["k"], ORDER, policy, base=path + "-base", upto=1)) == got


def test_unknown_policy(spark, feed):
    df, source, path = feed
    with pytest.raises(ValueError):
        R.replicate(stream_of(spark, df, source), path, ["k"], ORDER, "merge")


SNAPS = "k string, at timestamp, id long, v string, w int"


class Watched:
    """A watch that is fed row by row and started anew for each delivery."""

    def __init__(self, spark, path, lateness, silence=0):
        self.spark, self.path, self.lateness, self.silence, self.n = spark, str(path), lateness, silence, 0
        self.schema = spark.createDataFrame([], SNAPS).schema

    def deliver(self, *given):
        rows = [(k, at, i, v, None if v is None else len(v)) for k, at, i, v in given]
        df = self.spark.createDataFrame(rows, "k string, s int, id long, v string, w int").select(
            "k", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "id", "v", "w")
        df.coalesce(1).write.parquet(f"{self.path}/in/part={self.n}")
        self.n += 1
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in/part=*")
        watch.watch(stream, f"{self.path}/out", "k", "at", ["id"], ["v", "w"], f"{self.lateness} seconds", self.silence)
        return self.changes()

    def changes(self):
        found = self.spark.read.parquet(f"{self.path}/out/changes")
        return sorted(((r.k, int(r.at.timestamp()) - 1_700_000_000, r.id, r.field, r.old_value, r.new_value) for r in found.collect()), key=repr)


def test_watch_orders_late_snapshots_and_leaves_out_later_ones(spark, tmp_path):
    seen = Watched(spark, tmp_path, 20)
    assert seen.deliver(("a", 0, 1, "x"), ("a", 30, 2, "zz"), ("b", 5, 3, "q")) == []  # the watermark stands at 10
    # 15 is late and allowed, 8 is too late and moves nothing back
    assert seen.deliver(("a", 15, 4, "y"), ("a", 8, 5, "never"), ("b", 40, 6, None)) == [("a", 15, 4, "v", "x", "y")]
    assert seen.deliver((None, 70, None, None)) == sorted([
        ("a", 15, 4, "v", "x", "y"), ("a", 30, 2, "v", "y", "zz"), ("a", 30, 2, "w", "1", "2"),
        ("b", 40, 6, "v", "q", None), ("b", 40, 6, "w", "1", None)], key=repr)


def test_watch_tells_silence_once(spark, tmp_path):
    seen = Watched(spark, tmp_path, 5, silence=50)
    seen.deliver(("a", 0, 1, "x"), ("b", 40, 2, "q"))
    assert seen.deliver((None, 60, None, None)) == [("a", 0, 1, "(silent)", None, None)]
    assert seen.deliver((None, 70, None, None)) == [("a", 0, 1, "(silent)", None, None)]
    # back after a silence that was told; b's silence ends with its next snapshot in the same batch
    assert seen.deliver(("a", 80, 3, "y"), ("b", 90, 4, "q"), (None, 100, None, None)) == sorted([
        ("a", 0, 1, "(silent)", None, None), ("a", 80, 3, "v", "x", "y"), ("b", 40, 2, "(silent)", None, None)], key=repr)


def test_watch_equals_batch_deltas_over_restarts(spark, rows, tmp_path):
    seen, given = Watched(spark, tmp_path, 1000), []
    for part in range(3):
        some = [(f"k{i % 7}", (i * 37) % 300, i, "xyz"[:(i * i) % 4]) for i in range(part * 60, part * 60 + 60)]
        given += some
        seen.deliver(*some)
    got = seen.deliver((None, 5000, None, None))
    whole = spark.createDataFrame(given, "k string, at int, id long, v string").withColumn("w", F.length("v"))
    assert got == sorted((tuple(r) for r in watch.state_deltas(whole, "k", ["at", "id"], ["v", "w"]).collect()), key=repr)


def test_cycle_over_several_tables(spark, rows, feed, tmp_path):
    df, source, _ = feed
    path, whole = str(tmp_path / "cycle"), df.select("k", "id")
    some = {0: whole.filter("id < 300"), 1: whole.filter("id >= 5")}
    for number in (0, 1):
        replicas = [R.Replica("moved", lambda: stream_of(spark, df, source), ["k"], ORDER),
                    R.Replica("first", lambda: stream_of(spark, df, source), ["k"], ORDER, "skip"),
                    R.Replica("whole", lambda n=number: some[n], ["id"], policy="refresh"),
                    R.Replica("broken", lambda: stream_of(spark, df, source), ["k"], ["no_such_column"])]
        state = R.cycle(spark, replicas, path, number)
    found = {r.table_name: r for r in state.collect()}
    assert {n: r.status for n, r in found.items()} == {"moved": "ok", "first": "ok", "whole": "ok", "broken": "failed"}
    assert (found["moved"].rows_last, found["moved"].rows_total, found["moved"].watermark) == (100, 400, "49")
    assert (found["whole"].rows_last, found["whole"].rows_total, found["whole"].deleted) == (395, 695, 5)
    assert "no_such_column" in found["broken"].error and found["broken"].rows_total == 0
    assert rows(R.replica_rows(spark, replicas[0], path, df.schema, 1)) == rows(latest(df, ["k"], ORDER))
    assert rows(R.replica_rows(spark, replicas[2], path, whole.schema, 1)) == rows(some[1])


def test_a_refresh_that_fails_leaves_the_last_snapshot(spark, rows, tmp_path):
    path, good = str(tmp_path / "cycle"), spark.range(5)
    bad = spark.range(5).withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("gone")).cast("bigint")).otherwise(F.col("id")))
    for number, df in enumerate((good, bad)):
        replica = R.Replica("t", lambda d=df: d, ["id"], policy="refresh")
        state = R.cycle(spark, [replica], path, number).first()
    assert state.status == "failed" and "gone" in state.error and state.rows_total == 5
    assert rows(R.replica_rows(spark, replica, path, good.schema, 1)) == rows(good)


def test_deleted_keys(spark, rows):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(R.deleted_keys(a, b, ["k"])) == [(2,)]


def test_window_parity_of_streams(spark, rows, tmp_path):
    schema = "id long, ts timestamp, v double, note string"
    paths = [str(tmp_path / side) for side in ("source", "target")]
    out = str(tmp_path / "out")

    def deliver(n, *sides):
        for path, given in zip(paths, sides):
            spark.createDataFrame(given, "id long, s int, v double, note string").select(
                "id", F.timestamp_seconds(F.col("s") + 1_700_000_100).alias("ts"), "v", "note").coalesce(1).write.parquet(f"{path}/part={n}")
        a, b = (spark.readStream.schema(schema).parquet(f"{path}/part=*") for path in paths)
        windows.window_parity_stream(a, b, out, "id", "ts", "v", "600 seconds")
        return {(r.window_start[-8:], r.source_n, r.target_n, r.match) for r in windows.read_windows(spark, out).collect()}

    rows_0 = [(1, 0, 1.0, "x"), (2, 400, 2.0, None), (3, None, 3.0, "n")]
    untimed = {("no time)", 1, 0, False)}
    assert deliver(0, rows_0, rows_0[:1]) == untimed
    # the target is behind and holds the windows back, so that 2 still counts there; it lacks the row without a time
    early = {("22:10:00", 1, 1, True), ("22:15:00", 2, 2, True), ("22:20:00", 1, 1, True)}
    assert deliver(1, [(4, 2400, 1.0, "y")], [(2, 400, 2.0, None), (4, 2400, 1.0, "z")]) == untimed | early
    # 5 comes after its windows were told
    late = {("22:50:00", 1, 1, False), ("22:55:00", 1, 1, False)}
    assert deliver(2, [(None, 9000, None, None)], [(None, 9000, None, None), (5, 10, 9.0, "")]) == untimed | early | late


def test_window_parity_of_streams_equals_the_tables(spark, tmp_path):
    df = spark.range(300).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37).alias("ts"), (F.col("id") % 7).cast("double").alias("v"))
    other = df.filter("id % 11 > 0").withColumn("v", F.when(F.col("id") % 13 == 0, -1.0).otherwise(F.col("v")))
    poll = spark.range(1).select(F.lit(None).cast("long").alias("id"), F.timestamp_seconds(F.lit(1_700_100_000)).alias("ts"), F.lit(None).cast("double").alias("v"))
    sides, out = [str(tmp_path / s) for s in "ab"], str(tmp_path / "out")
    for n, some in enumerate((F.col("id") % 2 == 0, F.col("id") % 2 == 1, None)):
        for path, side in zip(sides, (df, other)):
            (poll if some is None else side.filter(some)).coalesce(1).write.parquet(f"{path}/part={n}")
        streams = [spark.readStream.schema(df.schema).parquet(f"{path}/part=*") for path in sides]
        windows.window_parity_stream(*streams, out, "id", "ts", "v", "12000 seconds")
    want = parity.window_parity(df, other, "ts", "v")
    assert sorted(map(tuple, windows.read_windows(spark, out).collect())) == sorted(map(tuple, want.collect()))


def test_queue_state_leaves_with_the_last_word(spark, tmp_path):
    schema = "job_id long, entity string, status string, retries int, updated_at timestamp"

    def deliver(n, *given):
        spark.createDataFrame(given, "job_id long, entity string, status string, retries int, s int").select(
            "job_id", "entity", "status", "retries", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("updated_at")).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        queue.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*"), str(tmp_path / "out"), "10 seconds", 100)
        found = {r.entity: (r.job_id, r.status, r.retries, r.terminal, r.stalled) for r in queue.current(spark, str(tmp_path / "out"), "string").collect()}
        assert spark.read.parquet(str(tmp_path / "out/changes")).count() == changes[n]
        return found

    changes = [2, 4, 5, 6]
    assert deliver(0, (1, "a", "pending", 0, 0), (2, "b", "done", 1, 5)) == {"a": (1, "pending", 0, False, False), "b": (2, "done", 1, True, False)}
    # an older job of a that comes late changes nothing
    assert deliver(1, (0, "a", "done", 9, 1), (4, "a", "permanently_failed", 3, 30), (5, "c", "pending", None, 30), (None, None, None, None, 50))["a"] == (4, "permanently_failed", 3, True, False)
    # all are over their time: a and b leave, c is told as stalled
    assert deliver(2, (None, None, None, None, 500))["c"] == (5, "pending", None, False, True)
    # b is back with a new job
    assert deliver(3, (9, "b", "pending", 0, 600))["b"] == (9, "pending", 0, False, False)
