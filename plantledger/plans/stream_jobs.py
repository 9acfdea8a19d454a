"""Replication, lag, queue and watch queries; the feed is events cut into slices that arrive one by one."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plantledger.plans.proof_jobs import WINDOWS_SQL, parity_sides
from plantledger.plans.registry import job
from plantledger.session import fresh_path
from plantledger.sources import standins as S
from plantledger.sources.tables import table
from plantledger.streaming import queue
from plantledger.streaming import replicate as R
from plantledger.streaming import watch as watching
from plantledger.streaming.windows import read_windows, window_parity_stream

SLICES = 3
#: Rows of a file of the feed, and files a micro-batch takes; both bound a micro-batch whatever the table holds.
FILE_ROWS, FILES = 1_000_000, 64
FEED_SQL = f"""feed AS (
  SELECT *, CASE WHEN event_id % 97 <> 0 THEN date_trunc('minute', ts) END AS changed_at,
    (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {SLICES} // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) AS slice FROM events)"""
WHOLE_SQL = "user_id, event_id, event_type, value, props, ts, coalesce(strftime(changed_at, '%Y-%m-%d %H:%M'), '') AS changed_at"


def _spanned(rows, time):
    """The rows with the slice each arrives in, equal spans of the table's own time, and the ends of that time in microseconds."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    low, high = low or 0, high or 0
    return rows.withColumn("slice", F.coalesce(F.floor((at - low) * SLICES / (high - low + 1)), F.lit(0)).cast("int")), low, high


def _in_slices(spark, feeds, key, run, slices=SLICES):
    """Write the feeds slice by slice; after each slice ``run`` takes their streams up where it had stopped.

    The rows of a key stand in one file of a slice, and so reach one micro-batch.
    """
    paths = [fresh_path(spark, "feed") for _ in feeds]
    sizes = [dict(feed.groupBy("slice").count().collect()) for feed in feeds]
    for i in range(slices):
        for feed, path, size in zip(feeds, paths, sizes):
            files = max(1, -(-size.get(i, 0) // FILE_ROWS))
            feed.filter(F.col("slice") == i).drop("slice").repartition(files, key).write.parquet(f"{path}/part={i}")
        run(*(spark.readStream.schema(feed.drop("slice").schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/part=*") for feed, path in zip(feeds, paths)))


def _with_late_rows(spark, rows, key, time):
    """The rows as a feed in which some come a slice late, closed by a poll that moves the watermark behind the last row;
    and the lateness, in seconds, that allows for it."""
    feed, low, high = _spanned(rows, time)
    late = F.least(F.col("slice") + 1, F.lit(SLICES - 1))
    feed = feed.withColumn("slice", F.when(F.col(key) % 29 == 0, late).otherwise(F.col("slice")))
    lateness = 2 * (high - low) // SLICES // 1_000_000 + 1
    polled = F.timestamp_micros(F.lit((high // 1000 + 1) * 1000 + lateness * 1_000_000)).cast("timestamp_ntz")
    poll = spark.range(1).select(*(F.lit(None).cast(kind).alias(c) for c, kind in feed.drop("slice").dtypes if c != time),
                                 polled.alias(time)).withColumn("slice", F.lit(SLICES))
    return feed.unionByName(poll), lateness


def _replicated(spark, folder, policy):
    """events as a feed whose watermark is a minute (ties), some of them missing; rows are carried whole."""
    path = fresh_path(spark, "table")
    order = ["changed_at", "event_id"]
    feed, _, _ = _spanned(table(spark, folder, "events"), "ts")
    feed = feed.withColumn("changed_at", F.when(F.col("event_id") % 97 != 0, F.date_trunc("minute", "ts").cast("timestamp_ntz")))
    _in_slices(spark, [feed], "user_id", lambda stream: R.replicate(stream, path, ["user_id"], order, policy))
    current = R.read_table(spark, path, feed.drop("slice").schema, ["user_id"], order, policy)
    return current.withColumn("changed_at", F.coalesce(F.date_format("changed_at", "yyyy-MM-dd HH:mm"), F.lit("")))


@job(f"""WITH {FEED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY changed_at DESC NULLS LAST, event_id DESC) AS n FROM feed)
SELECT {WHOLE_SQL} FROM r WHERE n = 1""")
def q_replicate(spark, folder):
    return _replicated(spark, folder, "update")


@job(f"""WITH {FEED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slice, changed_at NULLS FIRST, event_id) AS n FROM feed)
SELECT {WHOLE_SQL} FROM r WHERE n = 1""")
def q_replicate_skip(spark, folder):
    return _replicated(spark, folder, "skip")


@job("""WITH a AS (SELECT event_type, max(ts) AS w, count(*) AS n FROM events GROUP BY event_type),
b AS (SELECT event_type, max(ts) AS w, count(*) AS n FROM events
  WHERE (event_type <> 'error' OR ts < TIMESTAMP '2024-01-30') AND event_type <> 'signup' GROUP BY event_type),
j AS (
  SELECT a.event_type AS table_name, strftime(a.w, '%Y-%m-%d %H:%M:%S') AS source_watermark, coalesce(strftime(b.w, '%Y-%m-%d %H:%M:%S'), '') AS target_watermark,
    coalesce(CAST(floor(epoch(a.w)) - floor(epoch(b.w)) AS BIGINT), -1) AS lag_seconds, a.n AS source_rows, coalesce(b.n, 0) AS rows_copied
  FROM a LEFT JOIN b ON a.event_type = b.event_type)
SELECT *, lag_seconds >= 0 AND lag_seconds < 90 AS within_limit FROM j""")
def q_replication_lag(spark, folder):
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    copied = events.filter(((kind != "error") | (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz"))) & (kind != "signup"))
    return R.replication_lag(events, copied, "event_type", "ts")


QUEUE_SQL = """SELECT entity, arg_max(job_id, job_id) AS job_id, arg_max(status, job_id) AS status, arg_max(retries, job_id) AS retries,
  strftime(arg_max(updated_at, job_id), '%Y-%m-%d %H:%M:%S') AS updated_at, arg_max(status, job_id) IN ('done', 'permanently_failed') AS terminal
FROM queue GROUP BY entity"""


@job(QUEUE_SQL, "queue")
def q_queue_state(spark, folder):
    state = R.queue_state(S.queue(spark, folder))
    return state.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


#: A job that has not moved for so many seconds is over or stalled.
QUEUE_TIMEOUT = 86_400


@job(QUEUE_SQL.replace("\nFROM", """,
  arg_max(status, job_id) NOT IN ('done', 'permanently_failed') AND arg_max(epoch_us(updated_at), job_id) + 86400000000
    <= (SELECT (max(epoch_us(updated_at)) // 1000 + 1) * 1000 FROM queue) AS stalled\nFROM"""), "queue")
def q_queue_stream(spark, folder):
    """The rows of ``q_queue_state`` from a stream in which some jobs come a slice late; a finished entity leaves the state after a day."""
    jobs = S.queue(spark, folder)
    feed, lateness = _with_late_rows(spark, jobs, "job_id", "updated_at")
    path = fresh_path(spark, "queue")
    _in_slices(spark, [feed], "entity", lambda stream: queue.follow(stream, path, f"{lateness} seconds", QUEUE_TIMEOUT), SLICES + 1)
    state = queue.current(spark, path, dict(jobs.dtypes)["entity"])
    return state.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


DELTAS_SQL = """WITH p AS (
  SELECT user_id, event_id, event_type, CAST(value AS VARCHAR) AS value, lag(event_type) OVER w AS type_before,
    lag(CAST(value AS VARCHAR)) OVER w AS value_before, lag(event_id) OVER w AS id_before
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, 'event_type' AS field, type_before AS old_value, event_type AS new_value FROM p
WHERE id_before IS NOT NULL AND type_before IS DISTINCT FROM event_type
UNION ALL SELECT user_id, event_id, 'value', value_before, value FROM p WHERE id_before IS NOT NULL AND value_before IS DISTINCT FROM value"""


@job(DELTAS_SQL)
def q_state_deltas(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return watching.state_deltas(events, "user_id", ["ts", "event_id"], ["event_type", "value"]).drop("ts")


#: An entity that stays silent for so many seconds is told once.
SILENCE = 3 * 86_400
WATCH_SQL = DELTAS_SQL + f"""
UNION ALL SELECT user_id, event_id, '(silent)', NULL, NULL FROM (
  SELECT user_id, event_id, epoch_us(ts) AS seen, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_at,
    (max(epoch_us(ts)) OVER () // 1000 + 1) * 1000 AS polled FROM events)
WHERE seen + {SILENCE}000000 <= coalesce(next_at, polled)"""


@job(WATCH_SQL)
def q_state_watch(spark, folder):
    """Some rows come a slice late, which the stated lateness allows for; a poll at the end moves the watermark behind the last row."""
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    feed, lateness = _with_late_rows(spark, events, "event_id", "ts")
    path = fresh_path(spark, "watch")
    _in_slices(spark, [feed], "user_id", lambda stream: watching.watch(
        stream, path, "user_id", "ts", ["event_id"], ["event_type", "value"], f"{lateness} seconds", SILENCE), SLICES + 1)
    text = [StructField(c, StringType()) for c in ("field", "old_value", "new_value")]
    return watching.read_changes(spark, path, StructType([feed.schema["user_id"], feed.schema["event_id"], *text]))


@job(f"WITH {WINDOWS_SQL} SELECT * FROM windows")
def q_window_parity_stream(spark, folder):
    """The sides of ``q_window_parity`` as two streams whose rows come late now and then; the last poll stands two windows behind the last row."""
    sides = parity_sides(spark, folder)
    feeds, latenesses = zip(*(_with_late_rows(spark, side, "event_id", "ts") for side in sides))
    lateness = max(latenesses)
    last = F.when(F.col("event_id").isNull(), F.col("ts") + F.expr(f"INTERVAL {lateness + 1200} SECONDS")).otherwise(F.col("ts"))
    path = fresh_path(spark, "windows")
    _in_slices(spark, [feed.withColumn("ts", last) for feed in feeds], "event_id", lambda source, target: window_parity_stream(
        source, target, path, "event_id", "ts", "value", f"{lateness} seconds"), SLICES + 1)
    return read_windows(spark, path)


#: What each table of the cycle shows of a row; the same text on both sides.
SHOWN = {
    "events": "event_id || '|' || user_id || '|' || event_type || '|' || CAST(CAST(value AS DECIMAL(18,2)) AS {text}) || '|' || coalesce(props, '-') || '|' || CAST(ts AS {text})",
    "orders": "o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {text}) || '|' || CAST(o_orderdate AS {text}) || '|' || o_orderpriority",
    "customer": "c_custkey || '|' || c_name || '|' || c_nationkey || '|' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS {text}) || '|' || c_mktsegment",
}
CYCLE_SQL = f"""ev AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {SLICES} // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) AS slice FROM events),
od AS (SELECT *, (epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER ()) * {SLICES} // (max(epoch_us(o_orderdate)) OVER () - min(epoch_us(o_orderdate)) OVER () + 1) AS slice
  FROM orders),
cu AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal + n AS c_acctbal, c_mktsegment, n AS slice FROM customer, range({SLICES}) AS cycles(n) WHERE c_custkey % 10 >= n)"""


def _cycles(spark, folder):
    """Three tables in one cycle, run once per slice: events by the newest version per user, orders by the first that arrived per customer, and customer,
    which has no watermark, anew each time, other balances and some customers gone. A fourth cannot be read and fails."""
    path, keys = fresh_path(spark, "cycle"), {"events": ["user_id"], "orders": ["o_custkey"], "customer": ["c_custkey"]}
    events, _, _ = _spanned(table(spark, folder, "events"), "ts")
    orders, _, _ = _spanned(table(spark, folder, "orders"), "o_orderdate")
    customer = table(spark, folder, "customer")
    number, done = iter(range(SLICES)), []

    def run(event_stream, order_stream):
        n = next(number)
        now = customer.filter(F.col("c_custkey") % 10 >= n).withColumn("c_acctbal", F.col("c_acctbal") + n)
        replicas = [R.Replica("events", lambda: event_stream, keys["events"], ["ts", "event_id"]),
                    R.Replica("orders", lambda: order_stream, keys["orders"], ["o_orderdate", "o_orderkey"], "skip"),
                    R.Replica("customer", lambda: now, keys["customer"], policy="refresh"),
                    R.Replica("closed", lambda: event_stream.select("closed_at"), ["user_id"], ["closed_at"])]
        done[:] = replicas, R.cycle(spark, replicas, path, n)

    # Of a slice each customer's orders and each user's events reach one micro-batch.
    feeds = [events.withColumn("_deal", F.col("user_id")), orders.withColumn("_deal", F.col("o_custkey"))]
    _in_slices(spark, feeds, "_deal", lambda e, o: run(e.drop("_deal"), o.drop("_deal")))
    return path, *done


@job(f"""WITH {CYCLE_SQL},
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM ev),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY slice, o_orderdate, o_orderkey) AS n FROM od)
SELECT 'events' AS table_name, {SHOWN["events"].format(text="VARCHAR")} AS body FROM e WHERE n = 1
UNION ALL SELECT 'orders', {SHOWN["orders"].format(text="VARCHAR")} FROM o WHERE n = 1
UNION ALL SELECT 'customer', {SHOWN["customer"].format(text="VARCHAR")} FROM cu WHERE slice = {SLICES - 1}""")
def q_replicate_tables(spark, folder):
    path, replicas, _ = _cycles(spark, folder)
    found = [R.replica_rows(spark, r, path, table(spark, folder, r.name).schema, SLICES - 1).select(
        F.lit(r.name).alias("table_name"), F.expr(SHOWN[r.name].format(text="STRING")).alias("body")) for r in replicas if r.name in SHOWN]
    return found[0].unionByName(found[1]).unionByName(found[2])


@job(f"""WITH {CYCLE_SQL}
SELECT 'events' AS table_name, 'ok' AS status, count(*) FILTER (WHERE slice = {SLICES - 1}) AS rows_last, count(*) AS rows_total, 0::BIGINT AS deleted,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS watermark FROM ev
UNION ALL SELECT 'orders', 'ok', count(*) FILTER (WHERE slice = {SLICES - 1}), count(*), 0, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM od
UNION ALL SELECT 'customer', 'ok', count(*) FILTER (WHERE slice = {SLICES - 1}), count(*),
  count(*) FILTER (WHERE slice = {SLICES - 2}) - count(*) FILTER (WHERE slice = {SLICES - 1}), '' FROM cu
UNION ALL SELECT 'closed', 'failed', 0, 0, 0, ''""")
def q_replication_state(spark, folder):
    _, _, state = _cycles(spark, folder)
    return state.select("table_name", "status", "rows_last", "rows_total", "deleted",
                        F.coalesce(F.date_format(F.col("watermark").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("watermark"))
