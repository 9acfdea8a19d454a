"""Pre-flight, load, parity and text queries, run on the given tables with seeded defects."""

from pyspark.sql import functions as F

from plantledger.functions import text as X
from plantledger.functions.values import date_columns
from plantledger.operators import migrate, parity, quality, textjobs
from plantledger.plans.registry import job
from plantledger.session import fresh_path
from plantledger.sources import load, sinks, versions
from plantledger.sources.tables import table



def mixed_text(spark, folder):
    """events as loosely typed text: six date formats, blanks, bad numbers, cut JSON."""
    key = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    clock = F.date_format("ts", "HH:mm:ss")
    seconds = (F.unix_date(F.col("ts").cast("date")).cast("bigint") * 86400 + F.hour("ts") * 3600
               + F.minute("ts") * 60 + F.second("ts"))
    rendered = (F.when(key % 50 == 0, "")
                .when(key % 6 == 0, F.concat(day, F.lit("T"), clock, F.lit("Z")))
                .when(key % 6 == 1, F.concat(day, F.lit("T"), clock))
                .when(key % 6 == 2, F.concat(day, F.lit(" "), clock))
                .when(key % 6 == 3, day)
                .when(key % 6 == 4, seconds.cast("string"))
                .otherwise((seconds * 1000).cast("string")))
    return table(spark, folder, "events").select(
        key.cast("string").alias("event_id"),
        F.when(key % 43 == 0, F.concat(F.col("user_id").cast("string"), F.lit(".5")))
        .otherwise(F.col("user_id").cast("string")).alias("user_id"),
        rendered.alias("created_at"), day.alias("day"),
        F.when(key % 41 == 0, "n/a").when(key % 47 == 0, "").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(key % 5 == 0, "0").when(key % 5 == 1, "1").when(key % 5 == 2, "").when(key % 5 == 3, "false")
        .otherwise("yes").alias("active"),
        F.when(key % 37 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props")).alias("props"),
        F.col("event_type"), F.lit("x").alias("retired_column"))


MIXED_SQL = """mixed AS (
  SELECT *, CASE WHEN key % 50 = 0 THEN '' WHEN key % 6 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN key % 6 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN key % 6 = 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN key % 6 = 3 THEN strftime(ts, '%Y-%m-%d') WHEN key % 6 = 4 THEN CAST(secs AS VARCHAR)
    ELSE CAST(secs * 1000 AS VARCHAR) END AS created_at
  FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS key, ts, CAST(floor(epoch(ts)) AS BIGINT) AS secs,
      strftime(ts, '%Y-%m-%d') AS day, event_type,
      CASE WHEN event_id % 43 = 0 THEN user_id || '.5' ELSE CAST(user_id AS VARCHAR) END AS user_id,
      CASE WHEN event_id % 41 = 0 THEN 'n/a' WHEN event_id % 47 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS value,
      CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '' WHEN 3 THEN 'false' ELSE 'yes' END AS active,
      CASE WHEN event_id % 37 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS props
    FROM events))"""
DATE_CLASS = """CASE
  WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z$') THEN 'iso_z'
  WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?$') THEN 'iso_no_z'
  WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}(\\.\\d+)?$') THEN 'sql_space'
  WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'date_only'
  WHEN regexp_matches(v, '^\\d{10}(\\.\\d+)?$') THEN 'epoch_seconds'
  WHEN regexp_matches(v, '^\\d{13}$') THEN 'epoch_ms' ELSE 'unknown' END"""
STORAGE = """CASE WHEN regexp_matches(v, '^[+-]?\\d+$') THEN 'integer'
  WHEN regexp_matches(v, '^[+-]?(\\d+\\.\\d*|\\.\\d+|\\d+)([eE][+-]?\\d+)?$') THEN 'real' ELSE 'text' END"""
ORPHANS_SQL = """orphans AS (
  SELECT 'lineitem' AS table_name, 'l_partkey' AS fk, 'part' AS parent, count(*) AS n_orphans,
    count(DISTINCT l_partkey) AS n_keys
  FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 7 <> 0)
    AND l_partkey IS NOT NULL
  UNION ALL
  SELECT 'lineitem', 'l_orderkey', 'orders', count(*), count(DISTINCT l_orderkey)
  FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 11 <> 0)
  UNION ALL
  SELECT 'orders', 'o_custkey', 'customer', count(*), count(DISTINCT o_custkey)
  FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey))"""
MISMATCH_SQL = f"""mismatches AS (
  SELECT column_name, declared, string_agg(DISTINCT class, ', ' ORDER BY class) AS actual_types,
    min(v) FILTER (WHERE NOT list_contains(accepted, class)) AS sample,
    count(*) FILTER (WHERE NOT list_contains(accepted, class)) AS n_bad
  FROM (SELECT *, {STORAGE} AS class FROM (
    SELECT 'event_id' AS column_name, 'BIGINT' AS declared, ['integer'] AS accepted, event_id AS v FROM mixed
    UNION ALL SELECT 'user_id', 'INTEGER', ['integer'], user_id FROM mixed
    UNION ALL SELECT 'value', 'REAL', ['real', 'integer'], value FROM mixed
    UNION ALL SELECT 'props', 'JSON', ['text'], props FROM mixed))
  GROUP BY column_name, declared HAVING n_bad > 0)"""
DATEMIX_SQL = f"""datemix AS (
  SELECT column_name, string_agg(DISTINCT class, ', ' ORDER BY class) AS formats,
    count(DISTINCT class) AS n_formats, count(*) AS n_values
  FROM (SELECT column_name, {DATE_CLASS} AS class FROM (
    SELECT 'created_at' AS column_name, created_at AS v FROM mixed UNION ALL SELECT 'day', day FROM mixed))
  GROUP BY column_name HAVING count(DISTINCT class) > 1)"""
DECLARED = {"event_id": "BIGINT", "user_id": "INTEGER", "value": "REAL", "props": "JSON", "event_type": "GEOMETRY"}


def _thin_part(spark, folder):
    return table(spark, folder, "part").filter(F.col("p_partkey") % 7 != 0)


def _thin_orders(spark, folder):
    return table(spark, folder, "orders").filter(F.col("o_orderkey") % 11 != 0)


@job(f"WITH {ORPHANS_SQL} SELECT * FROM orphans")
def q_fk_orphans(spark, folder):
    line, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return quality.fk_orphans([
        ("lineitem", line, "l_partkey", "part", _thin_part(spark, folder), "p_partkey"),
        ("lineitem", line, "l_orderkey", "orders", _thin_orders(spark, folder), "o_orderkey"),
        ("orders", orders, "o_custkey", "customer", table(spark, folder, "customer"), "c_custkey"),
        ("orders", orders, "o_clerk", "clerk", None, "clerk_id")])


@job("""SELECT lineitem.* REPLACE (CASE WHEN p_partkey IS NOT NULL THEN l_partkey END AS l_partkey), p_partkey IS NULL AS was_orphan
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) ON p_partkey = l_partkey""")
def q_null_orphans(spark, folder):
    return quality.null_orphans(table(spark, folder, "lineitem"), _thin_part(spark, folder), "l_partkey", "p_partkey")


@job(f"WITH {MIXED_SQL}, {MISMATCH_SQL} SELECT * FROM mismatches")
def q_type_mismatch(spark, folder):
    return quality.type_mismatches(mixed_text(spark, folder), DECLARED)


@job(f"WITH {MIXED_SQL}, {DATEMIX_SQL} SELECT * FROM datemix")
def q_datetime_mix(spark, folder):
    mixed = mixed_text(spark, folder)
    return quality.datetime_mix(mixed, date_columns(dict.fromkeys(mixed.columns, "TEXT")))


@job("""SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_duplicate_keys(spark, folder):
    return quality.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def _halves(spark, folder):
    """The customers as two sources that share a third of their keys and differ in the balance."""
    customer = table(spark, folder, "customer")
    first = customer.filter(F.col("c_custkey") % 3 != 2)
    second = customer.filter(F.col("c_custkey") % 3 != 0).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return first, second


HALVES_SQL = """halves AS (
  SELECT 'first' AS source, 0 AS rank, * FROM customer WHERE c_custkey % 3 <> 2
  UNION ALL SELECT 'second', 1, * REPLACE (c_acctbal + 1 AS c_acctbal) FROM customer WHERE c_custkey % 3 <> 0)"""


@job(f"""WITH {HALVES_SQL} SELECT c_custkey, count(DISTINCT source) AS n_sources,
  string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, count(*) AS n_rows
FROM halves GROUP BY c_custkey HAVING count(DISTINCT source) > 1""")
def q_source_overlap(spark, folder):
    first, second = _halves(spark, folder)
    return quality.overlap({"first": first, "second": second}, ["c_custkey"])


#: Key columns of the given tables, and the foreign keys between them.
AUDIT_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
              "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"],
              "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"]}
AUDIT_LINKS = {"nation": [("n_regionkey", "region", "r_regionkey")], "customer": [("c_nationkey", "nation", "n_nationkey")],
               "supplier": [("s_nationkey", "nation", "n_nationkey")], "orders": [("o_custkey", "customer", "c_custkey")],
               "lineitem": [("l_partkey", "part", "p_partkey"), ("l_orderkey", "orders", "o_orderkey"), ("l_suppkey", "supplier", "s_suppkey")],
               "labels": [("doc_id", "documents", "doc_id")]}
#: Parents that lack some rows here.
THIN = {"part": "p_partkey % 7 <> 0", "orders": "o_orderkey % 11 <> 0"}


def _audit_sql(name):
    keys, links = AUDIT_KEYS[name], AUDIT_LINKS.get(name, [])
    orphans = " + ".join(f"""(SELECT count(*) FROM {name} c WHERE c.{fk} IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk} AND {THIN.get(parent, "true")}))""" for fk, parent, pk in links) or "0"
    mixed = name == "events"
    return f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS n_rows, {orphans} AS n_orphans,
  {"(SELECT count(*) FROM mismatches)" if mixed else "0"} AS n_mismatched, {"(SELECT count(*) FROM datemix)" if mixed else "0"} AS n_mixed_dates,
  (SELECT count(*) FROM (SELECT 1 FROM {name} WHERE {" AND ".join(f"{k} IS NOT NULL" for k in keys)} GROUP BY {", ".join(keys)} HAVING count(*) > 1)) AS n_duplicate_keys,
  (SELECT count(*) FROM {name} WHERE {" OR ".join(f"{k} IS NULL" for k in keys)}) AS n_null_keys"""


@job(f"""WITH {MIXED_SQL}, {MISMATCH_SQL}, {DATEMIX_SQL}, found AS ({" UNION ALL ".join(_audit_sql(name) for name in AUDIT_KEYS)})
SELECT *, CASE WHEN n_orphans + n_mismatched + n_duplicate_keys + n_null_keys > 0 THEN 'BLOCKER' WHEN n_mixed_dates > 0 THEN 'WARN' ELSE 'OK' END AS status
FROM found WHERE n_rows > 0""")
def q_preflight(spark, folder):
    """Every given table; events as loose text, and two parents with rows missing."""
    def parent(name):
        rows = table(spark, folder, name)
        return rows.filter(THIN[name]) if name in THIN else rows

    audits = {name: quality.Audit(table(spark, folder, name), keys, [(fk, parent(p), pk) for fk, p, pk in AUDIT_LINKS.get(name, [])])
              for name, keys in AUDIT_KEYS.items()}
    audits["events"] = quality.Audit(mixed_text(spark, folder), ["event_id"], declared=DECLARED, dates=["created_at", "day"])
    audits["orders"] = audits["orders"]._replace(links=[*audits["orders"].links, ("o_clerk", None, "clerk_id")])
    return quality.preflight(audits)


TARGET = {"event_id": "bigint", "user_id": "bigint", "created_at": "date", "value": "double", "active": "bool",
          "props": "json"}


@job(f"""WITH {MIXED_SQL},
checked AS (
  SELECT *, regexp_matches(user_id, '^\\d+$') AS user_ok,
    created_at = '' OR NOT regexp_matches(created_at, '^\\d+$') AS date_ok, value <> 'n/a' AS value_ok FROM mixed)
SELECT CAST(event_id AS BIGINT) AS event_id,
  CASE WHEN user_ok AND date_ok AND value_ok THEN 'loaded' ELSE 'rejected' END AS status,
  concat_ws(', ', CASE WHEN NOT user_ok THEN 'user_id' END, CASE WHEN NOT date_ok THEN 'created_at' END,
    CASE WHEN NOT value_ok THEN 'value' END) AS reason,
  CASE WHEN user_ok AND date_ok AND value_ok AND created_at <> ''
    THEN strftime(CAST(replace(replace(created_at, 'T', ' '), 'Z', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') ELSE '' END AS created_at,
  CASE WHEN user_ok AND date_ok AND value_ok AND value <> '' THEN CAST(value AS DOUBLE) ELSE -1 END AS value,
  CASE WHEN NOT (user_ok AND date_ok AND value_ok) THEN '' WHEN active = '' THEN 'NULL'
    WHEN active IN ('0', 'false') THEN 'false' ELSE 'true' END AS active,
  user_ok AND date_ok AND value_ok AND key % 37 = 0 AS props_malformed, CASE WHEN user_ok AND date_ok AND value_ok THEN coalesce(props, '') ELSE '' END AS props
FROM checked""")
def q_coerce_load(spark, folder):
    good, rejects = migrate.coerce(mixed_text(spark, folder), TARGET)
    loaded = good.select(
        "event_id", F.lit("loaded").alias("status"), F.lit("").alias("reason"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("created_at"),
        F.coalesce("value", F.lit(-1.0)).alias("value"),
        F.coalesce(F.col("active").cast("string"), F.lit("NULL")).alias("active"),
        F.coalesce("props_malformed", F.lit(False)).alias("props_malformed"), F.coalesce("props", F.lit("")).alias("props"))
    refused = rejects.select(
        F.col("event_id").cast("bigint"), F.lit("rejected").alias("status"), "reason", F.lit("").alias("created_at"),
        F.lit(-1.0).alias("value"), F.lit("").alias("active"), F.lit(False).alias("props_malformed"),
        F.lit("").alias("props"))
    return loaded.unionByName(refused)


#: One reject per row here, so that every kind is met: orders with a bad key, total or date.
ORDER_TEXT = {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderdate": "date", "o_orderstatus": "text"}


def _orders_text(spark, folder):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, folder, "orders").select(
        F.when(key % 53 == 0, F.concat(key.cast("string"), F.lit("x"))).otherwise(key.cast("string")).alias("o_orderkey"),
        F.when(key % 59 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(key % 61 == 0, "soon").otherwise(day).alias("o_orderdate"), "o_orderstatus")


@job(f"""WITH {MIXED_SQL},
ev AS (SELECT NOT regexp_matches(user_id, '^\\d+$') AS bad_key, created_at <> '' AND regexp_matches(created_at, '^\\d+$') AS bad_date, value = 'n/a' AS bad_number FROM mixed),
od AS (SELECT o_orderkey % 53 = 0 AS bad_key, o_orderkey % 61 = 0 AS bad_date, o_orderkey % 59 = 0 AS bad_number FROM orders),
judged AS (SELECT 'events' AS table_name, * FROM ev UNION ALL SELECT 'orders', * FROM od)
SELECT table_name, 'ok' AS status, count(*) AS rows_read, count(*) FILTER (WHERE NOT (bad_key OR bad_date OR bad_number)) AS rows_loaded,
  count(*) FILTER (WHERE bad_key OR bad_date OR bad_number) AS rows_rejected,
  count(*) FILTER (WHERE bad_key) AS bad_bigint, count(*) FILTER (WHERE bad_date) AS bad_date, count(*) FILTER (WHERE bad_number) AS bad_double,
  count(*) FILTER (WHERE NOT (bad_key OR bad_date OR bad_number)) AS rows_stored, count(*) FILTER (WHERE bad_key OR bad_date OR bad_number) AS rejects_stored
FROM judged GROUP BY table_name
UNION ALL SELECT 'closed', 'failed', 0, 0, 0, 0, 0, 0, 0, 0""")
def q_load_stats(spark, folder):
    """Two tables of loose text and one that cannot be read; the stored rows are counted again from what was written."""
    path = fresh_path(spark, "load")
    jobs = [load.Load("events", lambda: mixed_text(spark, folder), TARGET), load.Load("orders", lambda: _orders_text(spark, folder), ORDER_TEXT),
            load.Load("closed", lambda: spark.read.schema("id string").parquet(f"{path}/no-such-folder"), {"id": "bigint"})]
    stats = load.load_all(spark, jobs, path, "first")
    found = None
    for job_ in jobs:
        counted = load.outcomes(spark, path, job_.name).agg(F.count_if(F.col("outcome") == "loaded").alias("rows_stored"),
                                                            F.count_if(F.col("outcome") == "rejected").alias("rejects_stored"))
        part = counted.select(F.lit(job_.name).alias("table_name"), "rows_stored", "rejects_stored")
        found = part if found is None else found.unionByName(part)
    return stats.join(found, "table_name").drop("error", "kept_malformed", "run_id")


@job(f"""WITH {HALVES_SQL} SELECT c_custkey, arg_min(c_name, rank) AS c_name, arg_min(c_nationkey, rank) AS c_nationkey,
  arg_min(c_acctbal, rank) AS c_acctbal, arg_min(c_mktsegment, rank) AS c_mktsegment, arg_min(source, rank) AS source FROM halves GROUP BY c_custkey""")
def q_first_wins_merge(spark, folder):
    first, second = _halves(spark, folder)
    return migrate.first_wins([("first", first), ("second", second)], ["c_custkey"])


KEYED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
         "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id",
         "benchmark": "item_id", "conversations": "conv_id", "embeddings": "vec_id"}


@job("\nUNION ALL ".join(f"SELECT '{name}' AS table_name, CAST(coalesce(max({key}), 0) + 1 AS BIGINT) AS next_key FROM {name}"
                         for name, key in KEYED.items()))
def q_next_keys(spark, folder):
    return migrate.next_keys({name: (table(spark, folder, name), key) for name, key in KEYED.items()})


def altered_orders(spark, folder):
    """orders as a faulty copy holds them: rows missing, totals off, states off, rows too many."""
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    copy = (orders.filter(key % 101 != 0)
            .withColumn("o_totalprice", F.when(key % 103 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
            .withColumn("o_orderstatus", F.when(key % 107 == 0, "X").otherwise(F.col("o_orderstatus"))))
    extra = orders.filter(key % 997 == 0).withColumn("o_orderkey", -key - 1)
    return copy.unionByName(extra)


ALTERED_SQL = """altered AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 107 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 103 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 101 <> 0
  UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 997 = 0)"""


#: Tables whose copy is right.
SAME = ("region", "nation", "customer", "supplier", "part", "lineitem", "documents", "labels", "pages", "benchmark", "conversations", "embeddings")


@job(f"""WITH {ALTERED_SQL},
n AS (SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM altered) AS target_rows
  UNION ALL SELECT 'events', count(*), count(*) FILTER (WHERE event_id % 101 <> 0) FROM events
  {" ".join(f"UNION ALL SELECT '{name}', count(*), count(*) FROM {name}" for name in SAME)})
SELECT *, CASE WHEN source_rows = target_rows THEN 'OK' ELSE 'MISMATCH' END AS status FROM n""")
def q_count_parity(spark, folder):
    source = {name: table(spark, folder, name) for name in ("orders", "events", *SAME)}
    target = source | {"orders": altered_orders(spark, folder), "events": source["events"].filter(F.col("event_id") % 101 != 0)}
    return parity.count_parity(source, target)


def _money_text(df):
    return (df.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
            .withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")))


def _profile_sql(name, columns):
    return "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(DISTINCT {c}) AS n FROM {name}"
                               for c in columns)


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@job(f"""WITH {ALTERED_SQL},
a AS ({_profile_sql('orders', ORDER_COLUMNS + ('o_orderpriority',))}),
b AS ({_profile_sql('altered', ORDER_COLUMNS)}
  UNION ALL SELECT 'o_comment', count(*), count(DISTINCT o_custkey % 5) FROM altered)
SELECT coalesce(a.column_name, b.column_name) AS column_name,
  CASE WHEN b.non_null IS NULL THEN 'source only' WHEN a.non_null IS NULL THEN 'target only'
    WHEN a.non_null = b.non_null AND a.n = b.n THEN 'same' ELSE 'differs' END AS status,
  coalesce(a.non_null, 0) AS source_non_null, coalesce(a.n, 0) AS source_distinct,
  coalesce(b.non_null, 0) AS target_non_null, coalesce(b.n, 0) AS target_distinct
FROM a FULL JOIN b ON a.column_name = b.column_name""")
def q_column_profile_diff(spark, folder):
    target = altered_orders(spark, folder).drop("o_orderpriority").withColumn("o_comment", F.col("o_custkey") % 5)
    return parity.column_profile_diff(table(spark, folder, "orders"), target)


def _cell(column, text):
    return f"""SELECT o_orderkey, '{column}' AS column_name, {text.format('a')} AS source_value, {text.format('b')} AS target_value
  FROM orders a JOIN altered b USING (o_orderkey) WHERE {text.format('a')} IS DISTINCT FROM {text.format('b')}"""


@job(f"""WITH {ALTERED_SQL}
{_cell('o_custkey', 'CAST({0}.o_custkey AS VARCHAR)')}
UNION ALL {_cell('o_orderstatus', '{0}.o_orderstatus')}
UNION ALL {_cell('o_totalprice', 'CAST(CAST({0}.o_totalprice AS DECIMAL(18,2)) AS VARCHAR)')}
UNION ALL {_cell('o_orderdate', "strftime({0}.o_orderdate, '%Y-%m-%d')")}
UNION ALL {_cell('o_orderpriority', '{0}.o_orderpriority')}
UNION ALL SELECT o_orderkey, '(row)', 'present', 'missing' FROM orders a
  WHERE NOT EXISTS (SELECT 1 FROM altered b WHERE b.o_orderkey = a.o_orderkey)
UNION ALL SELECT o_orderkey, '(row)', 'missing', 'present' FROM altered b
  WHERE NOT EXISTS (SELECT 1 FROM orders a WHERE b.o_orderkey = a.o_orderkey)""")
def q_row_diff(spark, folder):
    return parity.row_diff(_money_text(table(spark, folder, "orders")), _money_text(altered_orders(spark, folder)),
                           "o_orderkey")


def _altered_events(spark, folder):
    key = F.col("event_id")
    return (table(spark, folder, "events").filter(key % 101 != 0)
            .withColumn("value", F.when(key % 103 == 0, F.col("value") + 1).otherwise(F.col("value"))))


def _field(name, value):
    return f"'{name}=' || coalesce(length({value}) || ':' || {value}, '-')"


ROW_SQL = " || ',' || ".join(_field(name, value) for name, value in [
    ("event_id", "CAST(event_id AS VARCHAR)"), ("event_type", "event_type"), ("props", "props"), ("ts", "CAST(epoch_us(ts) AS VARCHAR)"),
    ("user_id", "CAST(user_id AS VARCHAR)"), ("value", "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)")])
WINDOWS_SQL = f"""altered_events AS (
  SELECT event_id, CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 107 = 0 THEN ts + INTERVAL 1 MICROSECOND ELSE ts END AS ts, user_id, event_type,
    CASE WHEN event_id % 103 = 0 THEN value + 1 ELSE value END AS value,
    CASE WHEN event_id % 109 = 0 THEN NULL WHEN event_id % 113 = 0 THEN 'NULL' ELSE props END AS props
  FROM events WHERE event_id % 101 <> 0),
both_sides AS (SELECT 'a' AS side, event_id, CASE WHEN event_id % 211 = 0 THEN NULL ELSE ts END AS ts, user_id, event_type, value,
    CASE WHEN event_id % 113 = 0 THEN NULL ELSE props END AS props FROM events
  UNION ALL SELECT 'b', event_id, ts, user_id, event_type, value, props FROM altered_events),
spread AS (
  SELECT side, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 - 300 * k AS start_s, CAST(value AS DECIMAL(18,4)) AS v,
    CAST('0x' || substr(md5({ROW_SQL}), 1, 15) AS HUGEINT) AS h
  FROM both_sides, (VALUES (0), (1)) AS steps(k) WHERE ts IS NOT NULL OR k = 0),
windows AS (
  SELECT coalesce(strftime(make_timestamp(start_s * 1000000), '%Y-%m-%d %H:%M:%S'), '(no time)') AS window_start,
    count(*) FILTER (WHERE side = 'a') AS source_n, count(*) FILTER (WHERE side = 'b') AS target_n,
    coalesce(sum(v) FILTER (WHERE side = 'a')::DOUBLE, 0) AS source_sum,
    coalesce(sum(v) FILTER (WHERE side = 'b')::DOUBLE, 0) AS target_sum,
    count(*) FILTER (WHERE side = 'a') = count(*) FILTER (WHERE side = 'b')
      AND coalesce(sum(h) FILTER (WHERE side = 'a') = sum(h) FILTER (WHERE side = 'b'), FALSE) AS match
  FROM spread GROUP BY start_s)"""


def parity_sides(spark, folder):
    """events and a copy: differences in the value, in the time within its window, in props, and NULL against the text NULL; some rows have no time."""
    key = F.col("event_id")

    def typed(df):
        return df.withColumns({"value": F.col("value").cast("decimal(18,2)"), "ts": F.when(key % 211 != 0, F.col("ts"))})
    source = typed(table(spark, folder, "events")).withColumn("props", F.when(key % 113 != 0, F.col("props")))
    target = typed(_altered_events(spark, folder)).withColumns({
        "ts": F.when(key % 107 == 0, F.col("ts") + F.expr("INTERVAL '0.000001' SECOND")).otherwise(F.col("ts")),
        "props": F.when(key % 113 == 0, F.when(key % 109 != 0, "NULL")).otherwise(F.when(key % 109 != 0, F.col("props")))})
    return source, target


@job(f"WITH {WINDOWS_SQL} SELECT * FROM windows")
def q_window_parity(spark, folder):
    return parity.window_parity(*parity_sides(spark, folder), "ts", "value")


@job(f"""WITH {WINDOWS_SQL},
per_table AS (
  SELECT 'events' AS table_name, count(*) FILTER (WHERE NOT match) AS n_bad FROM windows
  UNION ALL SELECT 'customer', 0)
SELECT table_name, CASE WHEN n_bad = 0 THEN 'green' ELSE 'drift' END AS status, n_bad FROM per_table
UNION ALL
SELECT '(all)' || coalesce(': ' || string_agg(table_name, ', ' ORDER BY table_name) FILTER (WHERE n_bad > 0), ''),
  CASE WHEN sum(n_bad) = 0 THEN 'green' ELSE 'drift' END, CAST(sum(n_bad) AS BIGINT) FROM per_table""")
def q_drift_status(spark, folder):
    windows = q_window_parity(spark, folder).select(F.lit("events").alias("table_name"), "match")
    customer = {"customer": table(spark, folder, "customer")}
    counts = parity.count_parity(customer, customer).select("table_name", (F.col("status") == "OK").alias("match"))
    return parity.drift_status(windows.unionByName(counts))


def _deep(key, altered):
    """A part five levels down: a number and a truth value that may turn into text, an empty list that may go, and a volatile key."""
    number, quoted = key.cast("string"), F.concat(F.lit('"'), key.cast("string"), F.lit('"'))
    n = F.when(key % 127 == 0, quoted).otherwise(number) if altered else number
    on = F.when(key % 131 == 0, '"true"').otherwise("true") if altered else F.lit("true")
    none = F.when(key % 137 == 0, "").otherwise('"none":[],') if altered else F.lit('"none":[],')
    return F.concat(F.lit('"deep":{"a":{"b":{'), none, F.lit('"c":{"d":{"n":'), n, F.lit(',"on":'), on,
                    F.lit(f',"updated_at":"{"now" if altered else "then"}"' + "}}}}}"))


def _odd(key, altered):
    """Parts that look alike and are not: a name with a point, a repeated name, numbers no double holds, a name like an element; and
    a list of objects in another order, which is the same."""
    parts = [(139, '"p.q":1', '"p":{"q":1}'), (149, '"big":1e999', '"big":2e999'), (151, '"twice":1,"twice":2', '"twice":2'),
             (157, '"at[0]":1', '"at":[1]'), (163, '"any":[{"v":1},{"v":2,"w":[]}]', '"any":[{"w":[],"v":2.0},{"v":1}]')]
    return F.concat(*[F.when(key % every == 0, f",{b if altered else a}").otherwise("") for every, a, b in parts])


def _with_deep(key, altered):
    """The document with its deep and its odd parts; a few are cut off and no JSON, or have too many levels."""
    cut = F.concat(F.lit('{"cut": '), key.cast("string"), F.lit(", " if altered else ""))
    nested = F.concat(F.repeat(F.lit("["), F.lit(2_500)), key.cast("string"), F.repeat(F.lit("]"), F.lit(2_500 - altered)))
    whole = F.concat(F.substring("doc", F.lit(1), F.length("doc") - 1), F.lit(","), "deep", _odd(key, altered), F.lit("}"))
    return F.when(key % 331 == 0, cut).when(key % 337 == 0, nested).otherwise(whole)


def _documents(spark, folder, altered):
    """Nested status documents made from events; the altered side has another list order, fresh time
    stamps and three kinds of real differences."""
    key = F.col("event_id")
    k = F.json_tuple("props", "k")
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    n = F.col("k").cast("bigint")
    rolls = [F.struct(F.lit(f"R{i}").alias("roll_id"), (key * i).alias("w")) for i in (1, 2, 3)]
    if not altered:
        return events.select("event_id", F.to_json(F.struct(
            n.alias("k"), F.col("event_type").alias("type"), F.date_format("ts", "HH:mm:ss").alias("seen_at"),
            F.struct(F.col("user_id").alias("user")).alias("who"), F.array(*rolls).alias("rolls"))).alias("doc"),
            _deep(key, False).alias("deep")).select("event_id", _with_deep(key, False).alias("doc"))
    moved = F.struct(F.lit("R2").alias("roll_id"), F.when(key % 113 == 0, key * 2 + 1).otherwise(key * 2).alias("w"))
    return events.select("event_id", F.to_json(F.struct(
        F.when(key % 103 == 0, n + 1).otherwise(n).alias("k"),
        F.when(key % 107 != 0, F.col("event_type")).alias("type"), F.lit("now").alias("seen_at"),
        F.when(key % 109 == 0, "x").alias("extra"),
        F.struct(F.col("user_id").alias("user")).alias("who"), F.array(rolls[2], moved, rolls[0]).alias("rolls"))).alias("doc"),
        _deep(key, True).alias("deep")).select("event_id", _with_deep(key, True).alias("doc"))


@job("""WITH n AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 331 > 0 AND event_id % 337 > 0)
SELECT event_id, '$.k' AS path, 'changed' AS status, 'number' AS source_type, 'number' AS target_type,
  CAST(k AS VARCHAR) AS source_value, CAST(k + 1 AS VARCHAR) AS target_value
FROM n WHERE event_id % 103 = 0
UNION ALL SELECT event_id, '$.type', 'removed', 'string', '', event_type, '' FROM n WHERE event_id % 107 = 0
UNION ALL SELECT event_id, '$.extra', 'added', '', 'string', '', 'x' FROM n WHERE event_id % 109 = 0
UNION ALL SELECT event_id, '$.rolls[roll_id=R2].w', 'changed', 'number', 'number', CAST(event_id * 2 AS VARCHAR), CAST(event_id * 2 + 1 AS VARCHAR)
FROM n WHERE event_id % 113 = 0
UNION ALL SELECT event_id, '$.deep.a.b.c.d.n', 'changed', 'number', 'string', CAST(event_id AS VARCHAR), CAST(event_id AS VARCHAR)
FROM n WHERE event_id % 127 = 0
UNION ALL SELECT event_id, '$.deep.a.b.c.d.on', 'changed', 'boolean', 'string', 'true', 'true' FROM n WHERE event_id % 131 = 0
UNION ALL SELECT event_id, '$.deep.a.b.none', 'removed', 'array', '', '[]', '' FROM n WHERE event_id % 137 = 0
UNION ALL SELECT event_id, '$', 'changed', 'text', 'text', '{"cut": ' || event_id, '{"cut": ' || event_id || ',' FROM events WHERE event_id % 331 = 0
UNION ALL SELECT event_id, '$', 'changed', 'text', 'text', repeat('[', 2500) || event_id || repeat(']', 2500), repeat('[', 2500) || event_id || repeat(']', 2499)
FROM events WHERE event_id % 337 = 0 AND event_id % 331 > 0
UNION ALL SELECT event_id, unnest(['$["p.q"]', '$.p.q']), unnest(['removed', 'added']), unnest(['number', '']), unnest(['', 'number']), unnest(['1', '']), unnest(['', '1'])
FROM n WHERE event_id % 139 = 0
UNION ALL SELECT event_id, '$.big', 'changed', 'number', 'number', '1e999', '2e999' FROM n WHERE event_id % 149 = 0
UNION ALL SELECT event_id, unnest(['$.twice', '$.twice(2)']), unnest(['changed', 'removed']), 'number', unnest(['number', '']), unnest(['1', '2']), unnest(['2', ''])
FROM n WHERE event_id % 151 = 0
UNION ALL SELECT event_id, unnest(['$["at[0]"]', '$.at[0]']), unnest(['removed', 'added']), unnest(['number', '']), unnest(['', 'number']), unnest(['1', '']), unnest(['', '1'])
FROM n WHERE event_id % 157 = 0""")
def q_json_diff(spark, folder):
    return parity.json_diff(_documents(spark, folder, False), _documents(spark, folder, True), "event_id", "doc")


def _altered_pages(spark, folder):
    """pages as another system serves them: a token replaced on some, a blank line end on others."""
    key = F.col("page_id")
    html = F.col("html")
    return table(spark, folder, "pages").filter(key % 101 != 0).withColumn(
        "html", F.when(key % 5 == 0, F.replace(html, F.lit("<h1>"), F.lit("<h1 id='top'>")))
        .when(key % 5 == 1, F.concat(html, F.lit(" \r\n"))).otherwise(html))


LOOSE = "trim(regexp_replace(regexp_replace(html, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), ' ' || chr(9) || chr(10))"


@job(f"""WITH altered AS (
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(html, '<h1>', '<h1 id=''top''>')
    WHEN page_id % 5 = 1 THEN html || ' ' || chr(13) || chr(10) ELSE html END AS html FROM pages WHERE page_id % 101 <> 0),
a AS (SELECT page_id, html, {LOOSE} AS t FROM pages), b AS (SELECT page_id, html, {LOOSE} AS t FROM altered),
judged AS (
  SELECT a.page_id, a.t AS at_text, b.t AS bt_text, length(a.html) AS source_size, coalesce(length(b.html), 0) AS target_size,
    CASE WHEN b.t IS NULL THEN 'missing in target' WHEN a.t = b.t THEN 'OK' ELSE 'DRIFT' END AS status
  FROM a LEFT JOIN b USING (page_id)),
lines AS (
  SELECT page_id, 1 AS sign, unnest(string_split(regexp_replace(at_text, '>\\s*<', '>' || chr(10) || '<', 'g'), chr(10))) AS line FROM judged WHERE status = 'DRIFT'
  UNION ALL
  SELECT page_id, -1, unnest(string_split(regexp_replace(bt_text, '>\\s*<', '>' || chr(10) || '<', 'g'), chr(10))) FROM judged WHERE status = 'DRIFT'),
changed AS (
  SELECT page_id, CAST(sum(abs(net)) AS BIGINT) AS n FROM (SELECT page_id, line, sum(sign) AS net FROM lines GROUP BY ALL) GROUP BY page_id)
SELECT page_id, status, source_size, target_size, coalesce(n, 0) AS changed_lines FROM judged LEFT JOIN changed USING (page_id)""")
def q_text_drift(spark, folder):
    return textjobs.text_drift(table(spark, folder, "pages"), _altered_pages(spark, folder), "page_id", "html")


@job("SELECT doc_id, source, lang, text FROM documents")
def q_definition_snapshot(spark, folder):
    path = fresh_path(spark, "definitions")
    stable = ["doc_id", "source", "lang", "text"]
    sinks.dump_definitions(table(spark, folder, "documents"), stable, path)
    return spark.read.schema("doc_id bigint, source string, lang string, text string").json(path)


RULES = (
    X.Rule("line_break", "<br(?!/)>", "<br/>"),
    X.Rule("ad_class", "class=\"ad\"", "class=\"notice\""),
    X.Rule("bold", "<b>", "<strong>"),
    X.Rule("copyright", "&copy;", "(c)"),
    X.Rule("comment", "<!-- ad [0-9]+ -->", ""),
)


@job("""WITH new AS (
  SELECT page_id, html, regexp_replace(replace(replace(replace(replace(html, '<br>', '<br/>'), 'class="ad"', 'class="notice"'),
    '<b>', '<strong>'), '&copy;', '(c)'), '<!-- ad [0-9]+ -->', '', 'g') AS new_text FROM pages)
SELECT page_id, md5(new_text) AS new_md5, length(new_text) AS new_size,
  len(regexp_extract_all(html, '<br>')) AS hits_line_break, len(regexp_extract_all(html, 'class="ad"')) AS hits_ad_class,
  len(regexp_extract_all(html, '<b>')) AS hits_bold, len(regexp_extract_all(html, '&copy;')) AS hits_copyright,
  len(regexp_extract_all(html, '<!-- ad [0-9]+ -->')) AS hits_comment,
  len(regexp_extract_all(new_text, '</b>')) AS residual
FROM new WHERE html <> new_text""")
def q_text_patch(spark, folder):
    patched = textjobs.patch(table(spark, folder, "pages"), "page_id", "html", RULES, "</b>")
    return patched.select("page_id", F.md5("new_text").alias("new_md5"), F.length("new_text").cast("bigint").alias("new_size"),
                          *[f"hits_{r.label}" for r in RULES], "residual")


GROUP_RULES = (
    X.Rule("link", "<a href=\"/([^\"]*)\">([^<]*)</a>", "<a data-link=\"$1\">$2</a>"),
    X.Rule("script", "(?s)<script[^>]*>.*?</script>", "<!-- removed -->"),
    X.Rule("menu", "(?s)<nav>\\s*<ul>.*?</ul>\\s*</nav>", "<!-- removed menu -->"),
    X.Rule("logo", "<h1>", "<h1><span class=\"logo\"></span>"),
)


@job("""WITH one AS (SELECT page_id, html, regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>', '<a data-link="\\1">\\2</a>', 'g') AS t1 FROM pages),
two AS (SELECT *, regexp_replace(t1, '(?s)<script[^>]*>.*?</script>', '<!-- removed -->', 'g') AS t2 FROM one),
three AS (SELECT *, regexp_replace(t2, '(?s)<nav>\\s*<ul>.*?</ul>\\s*</nav>', '<!-- removed menu -->', 'g') AS t3 FROM two),
four AS (SELECT *, replace(t3, '<h1>', '<h1><span class="logo"></span>') AS new_text FROM three)
SELECT page_id, md5(new_text) AS new_md5, length(new_text) AS new_size,
  len(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>')) AS hits_link,
  len(regexp_extract_all(t1, '(?s)<script[^>]*>.*?</script>')) AS hits_script,
  len(regexp_extract_all(t2, '(?s)<nav>\\s*<ul>.*?</ul>\\s*</nav>')) AS hits_menu,
  len(regexp_extract_all(t3, '<h1>')) AS hits_logo, len(regexp_extract_all(new_text, '<li>')) AS residual
FROM four WHERE html <> new_text""")
def q_text_patch_groups(spark, folder):
    patched = textjobs.patch(table(spark, folder, "pages"), "page_id", "html", GROUP_RULES, "<li>")
    return patched.select("page_id", F.md5("new_text").alias("new_md5"), F.length("new_text").cast("bigint").alias("new_size"),
                          *[f"hits_{r.label}" for r in GROUP_RULES], "residual")


@job("""WITH c AS (
  SELECT CASE WHEN o_orderkey IS NULL THEN 'orders' WHEN c_custkey IS NULL THEN 'customer'
    WHEN n_nationkey IS NULL THEN 'nation' ELSE '(complete)' END AS broken_at, count(*) AS n_rows
  FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) ON o_orderkey = l_orderkey
    LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 13 <> 0) ON c_custkey = o_custkey
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 9 <> 0) ON n_nationkey = c_nationkey
  GROUP BY 1)
SELECT broken_at, n_rows, n_rows::DOUBLE / sum(n_rows) OVER ()::DOUBLE AS share FROM c""")
def q_link_coverage(spark, folder):
    customer = table(spark, folder, "customer").filter(F.col("c_custkey") % 13 != 0)
    nation = table(spark, folder, "nation").filter(F.col("n_nationkey") % 9 != 0)
    return parity.link_coverage(table(spark, folder, "lineitem"), [
        ("orders", _thin_orders(spark, folder), "l_orderkey", "o_orderkey", "o_custkey"),
        ("customer", customer, "o_custkey", "c_custkey", "c_nationkey"),
        ("nation", nation, "c_nationkey", "n_nationkey", None)])


@job("""SELECT event_id AS log_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at, event_type AS level, props AS message
FROM events WHERE event_type IN ('error') AND props ILIKE '%"K": 1%' ORDER BY ts DESC, event_id DESC LIMIT 50""")
def q_log_tail(spark, folder):
    log = table(spark, folder, "events").select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("logged_at"), F.col("event_type").alias("level"),
        F.col("props").alias("message"))
    tail = textjobs.log_tail(log, ["error"], "\"K\": 1", 50)
    return tail.withColumn("logged_at", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss"))


def _snapshot(rows, label):
    """The rows as a later run finds them: recorded under a run's id and read back."""
    path = fresh_path(rows.sparkSession, label)
    versions.record(rows, path, "before")
    return versions.entries(rows.sparkSession, path, rows.schema, "before").drop(versions.RUN)


@job("""WITH src AS (
  SELECT p_partkey AS packaging_id, CASE WHEN p_size % 2 = 0 THEN 'Roll' ELSE 'Case' END AS name, p_size AS qty,
    p_partkey AS product_id, CASE WHEN p_partkey % 4 <> 0 THEN 'C' || p_partkey END AS code FROM part
  UNION ALL SELECT p_partkey + 500000000, CASE WHEN p_size % 2 = 0 THEN 'Roll' ELSE 'Case' END, p_size + 1, p_partkey, NULL FROM part WHERE p_partkey % 13 = 0),
tgt AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 100000000 ELSE p_partkey END AS product_id, 'C' || p_partkey AS code
  FROM part WHERE p_partkey % 7 <> 0),
have AS (SELECT DISTINCT p_partkey AS product_id, 'Roll' AS name FROM part WHERE p_partkey % 5 = 0),
m AS (
  SELECT s.*, i.product_id AS by_id, c.pid AS by_code, coalesce(i.product_id, c.pid) AS target_id
  FROM src s LEFT JOIN tgt i ON i.product_id = s.product_id
    LEFT JOIN (SELECT code, min(product_id) AS pid FROM tgt GROUP BY code) c ON c.code = s.code)
SELECT packaging_id, m.name, CAST(qty AS BIGINT) AS qty, coalesce(target_id, -1) AS target_id,
  CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_code IS NOT NULL THEN 'code' ELSE 'none' END AS matched_by,
  CASE WHEN target_id IS NULL THEN 'skip: no product' WHEN h.name IS NOT NULL THEN 'skip: exists'
    WHEN row_number() OVER (PARTITION BY target_id, m.name ORDER BY packaging_id) > 1 THEN 'skip: exists' ELSE 'create' END AS action
FROM m LEFT JOIN have h ON h.product_id = target_id AND h.name = m.name""")
def q_packaging_migrate(spark, folder):
    part = table(spark, folder, "part")
    key = F.col("p_partkey")
    code = F.concat(F.lit("C"), key.cast("string"))
    source = part.select(key.alias("packaging_id"), F.when(F.col("p_size") % 2 == 0, "Roll").otherwise("Case").alias("name"),
                         F.col("p_size").cast("bigint").alias("qty"), key.alias("product_id"),
                         F.when(key % 4 != 0, code).alias("code"))
    again = source.filter(F.col("product_id") % 13 == 0).select(  # the same name once more on the same product
        (F.col("packaging_id") + 500000000).alias("packaging_id"), "name", (F.col("qty") + 1).alias("qty"), "product_id",
        F.lit(None).cast("string").alias("code"))
    source = source.unionByName(again)
    targets = part.filter(key % 7 != 0).select(
        F.when(key % 3 == 0, key + 100000000).otherwise(key).alias("product_id"), code.alias("code"))
    existing = part.filter(key % 5 == 0).select(key.alias("product_id"), F.lit("Roll").alias("name"))
    return migrate.packaging_plan(_snapshot(source, "packagings"), targets, existing)


@job("""WITH saved AS (SELECT 'MO-' || o_orderkey AS name, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS value FROM orders WHERE o_orderkey % 2 = 0),
now AS (SELECT 'MO-' || o_orderkey AS name, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_totalprice END AS value
  FROM orders WHERE o_orderkey % 11 <> 0)
SELECT saved.name, CASE WHEN now.name IS NULL THEN 'no match' WHEN saved.value = now.value THEN 'same' ELSE 'restored' END AS outcome, saved.value
FROM saved LEFT JOIN now ON now.name = saved.name""")
def q_value_restore(spark, folder):
    orders = table(spark, folder, "orders")
    name = F.concat(F.lit("MO-"), F.col("o_orderkey").cast("string")).alias("name")
    saved = orders.filter(F.col("o_orderkey") % 2 == 0).select(name, F.col("o_totalprice").alias("value"))
    now = orders.filter(F.col("o_orderkey") % 11 != 0).select(
        name, F.when(F.col("o_orderkey") % 6 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("value"))
    return migrate.restore_values(_snapshot(saved, "values"), now, "name", "value")
