"""Reading and writing: searches, catalogs, snapshots, logs and reports, and the text helpers behind them."""

from pyspark.sql import functions as F

from plantledger.functions import quantities as Q
from plantledger.functions import text as X
from plantledger.functions import values as V
from plantledger.plans.proof_jobs import ALTERED_SQL, AUDIT_KEYS, altered_orders, q_preflight
from plantledger.plans.registry import JOBS, job
from plantledger.plans.stock_jobs import NEGATIVE_SQL, q_negative_stock
from plantledger.session import fresh_path
from plantledger.sources import sinks
from plantledger.sources import standins as S
from plantledger.sources import tables


@job("""SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def q_search_read(spark, folder):
    """The first rows of a filtered read in a stated order."""
    orders = tables.table(spark, folder, "orders")
    found = tables.search(orders, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") >= 1000), ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"],
                          [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)
    return found.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")


@job("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_read_by_ids(spark, folder):
    orders = tables.table(spark, folder, "orders").filter(F.col("o_orderstatus") == "P")
    return tables.by_ids(tables.table(spark, folder, "customer"), orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@job(" UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {name}" for name in AUDIT_KEYS))
def q_table_catalog(spark, folder):
    """The tables a folder holds, found by listing it, and their rows."""
    return tables.stacked_counts((name, tables.table(spark, folder, name)) for name in tables.catalog(spark, folder))


@job(f"WITH {ALTERED_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders INTERSECT SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM altered")
def q_shared_rows(spark, folder):
    """Rows that an altered copy still holds; the copy lacks a column and has another under a different type."""
    copy = altered_orders(spark, folder).drop("o_orderpriority").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return tables.shared_rows(tables.table(spark, folder, "orders"), copy)


@job("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Roll' ELSE 'Case' END AS name, p_partkey AS product_id,
  CASE WHEN p_partkey % 4 <> 0 THEN 'C' || p_partkey END AS product_code, p_size::DOUBLE AS qty, p_brand AS barcode, p_size AS sequence FROM part""")
def q_snapshot_round_trip(spark, folder):
    """Packagings with the codes of their products, written as a snapshot and read back."""
    part = tables.table(spark, folder, "part")
    key = F.col("p_partkey")
    packagings = part.select(key.alias("id"), F.when(F.col("p_size") % 2 == 0, "Roll").otherwise("Case").alias("name"), key.alias("product_id"),
                             F.col("p_size").cast("double").alias("qty"), F.col("p_brand").alias("barcode"), F.col("p_size").alias("sequence"))
    products = part.select(key.alias("product_id"), F.when(key % 4 != 0, F.concat(F.lit("C"), key.cast("string"))).alias("product_code"))
    path = fresh_path(spark, "snapshot")
    sinks.write_snapshot(packagings, products, part.limit(0).select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("value")), path)
    return tables.read_snapshot_folder(spark, path)[0]


@job(f"""WITH {NEGATIVE_SQL}
SELECT product_id, quantity AS old_value, CASE WHEN kind = 'kit' THEN 'skipped' ELSE 'done' END AS status,
  CASE WHEN kind = 'kit' THEN 'a kit has no stock of its own' ELSE '' END AS error FROM negative""", "stock_balance")
def q_action_log(spark, folder):
    """What was done about each negative stock, as the log written by the run tells."""
    kit = F.col("kind") == "kit"
    log = sinks.action_log(q_negative_stock(spark, folder), "product_id", F.col("quantity"), F.when(kit, "skipped").otherwise("done"),
                           F.when(kit, "a kit has no stock of its own").otherwise(""))
    path = fresh_path(spark, "log")
    sinks.write_report(log, path)
    return spark.read.schema(log.schema).json(path)


AUDIT = ("table_name", "n_rows", "n_orphans", "n_duplicate_keys", "status")


@job(f"""WITH found AS ({JOBS["q_preflight"].sql})
SELECT row_number() OVER (ORDER BY table_name) + 2 AS line_no, '| ' || concat_ws(' | ', {", ".join(AUDIT)}) || ' |' AS line FROM found
UNION ALL SELECT 1, '| {" | ".join(AUDIT)} |' UNION ALL SELECT 2, '{"|" + "---|" * len(AUDIT)}'""")
def q_audit_report(spark, folder):
    """The audit of all tables, written as JSON lines and shown as Markdown."""
    audit, path = q_preflight(spark, folder).select(*AUDIT), fresh_path(spark, "audit")
    sinks.write_report(audit, path)
    return sinks.markdown_lines(spark.read.schema(audit.schema).json(path), ["table_name"])


@job("""SELECT coalesce(replace(replace(trim(package_name), '/', '_'), ' ', '_'), '') AS token, uom,
  CASE WHEN regexp_matches(lower(uom), 'lb|kg|pound|ft|foot|feet') THEN 'measure' WHEN regexp_matches(lower(uom), 'thousand|million') THEN 'aggregate' ELSE 'discrete' END AS unit_class,
  count(*) AS n_lines FROM move_line GROUP BY ALL""", "move_line")
def q_names_and_units(spark, folder):
    """File names of pallets and classes of units."""
    lines = S.move_line(spark, folder)
    return (lines.groupBy("package_name", "uom").agg(F.count(F.lit(1)).alias("n_lines"))
            .select(F.coalesce(X.safe_token(F.col("package_name")), F.lit("")).alias("token"), "uom", Q.unit_class(F.col("uom")).alias("unit_class"), "n_lines"))


@job(r"""SELECT page_id, regexp_replace(replace(url, '://', '://user' || page_id || ':p@ss@'), '(://[^:/@]+):[^/]*@', '\1:***@') AS masked,
  CASE WHEN page_id % 3 = 0 THEN 'a,c' WHEN page_id % 3 = 1 THEN 'a, c' ELSE 'c' END AS kept FROM pages""")
def q_url_cleanup(spark, folder):
    """Passwords in addresses, and items taken out of a comma list."""
    pages, number = tables.table(spark, folder, "pages"), F.col("page_id").cast("string")
    given = F.replace(F.col("url"), F.lit("://"), F.concat(F.lit("://user"), number, F.lit(":p@ss@")))
    items = F.when(F.col("page_id") % 3 == 0, "a,b,c").when(F.col("page_id") % 3 == 1, "a, b, c").otherwise("b,c, b ")
    return pages.select("page_id", X.mask_password(given).alias("masked"), X.drop_items(items, ["b"]).alias("kept"))


@job("""WITH t AS (SELECT *, max(ts) OVER () - INTERVAL 600 SECONDS AS since FROM events)
SELECT event_type, count(*) FILTER (WHERE ts >= since) AS n_recent, count(*) AS n_rows,
  ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000)::BIGINT AS duration_s FROM t GROUP BY event_type""")
def q_recent_window(spark, folder):
    """Events since a cutoff before the newest one, and how long each kind of event went on."""
    events = tables.table(spark, folder, "events")
    newest = events.agg(V.cutoff(F.max("ts"), 600).alias("_since"))  # one row
    return (events.join(F.broadcast(newest), F.lit(True)).groupBy("event_type")
            .agg(F.count_if(F.col("ts") >= F.col("_since")).alias("n_recent"), F.count(F.lit(1)).alias("n_rows"), V.seconds_between(F.min("ts"), F.max("ts")).alias("duration_s")))
