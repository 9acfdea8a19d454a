"""Stock: negatives and their correction, kits, FIFO lots, untracked stock, targets, product lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plantledger.functions.text import strip_prefix
from plantledger.operators.ordering import latest
from plantledger.sources import versions


def negative_stock(quants: DataFrame, locations: DataFrame, kits: DataFrame) -> DataFrame:
    """Negative stock at internal locations, split into real products and kits (which have none)."""
    internal = locations.filter(F.col("usage") == "internal").select("location_id")
    below = quants.filter(F.col("quantity") < 0).join(internal, "location_id", "left_semi")
    marked = below.join(kits.select("product_id", F.lit("kit").alias("_kit")), "product_id", "left")
    return marked.select("product_id", "location_id", "quantity", F.coalesce("_kit", F.lit("product")).alias("kind"))


def zero_adjustments(negatives: DataFrame) -> DataFrame:
    """Adjustments that bring negative products to zero, and what is still negative afterwards (kits)."""
    fixes = negatives.filter(F.col("kind") == "product").select(
        "product_id", "location_id", (-F.col("quantity")).alias("quantity"))
    after = (negatives.select("product_id", "location_id", "quantity").unionByName(fixes)
             .groupBy("product_id", "location_id").agg(F.sum(F.col("quantity").cast("decimal(18,2)")).alias("quantity"))
             .filter(F.col("quantity") < 0))
    return fixes.select(F.lit("adjust").alias("step"), "product_id", "location_id", "quantity").unionByName(
        after.select(F.lit("remaining").alias("step"), "product_id", "location_id",
                     F.col("quantity").cast("double").alias("quantity")))


MARKED = StructType([StructField("product_id", LongType()), StructField("old_type", StringType())])


def kit_flip(boms: DataFrame, markers: str, run_id: str) -> DataFrame:
    """Recipes with phantom ones turned normal; the touched ids are recorded at ``markers`` first.

    Refuses while a marker of an earlier flip is open, since it would lose those ids.
    """
    if not versions.open_entries(boms.sparkSession, markers, MARKED, ["product_id"]).isEmpty():
        raise ValueError("a marker of flipped recipes is open; restore it first")
    phantom = F.col("bom_type") == "phantom"
    versions.record(boms.filter(phantom).select(F.col("product_id").cast("bigint").alias("product_id"), F.col("bom_type").alias("old_type")), markers, run_id)
    return boms.withColumn("old_type", F.col("bom_type")).withColumn("bom_type", F.when(phantom, "normal").otherwise(F.col("bom_type")))


def kit_restore(boms: DataFrame, markers: str, run_id: str) -> DataFrame:
    """Outcome of a restore per open marker: flipped back, already phantom, or missing. The markers are closed by this run, so a
    second restore finds none; the outcomes are kept as the log of the run and read from there."""
    spark, current = boms.sparkSession, boms.select("product_id", F.col("bom_type").alias("_type"))
    open_ = versions.open_entries(spark, markers, MARKED, ["product_id"])
    outcome = F.when(F.col("_type").isNull(), "missing").when(F.col("_type") == "normal", "flipped").otherwise("already")
    log = open_.join(current, "product_id", "left").select(F.col(versions.RUN).alias("marked_by"), "product_id", outcome.alias("outcome"))
    versions.record(log, f"{markers}/log", run_id)
    told = versions.entries(spark, f"{markers}/log", log.schema, run_id)
    versions.retire(told.select(F.col("marked_by").alias(versions.RUN), "product_id"), markers, ["product_id"], run_id)
    return told.select("product_id", "outcome")


def onhand_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Products whose on-hand total differs between two states; both sides are summed first."""
    a = before.groupBy("product_id").agg(F.sum("quantity").alias("before"))
    b = after.groupBy("product_id").agg(F.sum("quantity").alias("after"))
    old, new = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    return (a.join(b, "product_id", "full_outer").filter(old != new)
            .select("product_id", old.alias("before"), new.alias("after"), (new - old).alias("change")))


def fifo_lot(quants: DataFrame, min_free: float = 1.0) -> DataFrame:
    """Oldest lot in stock with more than ``min_free`` unreserved, per product."""
    usable = quants.filter((F.col("location") == "Stock") & F.col("lot").isNotNull() & (F.col("quantity") > 0)
                           & (F.col("quantity") - F.col("reserved") > min_free))
    return latest(usable.select("product_id", "in_date", "lot", (F.col("quantity") - F.col("reserved")).alias("free")),
                  ["product_id"], ["in_date", "lot"], newest=False)


def untracked_stock(quants: DataFrame) -> DataFrame:
    """Positive stock without a lot per product, and the lot it is to be moved to."""
    loose = quants.filter((F.col("location") == "Stock") & F.col("lot").isNull() & (F.col("quantity") > 0))
    return loose.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_quants"), F.sum("quantity").alias("quantity")) \
        .withColumn("new_lot", F.concat(F.lit("LOT-"), F.col("product_id").cast("string")))


def stock_topup(quants: DataFrame, targets: DataFrame) -> DataFrame:
    """Shortfall to the target per (product, lot); nothing where stock suffices."""
    have = (quants.filter(F.col("location") == "Stock").groupBy("product_id", "lot")
            .agg(F.sum("quantity").alias("current")))
    joined = targets.join(have, ["product_id", "lot"], "left").withColumn(
        "current", F.coalesce("current", F.lit(0.0)))
    return joined.filter(F.col("current") < F.col("target")).select(
        "product_id", "lot", "current", "target", (F.col("target") - F.col("current")).alias("shortfall"))


def reservation_cover(quants: DataFrame) -> DataFrame:
    """Is everything on hand at the stock location reserved, per product."""
    return (quants.filter(F.col("location") == "Stock").groupBy("product_id")
            .agg(F.sum("quantity").alias("on_hand"), F.sum("reserved").alias("reserved"),
                 F.bool_and(F.col("quantity") == F.col("reserved")).alias("covered")))


def lookup(texts: DataFrame, products: DataFrame) -> DataFrame:
    """Product behind a free text: by id, then code, barcode, name; lowest id among equal names.

    Each text is resolved once, whatever number of rows ask for it.
    """
    out = texts.select("query_text").distinct()
    found = []
    for kind, key in (("id", F.col("product_id").cast("string")), ("code", F.col("code")),
                      ("barcode", F.col("barcode")), ("name", F.col("name"))):
        side = (products.filter(key.isNotNull()).groupBy(key.alias("_key"))
                .agg(F.min("product_id").alias(f"_{kind}")))
        out = out.join(side, F.col("query_text") == F.col("_key"), "left").drop("_key")
        found.append((kind, F.col(f"_{kind}")))
    matched = F.coalesce(*[F.when(hit.isNotNull(), F.lit(kind)) for kind, hit in found], F.lit("none"))
    return out.select("query_text", F.coalesce(*[hit for _, hit in found], F.lit(-1)).alias("product_id"),
                      matched.alias("matched_by"))


def search(products: DataFrame, text: str, n: int = 30) -> DataFrame:
    """Products whose name equals or contains ``text`` (any case), exact ones first, ``n`` rows."""
    exact = F.lower("name") == text.lower()
    return (products.filter(F.col("name").ilike(f"%{text}%"))
            .select("product_id", "name", exact.alias("exact"))
            .orderBy(F.desc("exact"), "product_id").limit(n))


def search_as_written(products: DataFrame, text: str, pattern: str, prefix: str) -> DataFrame:
    """Products whose name holds ``text`` in these very letters (``like``), or fits the whole ``pattern`` with ``%`` and ``_``
    (``=like``), and their names without a known ``prefix``."""
    name = F.col("name")
    return (products.select("product_id", "name", F.contains(name, F.lit(text)).alias("holds"), name.like(pattern).alias("fits"))
            .filter("holds or fits").withColumn("short_name", strip_prefix(name, prefix)))


def newest_with_free_stock(productions: DataFrame, quants: DataFrame, least: float) -> DataFrame:
    """Newest order whose finished lot has at least ``least`` free and unpacked in stock, over all orders.

    ``productions``: production_id, lot. ``quants``: lot, quantity, package_name.
    """
    free = (quants.filter(F.col("package_name").isNull() & (F.col("quantity") > 0)).groupBy("lot")
            .agg(F.sum("quantity").alias("free")).filter(F.col("free") >= least))
    return productions.join(free, "lot").orderBy(F.desc("production_id"), "lot").limit(1)
