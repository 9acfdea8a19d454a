"""Typed readers for the given tables, and the general source operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table with its fixed schema (no inference pass over the files)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def catalog(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder, each a Parquet file or a folder of them; only paths are read."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.parquet").select(F.regexp_extract("path", r"/([^/]+)\.parquet(?:/|$)", 1).alias("name"))
    return sorted(r["name"] for r in files.distinct().collect())  # a name per table


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table the library writes itself; without rows as long as nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def missing_and_extra(df: DataFrame, declared: T.StructType) -> tuple[list[str], list[str]]:
    """Columns the declaration has and ``df`` lacks, and the reverse (schema only, no job)."""
    have, want = set(df.columns), set(declared.fieldNames())
    return sorted(want - have), sorted(have - want)


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns both sides have, under the same type, in the order of ``a``."""
    other = dict(b.dtypes)
    return [name for name, kind in a.dtypes if other.get(name) == kind]


def shared_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both sides hold in their shared columns, once each; NULL equals NULL."""
    columns = shared(a, b)
    return a.select(*columns).intersect(b.select(*columns))


def search(
    df: DataFrame,
    where: Column | None = None,
    fields: Sequence[str] | None = None,
    order: Sequence[Column] = (),
    limit: int | None = None,
) -> DataFrame:
    """Filtered read: predicate, field list, order, optional limit; all of it reaches the scan."""
    out = df if where is None else df.filter(where)
    if order:
        out = out.orderBy(*order)
    if fields is not None:
        out = out.select(*fields)
    return out if limit is None else out.limit(limit)


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in ``ids`` (a one-column frame), once each."""
    return df.join(ids.select(key), key, "left_semi")


def stacked_counts(frames: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Row count per named table as one small frame."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """Partitioned relational scan: ``key`` is cut into ``parts`` ranges read side by side."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", name)
            .option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
            .option("numPartitions", parts).load())


SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("snapshot_at", T.StringType()),
    T.StructField("packagings", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("product_code", T.StringType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("barcode", T.StringType()),
        T.StructField("sequence", T.IntegerType()),
    ]))),
    T.StructField("saved_values", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]))),
])


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot document as two flat frames: packagings and saved values."""
    doc = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(path)
    packagings = doc.select(F.inline("packagings"))
    values = doc.select(F.inline("saved_values"))
    return packagings, values


def read_snapshot_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot written as JSON lines (see ``sinks.write_snapshot``)."""
    packaging = SNAPSHOT_SCHEMA["packagings"].dataType.elementType
    value = SNAPSHOT_SCHEMA["saved_values"].dataType.elementType
    return (spark.read.schema(packaging).json(f"{path}/packagings"),
            spark.read.schema(value).json(f"{path}/saved_values"))
