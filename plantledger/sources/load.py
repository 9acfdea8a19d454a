"""Loading text tables with a reject table: good rows, rejects and counts from one pass over each source."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plantledger.operators.migrate import judged
from plantledger.sources.tables import stored

#: Kinds whose text can be unreadable.
KINDS = ("bigint", "date", "double")
COUNTS = ("rows_read", "rows_loaded", "rows_rejected", *(f"bad_{kind}" for kind in KINDS), "kept_malformed")
STATS = "run_id string, table_name string, status string, error string, " + ", ".join(f"{c} bigint" for c in COUNTS)
OUTCOME = StructType([StructField("run", StringType()), StructField("outcome", StringType())])


class Load(NamedTuple):
    """One table: ``read`` gives its rows as text, ``target`` the kind of each column."""

    name: str
    read: Callable[[], DataFrame]
    target: Mapping[str, str]


def _one_of(names: Sequence[str]) -> Callable[[Column], Column]:
    return lambda column: column.isin(*names)


def load(job: Load, path: str, run: str) -> dict[str, int]:
    """Append one table below ``path`` in one pass over its source, and return the counts taken on the way.

    Rows that are loaded have the typed columns, rejects the text of the row and the columns at fault; both are parts of one
    table, told apart by ``outcome``. The same run again writes over itself.
    """
    rows, malformed = judged(job.read(), job.target)
    seen, good = Observation(), F.col("reason") == ""
    faults = {kind: F.count_if(F.exists(F.split("reason", ", "), _one_of([c for c, k in job.target.items() if k == kind])))
              for kind in KINDS if kind in job.target.values()}
    counts = {"rows_read": F.count(F.lit(1)), "rows_loaded": F.count_if(good), "rows_rejected": F.count_if(~good),
              **{f"bad_{kind}": count for kind, count in faults.items()}, "kept_malformed": F.count_if(good & malformed)}
    split = rows.withColumns({"text": F.when(~good, F.col("text")), "outcome": F.when(good, "loaded").otherwise("rejected"), "run": F.lit(run)})
    (split.observe(seen, *(count.alias(name) for name, count in counts.items())).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run", "outcome").parquet(f"{path}/{job.name}"))
    return {name: seen.get.get(name) or 0 for name in COUNTS}


def load_all(spark: SparkSession, jobs: Sequence[Load], path: str, run: str, at_once: int = 4) -> DataFrame:
    """Load all tables side by side; one row of counts per table, kept under ``path``. One that fails does not stop the others."""
    def one(job: Load) -> tuple:
        try:
            counts = load(job, path, run)
            return run, job.name, "ok", "", *(counts[c] for c in COUNTS)
        except Exception as error:  # noqa: BLE001
            return run, job.name, "failed", f"{type(error).__name__}: {error}", *[0] * len(COUNTS)

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(one, jobs))
    spark.createDataFrame(rows, STATS).coalesce(1).write.mode("overwrite").parquet(f"{path}/_stats/run={run}")
    return spark.read.schema(STATS).parquet(f"{path}/_stats/run={run}")


def outcomes(spark: SparkSession, path: str, name: str, columns: StructType | None = None) -> DataFrame:
    """All stored rows of a table with ``run``, ``outcome`` and the given columns; none if it was never loaded."""
    return stored(spark, f"{path}/{name}", StructType([*(columns.fields if columns else []), *OUTCOME.fields]))


def loaded(spark: SparkSession, path: str, name: str, typed: StructType) -> DataFrame:
    """The good rows of a table; ``typed`` are its columns as they were loaded."""
    return outcomes(spark, path, name, typed).filter(F.col("outcome") == "loaded").select(*typed.names)


def rejected(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rejects of a table: the row as text and the columns at fault."""
    columns = StructType.fromDDL("text map<string, string>, reason string")
    return outcomes(spark, path, name, columns).filter(F.col("outcome") == "rejected").select("run", "text", "reason")
