"""Helpers the operators share: row identity, written intermediate tables, text expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantledger.session import fresh_path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe when an executor is lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def raw_digest(name: str) -> Column:
    """SHA-256 of the text as it stands; with the document id it names a row, since equal rows are interchangeable."""
    return F.sha2(text_or_empty(name).cast("binary"), 256)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``kept(_id, _raw, _rows)``, once each, with the columns of ``docs``.

    ``_rows`` is the number of rows of ``docs`` that share id and text. Only where it is over one is a group
    formed to leave a single row; all other rows pass through the join unchanged. A null id equals itself.
    """
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]  # names of the caller cannot clash with those used here
    at = dict(zip(names, inner))
    here = docs.toDF(*inner).withColumn("_text_raw", raw_digest(at[text_col]))
    joined = here.join(kept, (F.col("_text_raw") == F.col("_raw")) & F.col(at[id_col]).eqNullSafe(F.col("_id")))
    alone = joined.where("_rows = 1").select(*inner)
    one = joined.where("_rows > 1").dropDuplicates(["_id", "_raw"]).select(*inner)
    return alone.unionByName(one).toDF(*names)


def text_slices(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices whose column ``name`` holds about ``most`` bytes, or in single rows beyond that."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
