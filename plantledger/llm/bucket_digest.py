"""Document fingerprints: quartile digests of hashed byte triplets, and how alike two digests are.

Every position of a text gives triplets of bytes (from a short window), each hashed to one of 256 buckets. The digest
says for each bucket in which quartile of the 256 counts it lies (two bits), and the length on a logarithmic scale.
The difference of two digests adds the quartile steps, a step over all quartiles counting double, and the steps
between the lengths; it is bounded by what two unrelated digests show on average, and likeness is one minus its share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantledger.llm.common import text_or_empty, written

BUCKETS = 256
#: Distances of the bytes of a triplet; gaps make buckets depend on the words of a text more than on its language.
TRIPLETS = ((0, 4, 9), (0, 5, 11))
FACTORS = (2_654_435_761, 2_246_822_519)
#: Cost of quartiles that are 0, 1, 2 or 3 apart, and of one step of the length code.
STEPS = np.array([0, 1, 2, 6])
LENGTH_STEP, LENGTH_BASE = 4, 1.25
#: The mean step cost of two independent quartiles is 26/16; more difference than that counts as none alike.
MOST = BUCKETS * 26 // 16
ROWS_AT_ONCE = 256


def quartiles(data: bytes) -> np.ndarray:
    """Quartile (0 to 3) of each bucket's count; texts below the window's length have no triplet and all zeros."""
    plain = np.frombuffer(data, dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for (i, j, k), factor in zip(TRIPLETS, FACTORS):
        places = len(plain) - k
        for start in range(0, max(places, 0), 1 << 20):  # long texts in steps, so that memory stays flat
            here = plain[start:start + min(1 << 20, places - start) + k].astype(np.uint32)
            n = len(here) - k
            value = here[i:i + n] | here[j:j + n] << np.uint32(8) | here[k:k + n] << np.uint32(16)
            counts += np.bincount((value * np.uint32(factor)) >> np.uint32(24), minlength=BUCKETS)
    bounds = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts[:, None] > bounds).sum(axis=1)


def digest(data: bytes) -> str:
    """130 hex digits: two for the length code, the rest for four buckets a byte."""
    codes = quartiles(data).reshape(-1, 4)
    length = min(255, round(math.log(len(data) + 1, LENGTH_BASE)))
    return bytes([length, *(codes * (64, 16, 4, 1)).sum(axis=1).tolist()]).hex()


def likeness(one: str, other: str) -> float:
    """1 for equal digests, down to 0 for those as far apart as unrelated ones or further."""
    a, b = (np.frombuffer(bytes.fromhex(x), dtype=np.uint8) for x in (one, other))
    gap = 0
    for shift in (6, 4, 2, 0):
        gap += int(STEPS[np.abs((a[1:] >> shift & 3).astype(int) - (b[1:] >> shift & 3))].sum())
    gap += LENGTH_STEP * abs(int(a[0]) - int(b[0]))
    return 1.0 - min(gap, MOST) / MOST


def spliced(own: str, following: str) -> str:
    """``own`` with its last half replaced by as much of the start of ``following``, or all of it."""
    half = len(own) // 2
    return own[:len(own) - half] + following[:half]


def _row(number, place, own, following, mark, mark_next):
    edited = spliced(own, following)
    other = digest(edited.encode())
    return (number, len(own), _sha(edited), mark, other, likeness(mark, other), likeness(mark, mark_next), "done", place, None)


def _sha(text: str) -> str:
    import hashlib
    return hashlib.sha256(text.encode()).hexdigest()


NAMES = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "_state", "_place", "_text"]


def _successors(kind: T.DataType):
    """Walks a sorted partition: each row meets the next; the first and the last are also handed on with their texts."""
    schema = T.StructType([
        T.StructField("_id", kind), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in NAMES[2:5]),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("_state", T.StringType()),
        T.StructField("_place", T.LongType()), T.StructField("_text", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow, place, last, rows = to_arrow_schema(schema), TaskContext.get().partitionId(), None, []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), arrow)], schema=arrow)
            rows.clear()
            return out

        for source in batches:
            for number, text in zip(source.column(0), source.column(1)):
                number, text = number.as_py(), text.as_py()
                mark = digest(text.encode())
                if last is None:
                    rows.append((number, len(text), None, mark, None, None, None, "head", place, text))
                else:
                    rows.append(_row(last[0], place, last[1], text, last[2], mark))
                last = (number, text, mark)
                if len(rows) >= ROWS_AT_ONCE:
                    yield batch()
        if last is not None:
            rows.append((last[0], len(last[1]), None, last[2], None, None, None, "tail", place, last[1]))
            yield batch()
    return walk, schema


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited form, and likenesses: (_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    The edited form of a text has its last half replaced from the start of the next text by falling id (rows of one
    id: by rising text; null ids last; after the last row comes the first, also for a table of one row). A null text
    is empty. Texts too short for a triplet differ by their lengths alone, so all empty texts are alike. An empty
    table gives an empty result; other columns are not read.

    Texts are sorted by ranges of ids in one shuffle. A partition lacks only the row after its last; each hands on
    its two border rows, and these, two a partition, meet by the number of their partition in a second small join.
    """
    spark = docs.sparkSession
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    order = [F.col("_id").desc_nulls_last()]
    walk, schema = _successors(source.schema["_id"].dataType)
    ranged = source.repartitionByRange(places, *order).sortWithinPartitions(*order, "_text")
    rows = written(ranged.mapInArrow(walk, schema), "fingerprints")
    done = rows.where("_state = 'done'").select(*NAMES[:7])
    # The row after a partition's last is the first of the next partition that has rows; after the last comes the first.
    held = sorted(r["_place"] for r in rows.where("_state = 'head'").select("_place").collect())  # a number per partition
    follows = spark.createDataFrame(list(zip(held, held[1:] + held[:1])), f"_place {dict(rows.dtypes)['_place']}, _next_place {dict(rows.dtypes)['_place']}")
    heads = rows.where("_state = 'head'").select(F.col("_place").alias("_next_place"), F.col("_text").alias("_next_text"), F.col("fingerprint").alias("_next_mark"))
    border = (rows.where("_state = 'tail'").select("_place", "_id", "_text", "fingerprint").join(F.broadcast(follows), "_place")
              .join(heads, "_next_place").select("_id", "_text", "fingerprint", "_next_text", "_next_mark"))

    def join_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(T.StructType(schema.fields[:7]))
        for source in batches:
            for at in range(source.num_rows):
                number, text, mark, next_text, next_mark = (column[0].as_py() for column in source.slice(at, 1).columns)
                row = _row(number, 0, text, next_text, mark, next_mark)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    return done.unionByName(border.mapInArrow(join_borders, T.StructType(schema.fields[:7])))
