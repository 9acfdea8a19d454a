"""Target-distribution importance resampling: documents are drawn by how much more their words occur in target texts.

Texts become hashed bags of word runs in Arrow kernels: lower case, split at everything that is no word, flatten, and
encode as a dictionary. Runs of several words are shifted dictionary indices put together, so a checksum is taken once
for each distinct run of a slice and not for each occurrence. The gain of a bucket is the logarithm of its share among the
target texts over its share among all documents; a document's weight is the mean gain of its features. Adding a Gumbel
number made from the key and taking the largest sums draws without replacement in proportion to exp(weight).

Two passes read the texts: one counts the buckets (a task hands on one count per bucket it met), one takes gains. The
ranks need no sort of all rows: scores are whole numbers in a bounded range, so the rows above a score are known from a
histogram, and only rows of one and the same score are put in order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantledger.llm.common import text_or_empty, text_slices, written

#: What separates words: ASCII that is neither a digit nor (after lower-casing) a letter.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Longest run of words that counts as one feature.
RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
BYTES_AT_ONCE = 8 << 20


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and for runs of 1, 2, ... words: the text of each occurrence, ascending, and its bucket."""
    words = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BREAKS)
    flat, rows = pc.list_flatten(words), pc.list_parent_indices(words)
    real = pc.greater(pc.binary_length(flat), 0)
    encoded = flat.filter(real).dictionary_encode()
    rows = rows.filter(real).to_numpy()
    word = encoded.indices.to_numpy().astype(np.int64)
    spelled = [w.encode() for w in encoded.dictionary.to_pylist()]
    crcs = [zlib.crc32(w) for w in spelled]
    run, owner, found = word, rows, []
    for size in range(1, longest + 1):
        if size > 1:
            # A run goes on with the word size - 1 places further, if that stands in the same text.
            ahead = rows[size - 1:]
            same = owner[:len(ahead)] == ahead
            pairs = (run[:len(ahead)] * max(1, len(spelled)) + word[size - 1:])
            distinct, run = np.unique(pairs, return_inverse=True)
            crcs = [zlib.crc32(b" " + spelled[p % len(spelled)], crcs[p // len(spelled)]) for p in distinct.tolist()]
            owner = np.where(same, ahead, -1)
        taken = pa.array(np.array(crcs, np.int64) % buckets).take(pa.array(run)).to_numpy()
        found.append((owner[owner >= 0], taken[owner >= 0]))
    return np.bincount(rows, minlength=len(texts)), found


def _counted(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for part in text_slices(batches, "_text", BYTES_AT_ONCE):
        for _, taken in features(part.column("_text"), longest, buckets)[1]:
            total += np.bincount(taken, minlength=buckets)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])


def _weighed(batches: Iterator[pa.RecordBatch], gains: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    gain = pa.array(gains)
    for part in text_slices(batches, "_text", BYTES_AT_ONCE):
        words, found = features(part.column("_text"), longest, len(gains))
        held, gained = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
        for rows, taken in found:
            if len(rows):
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                gained[rows[starts]] += np.add.reduceat(gain.take(pa.array(taken)).to_numpy(), starts)
                held += np.bincount(rows, minlength=part.num_rows)
        weight = np.where(held > 0, gained // np.maximum(held, 1), 0)
        yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(x, pa.int64()) for x in (words, held, weight))],
                                         names=["_id", "_words", "n_features", "weight"])


def bucket_counts(rows: DataFrame, text_col: str = "text", longest: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all rows: at most ``buckets`` numbers on the driver."""
    counted = (rows.select(text_or_empty(text_col).alias("_text"))
               .mapInArrow(partial(_counted, longest=longest, buckets=buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    total = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        total[bucket] = n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in ``target`` over its share in ``source``."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + size) / ((s + 1) * (all_target + size))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number g that follows from seed and key alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = RUN,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: (_id, n_features, weight, score, rank), all long but the id.

    Of the rows with at least ``least_words`` words, ``percent`` in 100 (rounded down) with the highest scores are drawn; they
    have ranks 1, 2, ... by falling score, equal scores by rising id (null ids last), and the others have none. A
    null or empty text has no features and weight 0. A null id counts as an empty one in the Gumbel number. Repeated rows are rows of
    their own with one score, and get ranks one after another. Texts of any length are read whole. Without target texts every bucket's target
    count is 0. An empty table gives an empty result; columns other than the two named are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    kind = dict(docs.dtypes)[id_col]
    weighed = (docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
               .mapInArrow(partial(_weighed, gains=gains, longest=longest), f"_id {kind}, _words long, n_features long, weight long"))
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed)), "scored")
    # Scores lie in a bounded range: 1000 ln of a 64-bit count, and of a Gumbel number made of 32 bits.
    levels = sorted(((s, n) for s, n in scored.where(F.col("_words") >= least_words).groupBy("score").count().collect()), reverse=True)
    drawn = percent * sum(n for _, n in levels) // 100
    before, so_far = [], 0
    for score, n in levels:
        if so_far >= drawn:
            break
        before.append((score, so_far))
        so_far += n
    ahead = docs.sparkSession.createDataFrame(before, "score long, _before long")
    bar = before[-1][0] if before else None
    could = F.lit(False) if bar is None else (F.col("_words") >= least_words) & (F.col("score") >= bar)
    place = F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("_id"), "n_features", "_words"))
    ranked = scored.where(could).join(F.broadcast(ahead), "score").withColumn("rank", F.col("_before") + place)
    columns = ["_id", "n_features", "weight", "score"]
    return (ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
            .unionByName(scored.where(~could).select(*columns, F.lit(None).cast("long").alias("rank"))))
