"""Exact duplicates by content-defined chunk recipes.

Each text, freed of white space, is cut where its own bytes say so. Chunks become identifiers that stand for their
content and not just for its hash, and a document becomes the ordered list of its identifiers, its recipe. Documents
are equal when their recipes are equal, so only recipes (16 bytes for about a kilobyte) are grouped and joined; text
moves once, as chunks that are combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantledger.llm.common import keep_rows, raw_digest, text_or_empty, written

#: What is deleted before texts are compared: space and the controls 9 to 13.
BLANKS = b" \t\n\x0b\x0c\r"
#: A cut follows the 8 bytes whose product with this odd number starts with CUT_BITS zero bits: 1 kB apart on average.
CUT_FACTOR, CUT_BITS = np.uint64(0x9E3779B97F4A7C15), 10
#: No chunk but the last is shorter or longer than this, whatever the text repeats.
SHORTEST, LONGEST = 256, 16_384
ROWS_AT_ONCE = 256


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last being its length; they depend on the content alone."""
    size = len(data)
    found = []
    for start in range(min(8, max(0, size - 7))):
        words = np.frombuffer(data, dtype="<u8", offset=start, count=(size - start) // 8)
        found.append(np.flatnonzero(words * CUT_FACTOR < np.uint64(1 << (64 - CUT_BITS))) * 8 + start + 8)
    places = np.sort(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
    ends, last = [], 0
    while size - last > SHORTEST:
        at = int(np.searchsorted(places, last + SHORTEST))
        end = min(int(places[at]) if at < len(places) else size, last + LONGEST, size)
        ends.append(end)
        last = end
    if last < size or not ends:
        ends.append(size)
    return ends


def _name(chunk: bytes, id_bytes: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=id_bytes).digest()


def _recipes(batches: Iterator[pa.RecordBatch], id_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            recipes, digests = [], []
            for text in part.column("_text"):
                data = text.as_py().translate(None, BLANKS)
                ends = cuts(data)
                recipes.append(b"".join(_name(data[a:b], id_bytes) for a, b in zip([0, *ends], ends)))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_raw"), part.column("_chars"), pa.array(recipes, pa.binary()), pa.array(digests, pa.string())],
                names=["_id", "_raw", "_chars", "_recipe", "_sha"])


def _chunks(batches: Iterator[pa.RecordBatch], id_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk; copies within a run of rows leave once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            seen = {}
            for text in batch.column("_text").slice(at, ROWS_AT_ONCE):
                data = text.as_py().translate(None, BLANKS)
                ends = cuts(data)
                for a, b in zip([0, *ends], ends):
                    seen[data[a:b]] = None
            chunks = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_name(c, id_bytes) for c in chunks], pa.binary()), pa.array(chunks, pa.binary())], names=["_hash", "_chunk"])


def _placed(batches: Iterator[pa.RecordBatch], id_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per place of a chunk, with its content, of documents that hold a hash with several contents."""
    for batch in batches:
        for key, text in zip(batch.column("_key"), batch.column("_text")):
            data = text.as_py().translate(None, BLANKS)
            ends = cuts(data)
            chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key.as_py()] * len(chunks), pa.string()), pa.array(range(len(chunks)), pa.int32()),
                 pa.array([_name(c, id_bytes) for c in chunks], pa.binary()), pa.array(chunks, pa.binary())],
                names=["_key", "_pos", "_hash", "_chunk"])


def document_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16) -> DataFrame:
    """(_id, _raw, _chars, _recipe, _sha, _fix) of every row.

    ``_recipe`` joins the chunk hashes in order. Where one hash has several contents, all but the first of them in
    byte order get a number, and ``_fix`` lists the places and numbers in the document, so that two rows have the same
    ``(_recipe, _fix)`` exactly when their texts without white space are the same. ``id_bytes`` is for tests.
    """
    source = docs.select(
        F.col(id_col).alias("_id"), raw_digest(text_col).alias("_raw"), F.char_length(text_or_empty(text_col)).cast("long").alias("_chars"),
        text_or_empty(text_col).cast("binary").alias("_text"))
    kind = dict(docs.dtypes)[id_col]
    recipes = written(source.mapInArrow(
        partial(_recipes, id_bytes=id_bytes), f"_id {kind}, _raw string, _chars long, _recipe binary, _sha string"), "recipes")
    contents = (source.select("_text").mapInArrow(partial(_chunks, id_bytes=id_bytes), "_hash binary, _chunk binary")
                .distinct())
    # Several contents for one hash: none are to be expected at 16 bytes, and whatever there are is told apart.
    repeated = written(contents.groupBy("_hash").count().where("count > 1").select("_hash"), "repeated-hashes")
    if repeated.isEmpty():
        return recipes.withColumn("_fix", F.lit(""))
    shared = written(contents.join(repeated, "_hash", "left_semi").groupBy("_hash").agg(F.min("_chunk").alias("_first")), "shared-hashes")
    hit = (recipes.select("_raw", F.explode(F.expr(
        f"transform(sequence(0, length(_recipe) div {id_bytes} - 1), i -> substring(_recipe, i * {id_bytes} + 1, {id_bytes}))")).alias("_hash"))
        .join(shared, "_hash", "left_semi").select("_raw").distinct())
    places = (source.select(F.col("_raw").alias("_key"), "_text").join(hit.withColumnRenamed("_raw", "_key"), "_key", "left_semi")
              .groupBy("_key").agg(F.first("_text").alias("_text"))
              .mapInArrow(partial(_placed, id_bytes=id_bytes), "_key string, _pos int, _hash binary, _chunk binary")
              .join(shared, "_hash").where("_chunk <> _first"))
    fixes = (places.select("_key", F.concat_ws(":", F.lpad(F.col("_pos").cast("string"), 12, "0"), F.hex("_chunk")).alias("_at"))
             .groupBy("_key").agg(F.concat_ws(",", F.sort_array(F.collect_list("_at"))).alias("_fix"))
             .withColumnRenamed("_key", "_raw"))
    return written(recipes.join(fixes, "_raw", "left").withColumn("_fix", F.coalesce("_fix", F.lit(""))), "recipes-told-apart")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16) -> DataFrame:
    """One row per row of ``docs``: (_id, keep_id, group_size, kept, text_sha256, _raw, _rows).

    Texts are equal when they are the same after deleting space and the controls 9 to 13; null counts as empty. Of
    equal texts the row with the most code points stays, then the smallest id; null ids come last and are kept only
    among themselves (``keep_id`` null). Rows that repeat both id and text are one row ``_rows`` times, and ``kept`` is
    true for one of them. Rows that share an id but not the text are rows of their own. All texts without a visible
    character form one group. An empty table gives an empty result. Columns other than the two named are not read.
    """
    recipes = document_recipes(docs, id_col, text_col, id_bytes)
    rows = recipes.groupBy("_id", "_raw", "_recipe", "_fix", "_sha", "_chars").agg(F.count("*").alias("_rows"))
    # Most code points, then ids before nulls, then the smallest id (its bits inverted sort the other way round).
    rows = rows.withColumn("_rank", F.struct("_chars", F.col("_id").isNotNull().alias("has"), F.bitwise_not("_id").alias("inverse"), "_raw"))
    # The table stands between the two shuffles so that a recipe with very many rows can be split when it is joined.
    best = written(rows.groupBy("_recipe", "_fix").agg(F.max("_rank").alias("_best"), F.sum("_rows").alias("group_size")), "groups")
    joined = rows.join(best, ["_recipe", "_fix"])
    stays = (F.col("_best._raw") == F.col("_raw")) & F.col("_best.inverse").eqNullSafe(F.col("_rank.inverse"))
    return (joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
            .select("_id", F.bitwise_not("_best.inverse").alias("keep_id"), "group_size", (stays & (F.col("_copy") == 1)).alias("kept"),
                    F.col("_sha").alias("text_sha256"), "_raw", "_rows"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row repeats; same columns, see ``exact_duplicates``."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select("_id", "_raw", "_rows")
    return keep_rows(docs, kept, id_col, text_col)
