"""Join of documents on the Jaccard similarity of their word shingles, by prefixes under several global orders.

1. Every document gives the start of its set under a hash order, long enough that two linked documents share several
   shingles of it. Shingles are counted over all documents; documents with too few that occur elsewhere cannot
   have a link and leave.
2. The remaining documents give their whole sets, and shingles are counted again. The global orders put rare shingles
   first (by the power of two of the count) and differ in how they order equal counts. A shingle no other document
   holds can only be a difference, so it shortens what has to be compared.
3. Documents that share a prefix shingle under the first order are compared with one centre per shingle, the document
   with the fewest shingles of its own. Linked ones form components. What a centre did not reach meets, shingle by
   shingle, only documents of other components.
4. A pair is compared in full only if it also shares prefix shingles under the other orders.

Counting exchanges one row per range of shingles and unit of documents: a unit asks for a shingle once, however many
of its documents hold it, so a shingle in very many documents weighs no more than the number of units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantledger.llm.common import keep_rows, raw_digest, text_or_empty, written
from plantledger.llm.components import components
from plantledger.llm.shingles import shingle_sets

PERCENT = 80
#: Shingles that two linked documents share in their first part at least, as a share of the smaller set.
SHARED_PART = 30
UNIT_SHINGLES = 250_000
#: Multipliers that give the orders; the first also orders the first part.
ORDERS = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
UNIT = "unit string, sets binary, sizes binary, counts binary, shingles binary"
ANSWER = "unit string, shingles binary, held binary"


def _least(size: np.ndarray | int):
    """Shingles that a set of this size shares with any linked one."""
    return -(-PERCENT * size // 100)


def _agreed(size: np.ndarray | int):
    return np.maximum(1, size // SHARED_PART)


def _first_part(size: int) -> int:
    return int(min(size, size - _least(size) + _agreed(size)))


def _ranks(shingles: np.ndarray, order: int) -> np.ndarray:
    x = shingles * ORDERS[order]
    return x ^ (x >> np.uint64(31))


def _packed(shingles: np.ndarray) -> bytes:
    """48 bits of each number: the high 16 of all, then the low 32 of all."""
    short = shingles >> np.uint64(8)
    return (short >> np.uint64(32)).astype("<u2").tobytes() + short.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u2", n).astype(np.uint64) << np.uint64(32) | np.frombuffer(data, "<u4", n, offset=2 * n)


class _Unit:
    """Collects documents, each set once, until there are enough shingles for a row."""

    def __init__(self, label: str) -> None:
        self._label, self._number = f"{label}-{TaskContext.get().partitionId()}", 0
        self._reset()

    def _reset(self) -> None:
        self._seen, self._sets, self._sizes, self._parts, self.size = set(), [], [], [], 0

    def add(self, name: bytes, size: int, part: np.ndarray) -> None:
        if name not in self._seen:
            self._seen.add(name)
            self._sets.append(name)
            self._sizes.append(size)
            self._parts.append(part)
            self.size += len(part)

    def row(self) -> tuple:
        found = (f"{self._label}-{self._number}", b"".join(self._sets), np.array(self._sizes, "<u4").tobytes(),
                 np.array([len(p) for p in self._parts], "<u4").tobytes(), _packed(np.concatenate(self._parts)))
        self._number += 1
        self._reset()
        return found


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


UNIT_FIELDS = [("unit", pa.string()), ("sets", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("shingles", pa.binary())]


def _first_parts(batches: Iterator[pa.RecordBatch], label: str) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each unit of first parts."""
    unit, schema = _Unit(label), None
    for batch in batches:
        schema = pa.schema([("_id", batch.schema.field("_id").type), ("_raw", pa.string()), ("_set", pa.binary()), ("n", pa.int64()), *UNIT_FIELDS])
        rows = []
        for number, raw, found in zip(batch.column("_id").to_pylist(), batch.column("_raw").to_pylist(),
                                      shingle_sets(batch.column("_text").to_pylist())):
            name = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
            rows.append((number, raw, name, len(found), *[None] * 5))
            if len(found):
                part = _first_part(len(found))
                ranks = _ranks(found, 0)
                unit.add(name, len(found), found[np.argpartition(ranks, part - 1)[:part]] if part < len(found) else found)
            if unit.size >= UNIT_SHINGLES:
                rows.append((*[None] * 4, *unit.row()))
        yield _batch(rows, schema)
    if schema and unit.size:
        yield _batch([(*[None] * 4, *unit.row())], schema)


def _whole_sets(batches: Iterator[pa.RecordBatch], label: str) -> Iterator[pa.RecordBatch]:
    unit, schema = _Unit(label), pa.schema(UNIT_FIELDS)
    for batch in batches:
        for name, found in zip(batch.column("_set").to_pylist(), shingle_sets(batch.column("_text").to_pylist())):
            unit.add(name, len(found), found)
            if unit.size >= UNIT_SHINGLES:
                yield _batch([unit.row()], schema)
    if unit.size:
        yield _batch([unit.row()], schema)


def _questions(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each unit with the number of its documents that hold them, by ranges of shingles."""
    schema = pa.schema([("range", pa.int32()), ("unit", pa.string()), ("shingles", pa.binary()), ("held", pa.binary())])
    for batch in batches:
        for unit, data in zip(batch.column("unit").to_pylist(), batch.column("shingles").to_pylist()):
            shingles, held = np.unique(_unpacked(data), return_counts=True)
            place = ((shingles >> np.uint64(32)).astype(np.int64) * ranges) >> 16
            cuts = np.flatnonzero(np.diff(place)) + 1
            for part, count, at in zip(np.split(shingles, cuts), np.split(held, cuts), place[np.concatenate(([0], cuts))]):
                yield _batch([(int(at), unit, _packed(part << np.uint64(8)), count.astype("<u4").tobytes())], schema)


def _answers(table: pa.Table) -> pa.Table:
    """For each unit, its shingles of this range that more than one document holds, and how many hold them."""
    units = table.column("unit").to_pylist()
    parts = [_unpacked(x) for x in table.column("shingles").to_pylist()]
    shingles = np.concatenate(parts)
    held = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("held").to_pylist()]).astype(np.int64)
    order = np.argsort(shingles, kind="stable")
    first = np.concatenate(([True], shingles[order][1:] != shingles[order][:-1]))
    sums = np.add.reduceat(held[order], np.flatnonzero(first))
    total = np.empty(len(shingles), np.int64)
    total[order] = sums[np.cumsum(first) - 1]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    rows = [(u, _packed(p[t > 1] << np.uint64(8)), np.minimum(t[t > 1], 0xFFFFFFFF).astype("<u4").tobytes())
            for u, p, t in zip(units, parts, np.split(total, cuts))]
    schema = pa.schema([("unit", pa.string()), ("shingles", pa.binary()), ("held", pa.binary())])
    return pa.Table.from_batches([_batch([r for r in rows if r[1]], schema)])


def _counted(units: DataFrame) -> DataFrame:
    """``ANSWER`` rows for ``units``."""
    ranges = min(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    asked = units.mapInArrow(partial(_questions, ranges=ranges), "range int, unit string, shingles binary, held binary")
    return asked.groupBy("range").applyInArrow(_answers, ANSWER)


def _known(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    shingles = np.concatenate([np.empty(0, np.uint64), *(_unpacked(x) for x in answers.column("shingles").to_pylist())])
    held = np.concatenate([np.empty(0, "<u4"), *(np.frombuffer(x, "<u4") for x in answers.column("held").to_pylist())])
    order = np.argsort(shingles)
    return shingles[order], held[order]


def _holders(shingles: np.ndarray, known: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How many documents hold each shingle; 1 for those nobody answered for."""
    if not len(known):
        return np.ones(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return np.where(known[at] == shingles, held[at], 1).astype(np.int64)


def _documents(row: dict) -> Iterator[tuple[bytes, int, slice]]:
    sizes, counts = np.frombuffer(row["sizes"], "<u4"), np.frombuffer(row["counts"], "<u4")
    ends = np.cumsum(counts)
    for i, (size, end, count) in enumerate(zip(sizes.tolist(), ends.tolist(), counts.tolist())):
        yield row["sets"][i * 16:i * 16 + 16], size, slice(end - count, end)


def _may_link(units: pa.Table, answers: pa.Table) -> pa.Table:
    """Sets whose first part holds enough shingles that occur elsewhere."""
    known, held = _known(answers)
    out = []
    for row in units.to_pylist():
        shared = _holders(_unpacked(row["shingles"]), known, held) > 1
        out += [name for name, size, at in _documents(row) if shared[at].sum() >= _agreed(_least(size))]
    return pa.table({"_set": pa.array(out, pa.binary())})


CANDIDATE = "shingle long, at int, _set binary, n int, own int, shared binary, classes binary"


def _prefixes(units: pa.Table, answers: pa.Table) -> pa.Table:
    """A row for each set that can still have a link, and one for each shared shingle in its first prefix."""
    known, held = _known(answers)
    out = []
    for row in units.to_pylist():
        shingles = _unpacked(row["shingles"])
        classes = np.log2(_holders(shingles, known, held)).astype(np.uint8) + 0
        single = _holders(shingles, known, held) == 1
        for name, size, at in _documents(row):
            own = int(single[at].sum())
            if size - own < _least(size):
                continue
            shared, kind = shingles[at][~single[at]], classes[at][~single[at]]
            out.append((None, None, name, size, own, _packed(shared << np.uint64(8)), kind.tobytes()))
            for at, shingle in enumerate(_prefix(shared, kind, size, own, 0).tolist(), own):
                out.append((shingle, at, name, size, own, None, None))
    schema = pa.schema([("shingle", pa.int64()), ("at", pa.int32()), ("_set", pa.binary()), ("n", pa.int32()), ("own", pa.int32()), ("shared", pa.binary()), ("classes", pa.binary())])
    return pa.Table.from_batches([_batch(out, schema)])


def _prefix(shared: np.ndarray, classes: np.ndarray, size: int, own: int, order: int) -> np.ndarray:
    """The shared shingles within the prefix: those of its own come first in every order and match nothing."""
    length = size - _least(size) + 1 - own
    return shared[np.lexsort((_ranks(shared, order), classes))[:max(length, 0)]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that share prefix shingles under the other orders too, and are similar."""
    for batch in batches:
        a, b = [], []
        for row in batch.to_pylist():
            sides = []
            for s in "ab":
                shingles, classes = _unpacked(row[f"shared_{s}"]), np.frombuffer(row[f"classes_{s}"], np.uint8)
                sides.append((shingles, [_prefix(shingles, classes, row[f"n_{s}"], row[f"own_{s}"], k) for k in (1, 2)]))
            (one, heads), (other, tails) = sides
            if all(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(heads, tails)):
                both = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * both >= PERCENT * (row["n_a"] + row["n_b"] - both):
                    a.append(row["a"])
                    b.append(row["b"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _within_reach(a: str, b: str) -> Column:
    """Whether two sets can be similar if this is their first common shingle: enough must be left from its place on in both.

    The first common shingle of a similar pair passes, so the pair is found there; at most others it is not repeated.
    """
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    left = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return left * (100 + PERCENT) >= (n + m) * PERCENT


def _verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    pairs = written(pairs.distinct(), f"{label}-pairs")
    for s in "ab":
        side = sets.select(F.col("_set").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "own", "shared", "classes")])
        pairs = pairs.join(side, s)
    return written(pairs.mapInArrow(_linked, "a binary, b binary"), f"{label}-links")


def _ordered_pair(a: str, b: str) -> list[Column]:
    one, other = F.col(f"{a}._set"), F.col(f"{b}._set")
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def set_components(candidates: DataFrame) -> DataFrame:
    """(node, label) of every set that is similar to another: the components of similarity."""
    sets = candidates.where("shared is not null").dropDuplicates(["_set"])
    posts = candidates.where("shingle is not null").select("shingle", "at", "_set", "n", "own")
    centres = written(posts.groupBy("shingle").agg(F.min(F.struct("own", "n", "_set", "at")).alias("c"), F.max("_set").alias("x"), F.min("_set").alias("y"))
                      .where("x <> y").select("shingle", "c.*"), "centres")
    p, c = posts.alias("p"), centres.alias("c")
    to_centre = (p.join(c, F.col("p.shingle") == F.col("c.shingle")).where(F.col("p._set") != F.col("c._set"))
                 .where(_within_reach("p", "c")).select(*_ordered_pair("p", "c")))
    labels = components(_verified(to_centre, sets, "centre"))
    shared = posts.join(centres.select("shingle", F.col("_set").alias("centre")), "shingle")
    named = written(shared.join(labels, shared["_set"] == labels["node"], "left")
                    .select("shingle", "at", "_set", "n", "centre", F.coalesce("label", "_set").alias("label")), "labelled")
    middle = written(named.where("_set = centre").select("shingle", F.col("label").alias("middle")).distinct(), "middles")
    apart = written(named.join(middle, "shingle").where("label <> middle").drop("middle"), "apart")
    o, q = apart.alias("o"), named.alias("q")
    across = (o.join(q, F.col("o.shingle") == F.col("q.shingle"))
              .where((F.col("o.label") != F.col("q.label")) & (F.col("q._set") != F.col("o.centre"))).where(_within_reach("o", "q"))
              .select(*_ordered_pair("o", "q")))
    # Links between components join whole components, so only their labels go through the search again.
    more = _verified(across, sets, "across")
    for side in "ab":
        more = more.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    joined = components(more.select(*[F.coalesce(f"label_{s}", s).alias(s) for s in "ab"]))
    low = joined.select(F.col("node").alias("label"), F.col("label").alias("low"))
    return labels.join(low, "label", "left").select("node", F.coalesce("low", "label").alias("label")).unionByName(
        joined.join(labels.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (_id, n_shingles, component_id, _raw, _set).

    A document's set is its distinct runs of five words (lower case, split at ASCII blanks; all its words if there are
    fewer). Two documents link when the sets' intersection is at least 80 % of their union; ``component_id`` is the
    smallest id reachable over links. A null, empty or blank text has no shingle, no link and its own id. Documents with
    equal sets are linked and stand for one set. A null id keeps its row and takes the component's smallest id, null if
    all are null. An empty table gives an empty result; columns other than the two named are not read.
    """
    source = docs.select(F.col(id_col).alias("_id"), raw_digest(text_col).alias("_raw"), text_or_empty(text_col).cast("binary").alias("_text"))
    kind = dict(source.dtypes)["_id"]
    first = written(source.mapInArrow(partial(_first_parts, label="first"), f"_id {kind}, _raw string, _set binary, n long, {UNIT}"), "first-parts")
    rows = first.where("unit is null").select("_id", "_raw", "_set", "n")
    units = first.where("unit is not null").select("unit", "sets", "sizes", "counts", "shingles")
    able = written(units.groupBy("unit").cogroup(_counted(units).groupBy("unit")).applyInArrow(_may_link, "_set binary").distinct(), "able")
    chosen = written(rows.join(able, "_set").groupBy("_set").agg(F.min(F.struct("_raw", "_id")).alias("c")).select("_set", "c.*"), "chosen")
    texts = (source.alias("s").join(chosen.alias("c"), (F.col("s._raw") == F.col("c._raw")) & F.col("s._id").eqNullSafe(F.col("c._id")))
             .select("c._set", "s._text"))
    whole = written(texts.mapInArrow(partial(_whole_sets, label="whole"), UNIT), "whole-sets")
    candidates = written(whole.groupBy("unit").cogroup(_counted(whole).groupBy("unit")).applyInArrow(_prefixes, CANDIDATE), "prefixes")
    labels = written(set_components(candidates), "set-labels")
    named = written(rows.join(labels, rows["_set"] == labels["node"], "left").select(
        "_id", "_raw", "_set", F.col("n").alias("n_shingles"), F.coalesce("label", "_set").alias("_group")), "groups")
    lowest = written(named.where("_group is not null").groupBy("_group").agg(F.min("_id").alias("component_id")), "components")
    return (named.where("_group is not null").join(lowest, "_group").select("_id", "n_shingles", "component_id", "_raw", "_set", "_group")
            .unionByName(named.where("_group is null").withColumn("component_id", F.col("_id"))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id (null ids last); same columns.

    Texts without words have no links and all stay. Of rows that repeat id and text one stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    rows = written(found.groupBy("_id", "_raw", "_group").agg(F.count("*").alias("_rows")), "near-rows")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_raw").alias("raw"))
    best = rows.where("_group is not null").groupBy("_group").agg(F.min(order).alias("b"))
    kept = best.join(rows, "_group").where(F.col("b.id").eqNullSafe(F.col("_id")) & (F.col("b.raw") == F.col("_raw"))).select("_id", "_raw", "_rows")
    return keep_rows(docs, kept.unionByName(rows.where("_group is null").select("_id", "_raw", "_rows")), id_col, text_col)
