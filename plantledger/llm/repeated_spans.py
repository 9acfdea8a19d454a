"""Byte strings of 200 that occur again anywhere in a corpus, by refining buckets of q-grams.

Every window of 200 bytes points to the smallest of its 32-grams, so equal windows point to equal places, and windows
in a row that share the place are one run. A run is cut into pieces by how far its windows reach before the place, so
that the windows of a piece have some 160 bytes in common. Pieces start in the bucket of their 32-gram; a bucket is refined
by what stands in the buckets of later offsets: 32 bytes become the common bytes of a piece, become 200, two
overlapping 200 become the whole run. A piece whose common bytes occur nowhere else drops out; a run whose whole
text occurs again is settled at once; windows are told apart one by one only in pieces that are neither, and in one
copy of each settled run that shares a bucket with such a piece.

Bucket identifiers are numbers that follow from the content (96 bits where they decide), so refining needs no exchange; what
is exchanged is how often an identifier occurs. A unit of documents asks once for each of its identifiers, so a
string in very many documents weighs no more than the number of units. Texts are dealt to units once, in a table
that is bucketed by unit, and stay where they are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantledger.llm.common import text_or_empty, written
from plantledger.session import fresh_path

LENGTH, GRAM = 200, 32
PLACES = LENGTH - GRAM + 1
#: Windows of one piece reach before the place by one of so many lengths.
REACHES = 43
BYTES_AT_ONCE = 1 << 17
SEPARATOR = b"\0"
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
#: States of a piece. Of all runs with one text that occurs again one is the keeper: it speaks for the windows of all.
DEAD, SETTLED, KEEPER, OPEN, BESIDE_OPEN = 0, 1, 2, 3, 4
#: Kinds of identifiers: those that only sort out (48 bits are exchanged) and those that decide (96 bits).
NARROW, WIDE = 0, 1
#: Kind of the answers that name the wide identifiers whose keeper is in the unit: the first unit that holds them.
KEPT = 3
QUESTION = "kind int, range int, unit int, ids binary, held binary"
ANSWER = "unit int, kind int, ids binary"


@cache
def _values(k: int) -> np.ndarray:
    return np.random.default_rng(31 + k).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@cache
def _powers(k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASES[k], pow(BASES[k], -1, 1 << 64)):
        row = np.full(size, np.uint64(base), dtype=np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[2]
    x = (x ^ (x >> np.uint64(29))) * MIX[3]
    return x ^ (x >> np.uint64(32))


class Batch:
    """Some texts one after the other, the runs of their windows, and bucket identifiers of any place."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(SEPARATOR.join(texts) + SEPARATOR, dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.begins, self.ends = ends - 1 - np.array([len(t) for t in texts]), ends - 1
        size = 1 << max(12, (len(self.data)).bit_length())
        self._sums, self._down = [], []
        for k in range(2):
            up, down = _powers(k, size)
            self._sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(_values(k)[self.data] * up[:len(self.data)]))))
            self._down.append(down)
        self.place, self.low, self.high = self._runs()
        self.run, self.first, self.last, self._class = self._pieces()

    def grams(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bucket of the 32 bytes from each place."""
        return (self._sums[k][at + GRAM] - self._sums[k][at]) * self._down[k][at]

    def _runs(self):
        """Place, first and last start of the windows that point to it."""
        n = len(self.data) - GRAM + 1
        if n < PLACES:
            return [np.empty(0, np.int64)] * 3
        least = _mixed((self._sums[0][GRAM:GRAM + n] - self._sums[0][:n]) * self._down[0][:n])
        least &= np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= PLACES:  # least[i] is the smallest of the next ``width``
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = PLACES - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        counts = np.maximum(self.ends - self.begins - LENGTH + 1, 0)  # windows of each text
        start = np.arange(counts.sum()) + np.repeat(self.begins - np.cumsum(counts) + counts, counts)
        point = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], point[1:] != point[:-1]))) if len(point) else np.empty(0, np.int64)
        last = np.concatenate((new[1:], [len(point)])) - 1 if len(new) else new
        return point[new], start[new], start[last]

    def _pieces(self):
        """Run, first and last window start, and class of reach of every piece; runs in order, far reaches first."""
        far, near = (self.place - self.low) // REACHES, (self.place - self.high) // REACHES
        counts = far - near + 1
        run = np.repeat(np.arange(len(counts)), counts)
        reach = far[run] - (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        first = np.maximum(self.low[run], self.place[run] - reach * REACHES - REACHES + 1)
        return run, first, np.minimum(self.high[run], self.place[run] - reach * REACHES), reach

    def cores(self) -> np.ndarray:
        """Buckets of the bytes that all windows of a piece, of any length, have in common."""
        start = self.place[self.run] - self._class * REACHES
        size = LENGTH - np.minimum(REACHES - 1, PLACES - 1 - self._class * REACHES)
        found = _mixed(self._class.astype(np.uint64) + MIX[4])
        for offset in (0, 32, 64, 96, size - GRAM):
            found = _mixed(found * MIX[0] + self.grams(start + offset, 0) + MIX[1])
        return _short(found)

    def _whole(self, at: np.ndarray, k: int) -> np.ndarray:
        found = np.zeros(len(at), np.uint64)
        for offset in (0, 32, 64, 96, 128, 160, LENGTH - GRAM):
            found = _mixed(found * MIX[0] + self.grams(at + offset, k) + MIX[1])
        return found

    def spans(self, runs: np.ndarray) -> np.ndarray:
        """96-bit buckets of the whole text that the windows of each run cover, and of where in it the place is."""
        low, high = self.low[runs], self.high[runs]
        form = ((high - low) * LENGTH + self.place[runs] - low).astype(np.uint64)
        return _wide([_mixed(self._whole(low, k) * MIX[0] + _mixed(self._whole(high, k) + form + MIX[k])) for k in range(2)])

    def windows(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of some pieces, and their 96-bit buckets."""
        counts = self.last[pieces] - self.first[pieces] + 1
        starts = np.repeat(self.first[pieces] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return starts, _wide([self._whole(starts, k) for k in range(2)])


def _wide(halves: list[np.ndarray]) -> np.ndarray:
    return np.stack((halves[0], halves[1] >> np.uint64(32) << np.uint64(32)), axis=1)


def batches_of(texts: list[bytes]) -> Iterator[Batch]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > BYTES_AT_ONCE:
            yield Batch(part)
            part, size = [], 0
        part.append(text)
        size += len(text) + 1
    if part:
        yield Batch(part)


class Ids(NamedTuple):
    """Identifiers of a kind with the number of places that hold each."""

    kind: int
    ids: np.ndarray
    held: np.ndarray


def _pack(kind: int, ids: np.ndarray) -> bytes:
    if kind != NARROW:
        return np.ascontiguousarray(ids[:, 0]).tobytes() + (ids[:, 1] >> np.uint64(32)).astype("<u4").tobytes()
    short = ids >> np.uint64(16)
    return (short >> np.uint64(32)).astype("<u2").tobytes() + short.astype("<u4").tobytes()


def _unpack(kind: int, data: bytes) -> np.ndarray:
    if kind != NARROW:
        n = len(data) // 12
        return np.stack((np.frombuffer(data, np.uint64, n), np.frombuffer(data, "<u4", n, offset=8 * n).astype(np.uint64) << np.uint64(32)), axis=1)
    n = len(data) // 6
    return (np.frombuffer(data, "<u2", n).astype(np.uint64) << np.uint64(32) | np.frombuffer(data, "<u4", n, offset=2 * n)) << np.uint64(16)


def _short(ids: np.ndarray) -> np.ndarray:
    return ids >> np.uint64(16) << np.uint64(16)


def _counted(kind: int, ids: np.ndarray, weights: np.ndarray | None = None) -> Ids:
    """Distinct identifiers in order, with summed weights (1 if not given)."""
    weights = np.ones(len(ids), np.int64) if weights is None else weights
    order = np.lexsort((ids[:, 1], ids[:, 0])) if kind != NARROW else np.argsort(ids, kind="stable")
    ids, weights = ids[order], weights[order]
    if not len(ids):
        return Ids(kind, ids, weights)
    other = ids[1:] != ids[:-1]
    first = np.flatnonzero(np.concatenate(([True], other.any(axis=1) if kind != NARROW else other)))
    return Ids(kind, ids[first], np.add.reduceat(weights, first))


def _asked(unit: int, counted: Ids, ranges: int) -> Iterator[tuple]:
    lead = counted.ids[:, 0] if counted.kind == WIDE else counted.ids
    place = ((lead >> np.uint64(48)).astype(np.int64) * ranges) >> 16
    cuts = np.flatnonzero(np.diff(place)) + 1
    if len(lead):
        for ids, held, at in zip(np.split(counted.ids, cuts), np.split(counted.held, cuts), place[np.concatenate(([0], cuts))]):
            yield counted.kind, int(at), unit, _pack(counted.kind, ids), np.minimum(held, 0xFFFFFFFF).astype("<u4").tobytes()


def _answer(table: pa.Table, least: int) -> pa.Table:
    """To each unit those of its identifiers that at least ``least`` places hold; all rows are of one kind and range."""
    kind, units = table.column("kind")[0].as_py(), table.column("unit").to_pylist()
    parts = [_unpack(kind, x) for x in table.column("ids").to_pylist()]
    held = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("held").to_pylist()]).astype(np.int64)
    total = _counted(kind, np.concatenate(parts), held)
    often = total.ids[total.held >= least]
    free, rows = np.ones(len(often), bool), []
    for unit, ids in sorted(zip(units, parts), key=lambda x: x[0]):
        found = ids[_among(kind, ids, often)]
        rows.append((unit, kind, _pack(kind, found)))
        if kind == WIDE:
            at = np.flatnonzero(free)
            mine = at[_among(WIDE, often[at], found)]
            free[mine] = False
            rows.append((unit, KEPT, _pack(WIDE, often[mine])))
    return _table([r for r in rows if r[2]], [("unit", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary())])


def _among(kind: int, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``ids`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(ids), bool)
    if kind == NARROW:
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return known[at] == ids
    lead = known[:, 0]
    at = np.minimum(np.searchsorted(lead, ids[:, 0]), len(known) - 1)
    found = (known[at] == ids).all(axis=1)
    more = np.flatnonzero(~found & (lead[at] == ids[:, 0]))  # several known ones share the first half
    while len(more):
        at[more] += 1
        more = more[at[more] < len(known)]
        more = more[lead[at[more]] == ids[more, 0]]
        hit = (known[at[more]] == ids[more]).all(axis=1)
        found[more[hit]] = True
        more = more[~hit]
    return found


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    schema = pa.schema(fields)
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


QUESTION_FIELDS = [("kind", pa.int32()), ("range", pa.int32()), ("unit", pa.int32()), ("ids", pa.binary()), ("held", pa.binary())]


def _texts(table: pa.Table) -> list[bytes]:
    order = np.argsort(table.column("_row").to_numpy())
    return table.column("_text").take(pa.array(order)).to_pylist()


def _first_questions(table: pa.Table, ranges: int) -> pa.Table:
    """The common bytes of every piece and the whole text of every run of a unit."""
    unit, cores, spans = table.column("unit")[0].as_py(), [np.empty(0, np.uint64)], [np.empty((0, 2), np.uint64)]
    for batch in batches_of(_texts(table)):
        cores.append(batch.cores())
        spans.append(batch.spans(np.arange(len(batch.place))))
    return _table([*_asked(unit, _counted(NARROW, np.concatenate(cores)), ranges), *_asked(unit, _counted(WIDE, np.concatenate(spans)), ranges)],
                  QUESTION_FIELDS)


def _answered(answers: pa.Table) -> dict[int, np.ndarray]:
    """Sorted identifiers of each kind."""
    found = {NARROW: [np.empty(0, np.uint64)], WIDE: [np.empty((0, 2), np.uint64)], KEPT: [np.empty((0, 2), np.uint64)]}
    for kind, data in zip(answers.column("kind").to_pylist(), answers.column("ids").to_pylist()):
        if kind in found:
            found[kind].append(_unpack(kind, data))
    return {kind: _counted(kind, np.concatenate(parts)).ids for kind, parts in found.items()}


#: The states of the pieces of a unit travel with the answers, as a row of this kind.
STATE = 2


def _states(answers: pa.Table) -> np.ndarray:
    for kind, data in zip(answers.column("kind").to_pylist(), answers.column("ids").to_pylist()):
        if kind == STATE:
            return np.frombuffer(data, np.uint8)
    return np.empty(0, np.uint8)


def _second_questions(table: pa.Table, answers: pa.Table, ranges: int) -> pa.Table:
    """States of the pieces, and the buckets of open ones and keepers, to learn which keepers stand beside an open one."""
    if not table.num_rows:
        return _table([], QUESTION_FIELDS)
    unit, known = table.column("unit")[0].as_py(), _answered(answers)
    states, ids, weights = [np.empty(0, np.uint8)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for batch in batches_of(_texts(table)):
        cores = batch.cores()
        again = _among(NARROW, cores, known[NARROW])
        runs = np.unique(batch.run[again])
        spans = batch.spans(runs)
        of_run = np.full(len(batch.place), DEAD, np.uint8)
        of_run[runs[_among(WIDE, spans, known[WIDE])]] = SETTLED
        of_run[runs[_among(WIDE, spans, known[KEPT])]] = KEEPER
        state = np.where(of_run[batch.run] > DEAD, of_run[batch.run], np.where(again, OPEN, DEAD)).astype(np.uint8)
        states.append(state)
        asks = state >= KEEPER
        ids.append(cores[asks])
        weights.append((state[asks] == OPEN).astype(np.int64))
    return _table([(STATE, -1, unit, np.concatenate(states).tobytes(), None),
                   *_asked(unit, _counted(NARROW, np.concatenate(ids), np.concatenate(weights)), ranges)], QUESTION_FIELDS)


def _third_questions(table: pa.Table, answers: pa.Table, ranges: int) -> pa.Table:
    """The windows of open pieces, and of keepers that share a bucket with one."""
    if not table.num_rows:
        return _table([], QUESTION_FIELDS)
    unit, known, state = table.column("unit")[0].as_py(), _answered(answers), _states(answers).copy()
    at, parts = 0, [Ids(WIDE, np.empty((0, 2), np.uint64), np.empty(0, np.int64))]
    for batch in batches_of(_texts(table)):
        here = state[at:at + len(batch.run)]
        at += len(here)
        keepers = np.flatnonzero(here == KEEPER)
        here[keepers[_among(NARROW, batch.cores()[keepers], known[NARROW])]] = BESIDE_OPEN
        parts.append(_counted(WIDE, batch.windows(np.flatnonzero(here >= OPEN))[1]))
    counted = _counted(WIDE, np.concatenate([p.ids for p in parts]), np.concatenate([p.held for p in parts]))
    return _table([(STATE, -1, unit, state.tobytes(), None), *_asked(unit, counted, ranges)], QUESTION_FIELDS)


def _removed(table: pa.Table, answers: pa.Table) -> pa.Table:
    order = np.argsort(table.column("_row").to_numpy())
    numbers = table.column("_id").take(pa.array(order))
    known, state, at, rows = _answered(answers), _states(answers), 0, []
    for batch in batches_of(_texts(table)):
        here = state[at:at + len(batch.run)]
        at += len(here)
        edges = np.zeros(len(batch.data) + LENGTH + 1, np.int32)
        settled = np.flatnonzero((here != DEAD) & (here != OPEN))
        np.add.at(edges, batch.first[settled], 1)
        np.add.at(edges, batch.last[settled] + LENGTH, -1)
        starts, ids = batch.windows(np.flatnonzero(here == OPEN))
        starts = starts[_among(WIDE, ids, known[WIDE])]
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + LENGTH, -1)
        gone = np.cumsum(edges)[:len(batch.data)] > 0
        for begin, end in zip(batch.begins.tolist(), batch.ends.tolist()):
            text, out = batch.data[begin:end], gone[begin:end]
            if not out.any():
                rows.append((end - begin, 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            runs = int(out[0]) + int(np.count_nonzero(out[1:] & ~out[:-1]))
            rows.append((end - begin, int(out.sum()), runs, hashlib.sha256(text[~out].tobytes()).hexdigest()))
    found = _table(rows, [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return found.add_column(0, "_id", numbers)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (_id, n_bytes, n_removed, n_spans, kept_sha256).

    A byte goes when a string of 200 bytes over it also starts at another place of the corpus, in the same text or in
    another; strings do not run from one text into the next and are judged on the input. Rows that repeat a text
    repeat its strings, so both lose them. Null and empty texts, and texts below 200 bytes, keep what they have. Null ids
    stay null, an empty table gives an empty result, columns other than the two named are not read.

    Texts are dealt evenly to as many units as there are shuffle partitions; a unit is handled in one task at a time.
    """
    spark = docs.sparkSession
    units = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(units, 1 << 16)
    dealt = (docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).cast("binary").alias("_text"), F.monotonically_increasing_id().alias("_row"))
             .withColumn("unit", F.pmod(F.xxhash64("_row"), F.lit(units)).cast("int")))
    name = f"dealt_{uuid.uuid4().hex}"
    (dealt.repartition(units, "unit").write.format("parquet").bucketBy(units, "unit").option("compression", "zstd").option("path", fresh_path(spark, "dealt-texts")).saveAsTable(name))
    texts = spark.table(name)
    kind = dict(texts.dtypes)["_id"]

    def answered(questions: DataFrame, least: int) -> DataFrame:
        return questions.where(F.col("kind") != STATE).groupBy("kind", "range").applyInArrow(lambda asked: _answer(asked, least), ANSWER)

    def with_states(questions: DataFrame, least: int) -> DataFrame:
        return answered(questions, least).unionByName(questions.where(F.col("kind") == STATE).select("unit", "kind", "ids"))

    first = texts.groupBy("unit").applyInArrow(lambda unit: _first_questions(unit, ranges), QUESTION)
    second = written(texts.groupBy("unit").cogroup(answered(first, 2).groupBy("unit")).applyInArrow(
        lambda unit, answers: _second_questions(unit, answers, ranges), QUESTION), "open-runs")
    third = written(texts.groupBy("unit").cogroup(with_states(second, 1).groupBy("unit")).applyInArrow(
        lambda unit, answers: _third_questions(unit, answers, ranges), QUESTION), "open-windows")
    return texts.groupBy("unit").cogroup(with_states(third, 2).groupBy("unit")).applyInArrow(
        _removed, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
