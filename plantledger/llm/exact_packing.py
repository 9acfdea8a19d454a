"""Packing of tokenised documents into sequences of a fixed length by exact complements.

Documents are tokenised and cut in one pass. How the pieces combine depends only on how many there are of each length,
at most as many numbers as a sequence has tokens, so the plan is made from that histogram: a few thousand patterns, each
a combination of lengths and how often it is used. Pieces are then numbered within their length, and the number alone
says which sequence a piece goes to and where; no piece meets another.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantledger.llm.common import raw_digest, text_or_empty, text_slices, written

CAPACITY = 2048
#: Closes every document.
END_ID = 0
#: A worker remembers words in two generations of this size: a full one becomes the old one, from which words still in
#: use come back. It saves work only, ids never depend on it.
WORDS_KEPT = 150_000
#: A word of one token that stands between words which are encoded together.
MARK = "|"
LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
#: A token never goes on from such a letter to such a sign or digit, so a word ends between them; signs of contractions and
#: of special tokens are not among these.
CLOSED = r"([a-zA-ZÀ-ÖØ-öø-ÿ])([!-&(-;=?@\[-`{}~])"
#: Bytes of text encoded at a time; a longer text is encoded alone.
BYTES_AT_ONCE = 8 << 20


class Encoder:
    """Token ids of whole texts, word by word.

    The tokenizer lowers case, drops white space and never looks across it, so the ids of a text are those of its
    words in order, and words met before are looked up. Words are what stands between ASCII white space, and where
    ``CLOSED`` ends one. All else is left to the tokenizer. Python handles each distinct word of some texts once; their
    single words are split, numbered and put together as arrays.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self._tokenizer = Tokenizer.from_file(path)
        # For words of Latin letters alone the steps before the merges change nothing but the case.
        self._letters = Tokenizer(self._tokenizer.model)
        self._letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._closes = np.zeros(self._tokenizer.get_vocab_size(), bool)  # tokens that end a word
        self._closes[[i for piece, i in self._tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._mark = self._ids(MARK)[0]

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> None:
        plain, rest = [], []
        for word in words:
            (plain if LETTERS.fullmatch(word) else rest).append(word)
        self._learn_letters(plain, [w.lower() for w in plain])
        self._learn_any(rest)

    def _learn_letters(self, words: list[str], lower: list[str]) -> None:
        ids = np.array(self._letters.encode_batch_fast([" ".join(lower)], add_special_tokens=False)[0].ids, dtype="<u4")
        body, begin = ids.tobytes(), 0
        for word, end in zip(words, (np.flatnonzero(self._closes[ids]) * 4 + 4).tolist(), strict=True):
            self._known[word] = body[begin:end]
            begin = end

    def _learn_any(self, words: list[str]) -> None:
        """Encodes words in one text, a mark after each; where the mark is also a part of some word, one by one."""
        for at in range(0, len(words), 500):
            some = words[at:at + 500]
            ids = np.array(self._ids("".join(f"{w} {MARK} " for w in some)), dtype="<u4")
            ends = np.flatnonzero(ids == self._mark).tolist()
            if len(ends) == len(some):
                body, begin = ids.tobytes(), 0
                for word, end in zip(some, ends):
                    self._known[word] = body[begin:end * 4]
                    begin = end * 4 + 4
            else:
                for word in some:
                    self._known[word] = np.array(self._ids(word), dtype="<u4").tobytes()

    def _looked_up(self, words: list[str]) -> list[bytes]:
        """The ids of each of these distinct words."""
        if len(self._known) > WORDS_KEPT:
            self._known, self._old = {}, self._known
        known, old = self._known, self._old
        known[""] = b""
        new = []
        for word in [w for w in words if w not in known]:
            if word in old:
                known[word] = old[word]
            else:
                new.append(word)
        self._learn(new)
        return [known[w] for w in words]

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        bodies = pa.array(texts, pa.binary()).cast(pa.string())
        # Lower case leaves special tokens written in capitals alone, so texts that may hold one stay as they are.
        bodies = pc.if_else(pc.match_substring(bodies, "<|"), bodies, pc.ascii_lower(bodies))
        lines = pc.ascii_split_whitespace(pc.replace_substring_regex(bodies, CLOSED, r"\1 \2"))
        words = lines.flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), " ")[0].as_py()
        found = self._looked_up(distinct.split(" "))
        number = words.indices.to_numpy()
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(counts) - counts  # in the ids of the distinct words
        sizes = counts[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        shift = (first[number] - ends[:-1]).astype(np.int32)  # a text has fewer than 2 ** 31 bytes
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(shift, sizes) + np.arange(ends[-1], dtype=np.int32)]
        borders = ends[lines.offsets.to_numpy()].tolist()
        return [ids[begin:end].tobytes() for begin, end in pairwise(borders)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    size, closing = capacity * 4, np.array([END_ID], dtype="<u4").tobytes()
    for part in text_slices(batches, "_text", BYTES_AT_ONCE):
        rows, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(encoder(path).encode(part.column("_text"))):
            ids += closing
            for k, begin in enumerate(range(0, len(ids), size)):
                body = ids[begin:begin + size]
                rows.append(i)
                piece.append(k)
                start.append(begin // 4)
                length.append(len(body) // 4)
                crc.append(zlib.crc32(body))
        taken = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [part.column("_id").take(taken), part.column("_raw").take(taken), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["_id", "_raw", "piece", "start", "length", "ids_crc32"])


class Pattern(NamedTuple):
    """``times`` sequences of pieces with these lengths, the longest first."""

    lengths: tuple[int, ...]
    times: int


class _Stock:
    """How many pieces there are of each length, and which sums of one, two and three of them exist."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.counts)
        self._bits = sum(1 << n for n in self.lengths)
        self._pairs: int | None = None

    def _pair_sums(self) -> int:
        if self._pairs is None:
            self._pairs = 0
            for n in self.lengths:
                self._pairs |= self._bits << n
        return self._pairs

    def take(self, lengths: tuple[int, ...]) -> int:
        """Uses the combination as often as the pieces last; how often that was."""
        need = {n: lengths.count(n) for n in lengths}
        times = min(self.counts.get(n, 0) // k for n, k in need.items())
        for n, k in need.items() if times else ():
            self.counts[n] -= k * times
            if not self.counts[n]:
                del self.counts[n]
                self.lengths.pop(bisect_left(self.lengths, n))
                self._bits &= ~(1 << n)
                self._pairs = None
        return times

    def _enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.counts.get(n, 0) >= lengths.count(n) for n in set(lengths))

    def _pair(self, gap: int, beside: tuple[int, ...], most: int) -> tuple[int, ...] | None:
        for a in reversed(self.lengths[:bisect_left(self.lengths, min(most, gap - 1) + 1)]):
            if 2 * a < gap:
                return None
            if self._bits >> (gap - a) & 1 and self._enough((*beside, a, gap - a)):
                return a, gap - a
        return None

    def complement(self, length: int, capacity: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside ``length`` exactly, the longest possible first."""
        gap = capacity - length
        if gap == 0:
            return ()
        if self._bits >> gap & 1 and self._enough((length, gap)):
            return (gap,)
        if self._pair_sums() >> gap & 1 and (pair := self._pair(gap, (length,), gap - 1)):
            return pair
        for a in reversed(self.lengths[:bisect_left(self.lengths, gap - 1)]):
            if 3 * a < gap:
                break
            if self._pair_sums() >> (gap - a) & 1 and (pair := self._pair(gap - a, (length, a), a)):
                return a, *pair
        return None


def packing_plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use every piece once: exact fills from the longest length down, then best fit for what is left."""
    stock, plan = _Stock(counts), []
    for length in sorted(counts, reverse=True):
        while stock.counts.get(length) and (rest := stock.complement(length, capacity)) is not None:
            plan.append(Pattern((length, *rest), stock.take((length, *rest))))
    open_by_gap: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if times and gap not in open_by_gap:
            insort(gaps, gap)
        if times:
            open_by_gap.setdefault(gap, []).append([lengths, times])

    for length in sorted(stock.counts, reverse=True):
        left = stock.counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                fit = capacity // length
                if left >= fit:
                    put((length,) * fit, left // fit)
                left %= fit
                if left:
                    put((length,) * left, 1)
                break
            gap = gaps[at]
            lengths, times = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap]
                gaps.pop(at)
            used = min(times, left)
            put((*lengths, length), used)
            put(lengths, times - used)
            left -= used
    return plan + [Pattern(lengths, times) for classes in open_by_gap.values() for lengths, times in classes]


def _places(plan: list[Pattern]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From (length, number within the length) to (sequence, offset)."""
    first, runs = 0, {}
    for pattern in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in pattern.lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            starts, bases, wheres = runs.setdefault(n, ([0], [], []))
            bases.append(first)
            wheres.append(np.array(where))
            starts.append(starts[-1] + len(where) * pattern.times)
        first += pattern.times

    def place(lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            starts, bases, wheres = runs[int(n)]
            run = np.searchsorted(starts, numbers[rows], side="right") - 1
            for k in np.unique(run):
                here = rows[run == k]
                at = numbers[here] - starts[k]
                sequence[here] = bases[k] + at // len(wheres[k])
                offset[here] = wheres[k][at % len(wheres[k])]
        return sequence, offset
    return place


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its token ids and ``END_ID``, so a null, empty or blank text is one piece of length 1. Documents longer
    than ``capacity`` are cut into full pieces and a rest. Repeated rows are documents of their own. Sequences hold
    their pieces without gaps from 0. An empty table gives an empty result; columns other than the two named are not read.
    ``tokenizer`` is the path of the vocabulary file, readable on every executor.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), raw_digest(text_col).alias("_raw"), text_or_empty(text_col).cast("binary").alias("_text"))
    kind = dict(source.dtypes)["_id"]
    pieces = written(source.mapInArrow(
        partial(_pieces, path=tokenizer, capacity=capacity),
        f"_id {kind}, _raw string, piece int, start long, length long, ids_crc32 long"), "pieces")
    # A length that very many pieces have is numbered in as many parts as there are tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("_id", "_raw", "piece"), F.lit(parts)))
    sizes = written(pieces.groupBy("length", "_part").agg(F.count("*").alias("_n")), "piece-counts")
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    place = _places(packing_plan(counts, capacity))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = place(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    order = W.partitionBy("length", "_part").orderBy("_id", "_raw", "piece")
    numbered = (pieces.withColumn("_number", F.row_number().over(order) - 1)
                .join(before.select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_part"]))
    return (numbered.withColumn("_at", placed("length", (F.col("_before") + F.col("_number")).cast("long")))
            .select("_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset"))
