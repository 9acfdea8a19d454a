"""Sampled segmentations of texts, without replacement, by an A* search over perturbed lattices; and decoding.

The lattice of a text holds every way to write it in pieces of the vocabulary. A piece's weight falls with its rank by
Zipf's law (the vocabulary has merge ranks, no frequencies). Weights summed backwards turn every edge into the
probability that a segmentation goes on with it, so the mass below any prefix is known exactly. The search gives the root
a Gumbel number; the children of a prefix get numbers whose maximum is their parent's. Prefixes leave the queue by falling
number, and whole segmentations leave it as an ordered sample without replacement. The number of the first one not
taken says with which probability each taken one was to be included.

No piece goes on over the start of a run of word marks, so lattices are built word by word and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from collections.abc import Iterator, Sequence
from functools import cache, partial
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantledger.llm.common import text_or_empty

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
#: Sharpness of the weights: 0 makes all pieces alike.
SHARPNESS = 1.0
SAMPLES = 3
#: Most word lattices a worker remembers; then it starts afresh.
WORDS_KEPT = 20_000
ROWS_AT_ONCE = 64


#: To a place of the word, with a log-probability, by ids.
Edge = tuple[int, float, tuple[int, ...]]


class Sample(NamedTuple):
    """``log_p`` of the segmentation, its perturbed ``score``, and the probability ``inclusion`` of being taken."""

    ids: list[int]
    log_p: float
    score: float
    inclusion: float


class Lattices:
    """Word lattices over the pieces of one model."""

    def __init__(self, path: str, sharpness: float) -> None:
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        self._words: dict[str, list[list[Edge]]] = {}
        # Pieces with ids and weight; beginnings of pieces that are none themselves have None.
        self._pieces: dict[str, tuple[tuple[int, ...], float] | None] = {}
        self._bytes: dict[int, int] = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self._bytes[int(piece[3:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece goes on over a word mark")
                for k in range(1, len(piece)):
                    self._pieces.setdefault(piece[:k], None)
                self._pieces[piece] = (i,), -sharpness * math.log(i + 2)
        self._sharpness = sharpness

    def _in_bytes(self, letter: str) -> tuple[tuple[int, ...], float]:
        """A letter without a piece of its own is written in bytes."""
        ids = tuple(self._bytes[b] for b in letter.encode())
        return ids, -self._sharpness * sum(math.log(i + 2) for i in ids)

    def of(self, word: str) -> list[list[Edge]]:
        """For each place of the word the edges that leave it."""
        known = self._words.get(word)
        if known is not None:
            return known
        if len(self._words) >= WORDS_KEPT:
            self._words.clear()
        pieces, size, exp = self._pieces, len(word), math.exp
        mass, known = [0.0] * (size + 1), [[]] * size
        for at in range(size - 1, -1, -1):
            ways, end = [], at
            while end < size:
                end += 1
                found = pieces.get(word[at:end], False)
                if found:
                    ways.append((end, found[1] + mass[end], found[0]))
                elif found is False:
                    break
            if not ways or ways[0][0] != at + 1:
                ids, weight = self._in_bytes(word[at])
                ways.append((at + 1, weight + mass[at + 1], ids))
            if len(ways) == 1:
                end, weight, ids = ways[0]
                mass[at] = weight
                known[at] = [(end, 0.0, ids)]
                continue
            top = max([w[1] for w in ways])
            total = 0.0
            for way in ways:
                total += exp(way[1] - top)
            mass[at] = total = top + math.log(total)
            known[at] = [(end, weight - total, ids) for end, weight, ids in ways]
        self._words[word] = known
        return known

    def marked(self, text: str) -> str:
        """The text as the model sees it."""
        return self.model.normalize(text)

    def sample(self, text: str, count: int, rng: random.Random) -> list[Sample]:
        """At most ``count`` distinct segmentations by falling score; fewer if the text has no more."""
        words = [self.of(w) for w in WORD.findall(self.marked(text))]
        log, exp, draw = math.log, math.exp, rng.random
        queue = [(0.0, 0, 0.0, 0, 0, None)]  # minus score, order of entry, log-probability, word, place, way so far
        entered, found = 0, []
        while queue and len(found) <= count:
            minus, _, log_p, word, at, way = heapq.heappop(queue)
            score = -minus
            while word < len(words):
                edges = words[word][at]
                if len(edges) == 1:
                    best = edges[0]
                else:
                    raised = [log_p + e[1] - log(-log(draw() or 5e-324)) for e in edges]
                    top = max(raised)
                    best = None
                    for edge, own in zip(edges, raised):
                        if own == top and best is None:
                            best = edge  # keeps its parent's score and is followed at once
                            continue
                        gap = own - top
                        over = score - own + (log(-math.expm1(gap)) if gap < 0 else -math.inf)
                        low = score - max(0.0, over) - math.log1p(exp(-abs(over)))
                        entered += 1
                        to = (word, edge[0]) if edge[0] < len(words[word]) else (word + 1, 0)
                        heapq.heappush(queue, (-low, entered, log_p + edge[1], *to, (way, edge[2])))
                way, log_p = (way, best[2]), log_p + best[1]
                word, at = (word, best[0]) if best[0] < len(words[word]) else (word + 1, 0)
            found.append((score, log_p, way))
        bar = found[count][0] if len(found) > count else -math.inf
        return [Sample(_unrolled(way), log_p, score, -math.expm1(-exp(min(log_p - bar, 700.0))) if bar > -math.inf else 1.0)
                for score, log_p, way in found[:count]]


def _unrolled(way) -> list[int]:
    parts = []
    while way is not None:
        way, ids = way
        parts.append(ids)
    return [i for ids in reversed(parts) for i in ids]


@cache
def lattices(path: str, sharpness: float) -> Lattices:
    return Lattices(path, sharpness)


def row_random(seed: int, *key: object) -> random.Random:
    """The same numbers for the same seed and key, on any machine."""
    return random.Random(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=16).digest())


OUTPUT = "sample int, ids array<int>, n_pieces int, log_p double, score double, inclusion double"


def _sampled(batches: Iterator[pa.RecordBatch], path: str, keys: int, count: int, sharpness: float, seed: int) -> Iterator[pa.RecordBatch]:
    lattice = lattices(path, sharpness)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            rows, out = [], []
            for i, (*key, text) in enumerate(zip(*(c.to_pylist() for c in part.columns))):
                for k, found in enumerate(lattice.sample(text, count, row_random(seed, *key))):
                    rows.append(i)
                    out.append((k, found.ids, len(found.ids), found.log_p, found.score, found.inclusion))
            kinds = [pa.int32(), pa.list_(pa.int32()), pa.int32(), *[pa.float64()] * 3]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)]
            keyed = [part.column(i).take(pa.array(rows, pa.int32())) for i in range(keys)]
            yield pa.RecordBatch.from_arrays([*keyed, *columns], names=[*part.schema.names[:keys], *(f.split()[0] for f in OUTPUT.split(", "))])


def sample_segmentations(rows: DataFrame, model: str, key_cols: Sequence[str], text_col: str = "text", count: int = SAMPLES,
                         sharpness: float = SHARPNESS, seed: int = 0) -> DataFrame:
    """(_key0, _key1, ..., sample, ids, n_pieces, log_p, score, inclusion): up to ``count`` rows for each row, best first.

    The segmentations of a row are distinct and follow from seed, key and text alone, so repeated rows repeat them. A text
    with fewer segmentations gives all it has, with inclusion 1; a null or empty text gives one without pieces. Null
    keys are a key like any other. An empty table gives an empty result, columns that are not named are not read. ``model``
    is the path of the vocabulary file, readable on every executor.
    """
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate(key_cols)]
    source = rows.select(*keys, text_or_empty(text_col).alias("_text"))
    kinds = dict(source.dtypes)
    schema = ", ".join([*(f"_key{i} {kinds[f'_key{i}']}" for i in range(len(keys))), OUTPUT])
    return source.mapInArrow(partial(_sampled, path=model, keys=len(keys), count=count, sharpness=sharpness, seed=seed), schema)


def decoded(ids: str, model: str):
    """Column: the text that a column of id lists stands for; a null list gives null."""
    def decode(lists: pd.Series) -> pd.Series:
        found = lattices(model, SHARPNESS).model
        return pd.Series([None if x is None else found.decode([int(i) for i in x]) for x in lists], dtype=object)
    return F.pandas_udf(decode, T.StringType())(F.col(ids))
