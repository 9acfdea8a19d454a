"""Language-model scores of texts by subword lattices: the probability of a text over all its segmentations.

The lattice of a word holds every way to write it, behind a word mark, in pieces of an existing vocabulary; a letter
without a piece of its own is written in bytes. A unigram model gives each piece a probability, and the forward recursion, in log
space, sums the products of all ways. No piece goes on over a word mark, so the lattice of a text is its words' lattices in
a row, and its probability their product, closed by the probability of the end.

The vocabulary's own scores (merge ranks, taken as Zipf's law) weight the ways first. Each round of expectation over
the words of the training texts gives each piece the mass it holds among all ways, and the prior keeps a share of the model.
Lattices are made once for each distinct word of the corpus, in a table of words and counts: masses are whole
numbers, so their sums do not depend on the order in which tasks end.

A text's words meet that table in two ways: the frequent ones, of which there can be only so many, go to every task, and
all others are joined with it, so no join key holds more than a small share of the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantledger.llm.common import text_or_empty, text_slices, written

MARK = "▁"
#: Stands for a mark that the text itself holds; no piece has it, so it is written in bytes.
OWN_MARK = 0x110000
#: A word counts as frequent if it is at least one in so many words; so many frequent words there are at most.
FREQUENT = 1 << 18
#: Longer words are joined, so that the frequent ones take a bounded space.
FREQUENT_BYTES = 64
#: Weight of the vocabulary's own scores, as so many pieces seen.
PRIOR = 10_000.0
ROUNDS = 3
#: Parts of a piece's mass in one occurrence.
UNIT = 1 << 16
BYTES_AT_ONCE = 4 << 20
#: Letters of the words whose lattices are made together.
LETTERS_AT_ONCE = 1 << 18


class Vocabulary:
    """The pieces of a model as a trie in sorted arrays, and the probabilities that their scores stand for.

    Pieces have their own ids; after the last one stands the end of a text. The prior of a piece falls with its rank by Zipf's law; byte pieces,
    which have no rank, come after all others.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        self.end = model.get_piece_size()
        prior = np.zeros(self.end + 1)
        self.bytes = np.zeros(256, np.int64)
        nodes: dict[tuple[int, int], int] = {}
        pieces = {}
        for i in range(self.end):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                prior[i] = 1 / (2 + self.end)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece goes on over a word mark")
                prior[i] = 1 / (2 - model.get_score(i))
                node = 0
                for letter in piece:
                    node = nodes.setdefault((node, ord(letter)), len(nodes) + 1)
                pieces[node] = i
        prior[self.end] = 1 / (2 + self.end)
        self.prior = prior / prior.sum()
        steps = sorted((node << 21 | letter, to) for (node, letter), to in nodes.items())
        self._steps, self._to = (np.array(x, np.int64) for x in zip(*steps))
        self._piece = np.full(len(nodes) + 1, -1, np.int64)
        self._piece[list(pieces)] = list(pieces.values())

    def edges(self, letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every piece found in ``letters``; ``ends`` says where the word of each letter ends."""
        start, node, size, found = np.arange(len(letters)), np.zeros(len(letters), np.int64), 0, []
        while len(start):
            key = node << 21 | letters[start + size]
            at = np.minimum(np.searchsorted(self._steps, key), len(self._steps) - 1)
            goes = self._steps[at] == key
            start, node, size = start[goes], self._to[at[goes]], size + 1
            whole = self._piece[node]
            found.append((start[whole >= 0], np.full((whole >= 0).sum(), size), whole[whole >= 0]))
            more = start + size < ends[start]
            start, node = start[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """The lattices of some words, walked side by side.

    Place ``p`` of a word stands for its first ``p`` letters, the mark included; places of all words are numbered through.
    """

    def __init__(self, words: list[str], pieces: Vocabulary) -> None:
        text = "".join([MARK + w for w in words])
        letters = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        first = np.cumsum(sizes) - sizes
        own = letters == ord(MARK)
        own[first] = False
        letters[own] = OWN_MARK
        start, size, piece = pieces.edges(letters, (first + sizes)[word])
        # A letter without a piece of its own: one edge, whose pieces are its bytes.
        plain = np.ones(len(letters), bool)
        plain[start[size == 1]] = False
        plain = np.flatnonzero(plain)
        spelled, which = np.unique(letters[plain], return_inverse=True)
        self._spelled = [pieces.bytes[list((MARK if c == OWN_MARK else chr(c)).encode())] for c in spelled.tolist()]
        start, size = np.concatenate([start, plain]), np.concatenate([size, np.ones(len(plain), np.int64)])
        piece = np.concatenate([piece, -1 - which])
        inside = start - first[word[start]]
        self.word, self.piece, self._from, self._to = word[start], piece, start + word[start], start + word[start] + size
        self._at, self._reached, self._sizes, self._first = inside, inside + size, sizes, first + np.arange(len(words))

    def _walk(self, weight: np.ndarray, back: bool) -> np.ndarray:
        """Log of the sum over all ways from the start of a word to each place, or (``back``) from there to its end."""
        total = np.full(int(self._sizes.sum()) + len(self._sizes), -np.inf)
        total[self._first + (self._sizes if back else 0)] = 0.0
        level, near, far = (self._at, self._from, self._to) if back else (self._reached, self._to, self._from)
        order = np.lexsort((near, -level if back else level))
        level, near, far, weight = level[order], near[order], far[order], weight[order]
        bounds = np.flatnonzero(np.diff(level, prepend=-1)).tolist() + [len(level)]
        for a, b in zip(bounds, bounds[1:]):
            heads = np.flatnonzero(np.diff(near[a:b], prepend=-1))
            total[near[a:b][heads]] = np.logaddexp.reduceat(total[far[a:b]] + weight[a:b], heads)
        return total

    def _weights(self, logs: np.ndarray) -> np.ndarray:
        spelled = np.array([logs[ids].sum() for ids in self._spelled] or [0.0])
        return np.where(self.piece >= 0, logs[self.piece], spelled[np.maximum(-1 - self.piece, 0)])

    def log_probabilities(self, logs: np.ndarray) -> np.ndarray:
        """Of each word, over all its ways."""
        return self._walk(self._weights(logs), back=False)[self._first + self._sizes]

    def masses(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece, in parts of ``UNIT``, for words that occur ``counts`` times."""
        weight = self._weights(logs)
        ahead, behind = self._walk(weight, back=False), self._walk(weight, back=True)
        whole = ahead[self._first + self._sizes]
        share = np.rint(np.exp(ahead[self._from] + weight + behind[self._to] - whole[self.word]) * UNIT).astype(np.int64) * counts[self.word]
        out = np.zeros(len(logs), np.int64)
        real = self.piece >= 0
        np.add.at(out, self.piece[real], share[real])
        for which, ids in enumerate(self._spelled):
            np.add.at(out, ids, share[self.piece == -1 - which].sum())
        return out


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of the texts, one after another, and the text each stands in."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, rows = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real).dictionary_encode(), rows.filter(real).to_numpy()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "_text", BYTES_AT_ONCE):
        words, rows = _words(part.column("_text"))
        learns = part.column("_learn").to_numpy(zero_copy_only=False)[rows]
        ids, size = words.indices.to_numpy(), len(words.dictionary)
        yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(np.bincount(ids[learns], minlength=size), pa.int64()),
                                          pa.array(np.bincount(ids, minlength=size), pa.int64())], names=["word", "c", "n"])


def _lattices(batches: Iterator[pa.RecordBatch], pieces: Vocabulary) -> Iterator[tuple[pa.RecordBatch, Lattice]]:
    """Words of like length go together: as many steps are walked as the longest has letters."""
    for part in text_slices(batches, "word", LETTERS_AT_ONCE):
        part = part.take(pc.sort_indices(pc.utf8_length(part.column("word"))))
        sizes = pc.utf8_length(part.column("word")).to_numpy()
        # One cut where the length passes each power of four.
        cuts = [0, *np.searchsorted(sizes, [4**k for k in range(3, 16)], side="right").tolist()]
        for a, b in zip(cuts, [*cuts[1:], part.num_rows]):
            if b > a:
                some = part.slice(a, b - a)
                yield some, Lattice(some.column("word").to_pylist(), pieces)


def _expected(batches: Iterator[pa.RecordBatch], path: str, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(logs), np.int64)
    for part, lattice in _lattices(batches, vocabulary(path)):
        total += lattice.masses(logs, part.column("c").to_numpy())
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["piece", "mass"])


def _scored(batches: Iterator[pa.RecordBatch], path: str, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, lattice in _lattices(batches, vocabulary(path)):
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lattice.log_probabilities(logs), pa.float64())], names=[*part.schema.names, "log_p"])


def _summed(batches: Iterator[pa.RecordBatch], frequent: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Per text: its words, and of the frequent ones how many are known and both sums; the others with their counts."""
    known_words = frequent.column("word")
    # One more row for the words that are not frequent; they add nothing here.
    known, base, log_p = (np.append(frequent.column(c).to_numpy(zero_copy_only=False), 0) for c in ("known", "base", "log_p"))
    number = TaskContext.get().partitionId() << 33
    for part in text_slices(batches, "_text", BYTES_AT_ONCE):
        words, rows = _words(part.column("_text"))
        place = pc.index_in(words.dictionary, value_set=known_words).fill_null(len(known_words)).to_numpy()[words.indices.to_numpy()]
        sums = [np.bincount(rows, weights=x[place], minlength=part.num_rows) for x in (known, base, log_p)]
        rare = place == len(known_words)
        pair, times = np.unique(rows[rare] * np.int64(max(1, len(words.dictionary))) + words.indices.to_numpy()[rare], return_counts=True)
        owner, which = pair // max(1, len(words.dictionary)), pair % max(1, len(words.dictionary))
        offsets = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
        lists = (pa.ListArray.from_arrays(offsets, x) for x in (words.dictionary.take(pa.array(which)), pa.array(times, pa.int64())))
        yield pa.RecordBatch.from_arrays(
            [part.column("_id"), pa.array(number + np.arange(part.num_rows), pa.int64()), pa.array(np.bincount(rows, minlength=part.num_rows), pa.int64()),
             pa.array(sums[0].astype(np.int64)), *(pa.array(x, pa.float64()) for x in sums[1:]), *lists],
            names=["_id", "_row", "_words", "_known", "_base", "_log_p", "_rare", "_times"])
        number += part.num_rows


def score_texts(docs: DataFrame, model: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
                prior: float = PRIOR, frequent: int = FREQUENT) -> DataFrame:
    """(_id, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    Tokens are the words between ASCII white space, A to Z in lower case, and one end per text. The rows where ``learn`` holds (null
    counts as false) are learned from. ``n_known`` tokens occur among the ``train_tokens`` learned from; ``base_score`` is
    the log10 probability under their smoothed counts, ``score`` the one under the subword lattices. A null text
    is an empty one, which is an end alone. Repeated rows count and are scored as often as they stand; ids are not used but handed on. Without
    rows to learn from the vocabulary's own scores hold alone. An empty table gives an empty result. Texts and words of any length are read whole.
    Columns that are not named are not read. ``model`` is the path of the vocabulary file, readable on every executor.
    """
    kind = dict(docs.dtypes)[id_col]
    learns = F.coalesce(learn.cast("boolean"), F.lit(False))
    source = docs.select(F.col(id_col).alias("_id"), learns.alias("_learn"), text_or_empty(text_col).alias("_text"))
    words = written(source.select("_text", "_learn").mapInArrow(_counted, "word string, c long, n long")
                    .groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    texts = source.where("_learn").count()
    trained, distinct, total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    trained, distinct = trained + texts, distinct + (texts > 0)

    pieces = vocabulary(model)
    with np.errstate(divide="ignore"):
        logs = np.log(pieces.prior)
        for _ in range(rounds):
            found = (words.where("c > 0").select("word", "c").mapInArrow(partial(_expected, path=model, logs=logs), "piece long, mass long")
                     .groupBy("piece").agg(F.sum("mass").alias("mass")).collect())  # as many rows as the vocabulary at most
            mass = prior * pieces.prior
            for piece, held in found:
                mass[piece] += held / UNIT
            mass[pieces.end] += texts
            logs = np.log(mass / mass.sum())
    base = F.log10((F.col("c") + F.lit(0.1)) / F.lit(trained + 0.1 * (distinct + 1)))
    table = written(words.mapInArrow(partial(_scored, path=model, logs=logs), "word string, c long, n long, log_p double")
                    .select("word", "n", (F.col("c") > 0).cast("long").alias("known"), base.alias("base"), "log_p"), "word-scores")
    often = (F.col("n") * F.lit(frequent) >= F.lit(total)) & (F.octet_length("word") <= FREQUENT_BYTES)
    top = table.where(often).select("word", "known", "base", "log_p").toArrow().combine_chunks()
    top = top.to_batches()[0] if top.num_rows else pa.RecordBatch.from_pylist([], schema=top.schema)
    rows = written(source.select("_id", "_text").mapInArrow(
        partial(_summed, frequent=top), f"_id {kind}, _row long, _words long, _known long, _base double, _log_p double, _rare array<string>, _times array<long>"),
        "text-words")
    rest = (rows.select("_row", F.inline(F.arrays_zip(F.col("_rare").alias("word"), F.col("_times").alias("times"))))
            .join(table.where(~often), "word").groupBy("_row")
            .agg(*(F.sum(F.col(c) * F.col("times")).alias(f"more_{c}") for c in ("known", "base", "log_p"))))
    end_base, end_log = math.log10((texts + 0.1) / (trained + 0.1 * (distinct + 1))), float(logs[pieces.end])
    whole = rows.drop("_rare", "_times").join(rest, "_row", "left")

    def with_rest(have: str, more: str) -> Column:
        return F.col(have) + F.coalesce(F.col(more), F.lit(0))

    return whole.select(
        "_id", (F.col("_words") + 1).alias("n_tokens"), (with_rest("_known", "more_known") + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(trained).cast("long").alias("train_tokens"), (with_rest("_base", "more_base") + F.lit(end_base)).alias("base_score"),
        ((with_rest("_log_p", "more_log_p") + F.lit(end_log)) / F.lit(math.log(10))).alias("score"))
