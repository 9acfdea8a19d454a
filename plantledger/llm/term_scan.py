"""Ranked lexical search: an automaton of all terms that the items ask for reads every document, no index is built.

Letters and digits of a text become lower case and everything else a space, byte by byte, with a space at both ends. Each
term stands in an Aho-Corasick automaton between two spaces, so only whole terms come out, and neighbours share
the space between them. The outputs are the numbers of the terms; a table from term to items adds each document's shares
up for all items that hold the term.

Items are taken in blocks of a bounded size. For each block the documents are read twice: once for the number of documents that
hold each term, once for the scores. A task keeps the best documents per item as it goes on and hands on no more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantledger.llm.common import text_or_empty, text_slices, written

#: Every byte to itself, to its lower case, or to a space where it is ASCII and neither a letter nor a digit.
FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: The items of one block hold about this many bytes of distinct terms, or are one item.
BLOCK_BYTES = 4 << 20
TOP = 50
BYTES_AT_ONCE = 4 << 20
#: Cells of the table of documents and items that is summed at once.
CELLS = 1 << 20
#: First rounds of the final ranking, so that no task meets all candidates of an item.
SALTS = 32


class Block(NamedTuple):
    """Terms of some items in byte order, and for the term at ``i`` the items ``items[starts[i]:starts[i + 1]]``."""

    terms: list[str]
    starts: np.ndarray
    items: np.ndarray
    n_items: int


def _folded(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The texts with a space at both ends, and the number of terms of each."""
    found = [t.as_buffer().to_pybytes().translate(FOLD) for t in texts]
    return [f" {t.decode()} " for t in found], np.fromiter((len(t.split()) for t in found), np.int64, len(found))


_AUTOMATA: dict[tuple[str, ...], object] = {}


def automaton(terms: Sequence[str]):
    """Whole terms to their numbers; a worker remembers the last one. None without terms."""
    import ahocorasick
    key = tuple(terms)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(f" {term} ", i)
        made.make_automaton()
        _AUTOMATA[key] = made if terms else None
    return _AUTOMATA[key]


def _hits(found, text: str) -> Counter:
    return Counter(map(itemgetter(1), found.iter(text))) if found else Counter()


def _statistics(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents with each term; at -1 the documents with any term, at -2 all terms of all documents."""
    found, held, with_terms, length = automaton(terms), np.zeros(len(terms), np.int64), 0, 0
    for part in text_slices(batches, "_text", BYTES_AT_ONCE):
        texts, sizes = _folded(part.column("_text"))
        with_terms, length = with_terms + int((sizes > 0).sum()), length + int(sizes.sum())
        for text in texts:
            hit = _hits(found, text)
            held[np.fromiter(hit, np.int64, len(hit))] += 1
    met = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *met.tolist()], pa.int64()), pa.array([with_terms, length, *held[met].tolist()], pa.int64())],
                                     names=["term", "n"])


class Best:
    """The ``top`` best (score, id) per item among all rows added; larger scores, then smaller ids, null ids last."""

    def __init__(self, n_items: int, top: int) -> None:
        self._top, self._bar = top, np.zeros(n_items, np.int64)
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._held, self._most = 0, 4 * top * max(n_items, 64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = (score > 0) & (score >= self._bar[item])
        if good.any():
            self._parts.append((item[good], score[good], doc[good], null[good]))
            self._held += int(good.sum())
            if self._held > self._most:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self._parts:
            return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, bool),)
        item, score, doc, null = (np.concatenate(p) for p in zip(*self._parts))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(first, np.diff(first, append=len(item)))
        last = place == self._top - 1
        self._bar[item[last]] = score[last]
        kept = place < self._top
        self._parts = [(item[kept], score[kept], doc[kept], null[kept])]
        self._held = int(kept.sum())
        return self._parts[0]


def _scored(batches: Iterator[pa.RecordBatch], block: Block, weights: np.ndarray, docs: int, length: int, top: int) -> Iterator[pa.RecordBatch]:
    found, best = automaton(block.terms), Best(block.n_items, top)
    rows_at_once = max(1, CELLS // max(1, block.n_items))
    for part in text_slices(batches, "_text", BYTES_AT_ONCE):
        texts, sizes = _folded(part.column("_text"))
        ids = part.column("_id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        doc = ids.fill_null(0).to_numpy()
        for at in range(0, len(texts), rows_at_once):
            rows, terms, times = [], [], []
            for i, text in enumerate(texts[at:at + rows_at_once]):
                hit = _hits(found, text)
                rows += [i] * len(hit)
                terms += hit.keys()
                times += hit.values()
            if not rows:
                continue
            row, term, tf = np.array(rows), np.array(terms), np.array(times, np.int64)
            measure = 100 - 50 + (50 * sizes[at + row] * docs) // length
            share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * measure))
            wide = block.starts[term + 1] - block.starts[term]
            # The items of each hit, one after another.
            inside = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            item = block.items[np.repeat(block.starts[term], wide) + inside]
            cells = np.zeros(block.n_items * (rows[-1] + 1), np.int64)
            np.add.at(cells, np.repeat(row, wide) * block.n_items + item, np.repeat(share, wide))
            got = np.flatnonzero(cells)
            best.add(got % block.n_items, cells[got], doc[at + got // block.n_items], null[at + got // block.n_items])
    item, score, doc, null = best.settle()
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=null), pa.array(score, pa.int64())],
                                     names=["_item", "_id", "score"])


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(_item, _terms): the distinct terms of all rows of each item, in order."""
    folded = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.explode(F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    pairs = items.select(F.col(item_col).alias("_item"), terms.alias("_term")).distinct()
    return pairs.groupBy("_item").agg(F.sort_array(F.collect_list("_term")).alias("_terms"))


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, Block]]:
    """Items and their terms, a block at a time; the driver holds one block."""
    size = items.select(F.sum(F.expr("aggregate(_terms, 0L, (n, t) -> n + octet_length(t))"))).first()[0] or 0
    count = -(-size // block_bytes)
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("_item"), F.lit(count)) == k) if count > 1 else items
        rows = sorted(part.collect(), key=lambda r: (r["_item"] is None, r["_item"] or 0))
        terms = sorted({t for r in rows for t in r["_terms"]})
        number = {t: i for i, t in enumerate(terms)}
        pairs = np.array([(number[t], i) for i, r in enumerate(rows) for t in r["_terms"]], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        if terms:
            yield [r["_item"] for r in rows], Block(terms, np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1].copy(), len(rows))


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_item, rank, _id, score): for each item its ``top`` documents of highest score above 0, fewer if there are no more.

    Ids and items are whole numbers. Equal scores go by rising id, null ids last; repeated documents count and rank as often as they stand.
    Rows that share an item make one item with the terms of all of them; a null item is an item like any other. A null
    text has no terms, texts of any length are read whole, and an item without terms, or whose terms no document holds, has no rows. An empty table on
    either side gives an empty result. Columns that are not named are not read. The items' terms go to every task in blocks of about
    ``block_bytes`` (an item is not divided), with two passes over the documents for each block.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    source = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    asked = written(item_terms(items, item_col, item_text_col), "item-terms")
    ranked = spark.createDataFrame([], f"_item {item_kind}, rank int, _id {kind}, score long")
    for names, block in _blocks(asked, block_bytes):
        held = dict(source.select("_text").mapInArrow(partial(_statistics, terms=block.terms), "term long, n long")
                    .groupBy("term").agg(F.sum("n").alias("n")).collect())
        n, length = held.get(-1, 0), held.get(-2, 0)
        if not n:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(block.terms))], np.int64)
        # A term that weighs nothing, or that no document holds, adds nothing.
        used = np.flatnonzero((weights > 0) & np.array([i in held for i in range(len(block.terms))]))
        wide = np.diff(block.starts)[used]
        fewer = Block([block.terms[i] for i in used], np.concatenate([[0], np.cumsum(wide)]),
                      np.concatenate([np.empty(0, np.int64), *(block.items[block.starts[i]:block.starts[i + 1]] for i in used)]), block.n_items)
        best = source.mapInArrow(partial(_scored, block=fewer, weights=weights[used], docs=n, length=length, top=top), "_item long, _id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("_id")]
        best = best.withColumn("_salt", F.pmod(F.xxhash64("_id", "score"), F.lit(SALTS)))
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("_item", "_salt").orderBy(*order))).where(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= top)
        known = spark.createDataFrame(list(enumerate(names)), f"_number long, _name {item_kind}")
        ranked = ranked.unionByName(best.join(F.broadcast(known), F.col("_item") == F.col("_number"))
                                    .select(F.col("_name").alias("_item"), "rank", F.col("_id").cast(kind).alias("_id"), "score"))
    return ranked
