import math
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plantledger.llm.lattice_sampling import Lattices, decoded, row_random, sample_segmentations

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "conv_id long, turn int, text string, ids string, _key0 int"


@pytest.fixture(scope="module")
def lattice():
    return Lattices(PATH, 1.0)


def every_way(lattice, text):
    """All segmentations with their probabilities, by plain recursion over the vocabulary."""
    model, whole = lattice.model, lattice.marked(text)
    pieces = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}
    out = []

    def go(at, ids):
        if at == len(whole):
            out.append((tuple(ids), math.exp(-sum(math.log(i + 2) for i in ids))))
        for end in range(at + 1, len(whole) + 1):
            if whole[at:end] in pieces:
                go(end, [*ids, pieces[whole[at:end]]])
        if at < len(whole) and whole[at] not in pieces:
            go(at + 1, [*ids, *(b + 3 for b in whole[at].encode())])
    go(0, [])
    total = sum(p for _, p in out)
    return {ids: p / total for ids, p in out}


@pytest.mark.parametrize("text", ["abc", "the", "a b", "no\nto", "ñ😀a"])
def test_probabilities_and_completeness(lattice, text):
    ways = every_way(lattice, text)
    found = lattice.sample(text, len(ways) + 5, random.Random(1))
    assert {tuple(s.ids) for s in found} == set(ways) and len(found) == len(ways)
    for s in found:
        assert math.isclose(math.exp(s.log_p), ways[tuple(s.ids)], rel_tol=1e-9) and s.inclusion == 1.0
    assert [s.score for s in found] == sorted((s.score for s in found), reverse=True)


def test_samples_follow_the_distribution(lattice):
    ways, n = every_way(lattice, "then"), 6000
    first, second, weighted = Counter(), Counter(), Counter()
    for i in range(n):
        a, b = lattice.sample("then", 2, random.Random(i))
        assert a.ids != b.ids and a.score >= b.score
        first[tuple(a.ids)] += 1
        second[tuple(a.ids), tuple(b.ids)] += 1
        for s in (a, b):
            weighted[tuple(s.ids)] += math.exp(s.log_p) / s.inclusion
    top = sorted(ways, key=ways.get)[-3:]
    for w in top:
        assert abs(first[w] / n - ways[w]) < 4 * math.sqrt(ways[w] / n)
        assert abs(weighted[w] / n - ways[w]) < 0.05  # inverse inclusion gives unbiased estimates
        for v in top:
            p = ways[w] * ways[v] / (1 - ways[w]) if v != w else 0
            assert abs(second[w, v] / n - p) <= 4 * math.sqrt(p / n)


def test_rows(spark, lattice):
    rows = [(1, 0, "The mill ships  rolls.\nToday é😀", "x", 1), (1, 1, "The mill", "x", 1), (1, 1, "The mill", "x", 1), (2, None, None, "x", 1),
            (None, 3, "", "x", 1), (3, 0, "word " * 3000 + "x" * 2000, "x", 1), (4, 0, "▁", "x", 1)]
    out = sample_segmentations(spark.createDataFrame(rows, SCHEMA), PATH, ["conv_id", "turn"], count=3).withColumn("back", decoded("ids", PATH)).collect()
    by = {}
    for r in out:
        by.setdefault((r["_key0"], r["_key1"]), []).append(r)
    for number, turn, text, *_ in rows:
        found = by[number, turn]
        assert {r["back"] for r in found} == {(text or "").replace("▁", " ")}
        assert all(r["n_pieces"] == len(r["ids"]) and 0 < r["inclusion"] <= 1 for r in found)
        if text and number != 1 or turn == 0 and text:
            assert len({tuple(r["ids"]) for r in found}) == len(found)
    assert len(by[1, 1]) == 6 and len(set(tuple(r["ids"]) for r in by[1, 1])) == 3
    assert [r["ids"] for r in by[None, 3]] == [[]] and len(by[3, 0]) == 3
    assert [s.ids for s in lattice.sample(rows[0][2], 3, row_random(0, 1, 0))] == [r["ids"] for r in sorted(by[1, 0], key=lambda r: r["sample"])]


def test_empty_table_and_null_ids(spark):
    assert sample_segmentations(spark.createDataFrame([], SCHEMA), PATH, ["conv_id"]).count() == 0
    frame = spark.createDataFrame([(None,), ([],)], "ids array<int>").select(decoded("ids", PATH).alias("t"))
    assert sorted((r.t for r in frame.collect()), key=repr) == ["", None]
