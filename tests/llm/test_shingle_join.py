import random
import re

import numpy as np
import pytest

from plantledger.llm.components import components
from plantledger.llm.shingle_join import drop_near_duplicates, near_duplicates
from plantledger.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, unit string, n int, _group int"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def expected(rows):
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), low.get(find(i))) for i, r in enumerate(rows)), key=repr)


def sample(seed, n=260):
    rng = random.Random(seed)
    words = ["mill", "roll", "lot", "the", "a", "of", "Paper", "é", "x1", "pallet", "done", "ship"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for _ in range(n):
        draw = rng.random()
        if draw < 0.35 or not texts:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 90))))
        elif draw < 0.5:
            texts.append(passage + " " + " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(rng.randrange(1, 40))))
        else:
            parts = rng.choice(texts[-40:]).split(" ")
            for _ in range(rng.randrange(0, 4)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append((" " if rng.random() < 0.7 else "\n ").join(parts[:len(parts) - rng.randrange(0, 2)]))
    rows = [(i * 3 % 1009, t, "u", 1, 2) for i, t in enumerate(texts)]
    return rows + [(2000, None, "u", 1, 2), (2001, "", "u", 1, 2), (2002, " \n", "u", 1, 2), (2003, "one", "u", 1, 2), (2004, "ONE ", "u", 1, 2),
                   (None, "one", "u", 1, 2), (None, None, "u", 1, 2), (3, texts[1], "u", 1, 2), (3, texts[1], "u", 1, 2),
                   (2005, "w " * 5000, "u", 1, 2), (2006, "w " * 4000, "u", 1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = sample(seed)
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).select("_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(rows)


def test_near_copies_of_one_text(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "u", 1, 2))
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(rows)


def test_filter_keeps_one_of_each_component(spark):
    rows = sample(5, 120)
    kept = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "unit", "n", "_group"]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {c for i, n, c in expected(rows) if n}
    blank = {(r[0], r[1]) for r in rows if not plain_set(r[1])}
    assert len([g for g in got if plain_set(g[1])]) == len(groups) and {g for g in got if not plain_set(g[1])} == blank
    assert {g[0] for g in got if plain_set(g[1])} <= groups


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingles_of_runs():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \n\tÉ", k=rng.randrange(40))) for _ in range(700)] + ["", "a b c d", "A b  c d", "x " * 9]
    found = list(shingle_sets([t.encode() for t in texts]))
    for (t, a), (u, b) in zip(zip(texts, found), zip(texts[1:], found[1:])):
        assert len(a) == len(plain_set(t)) and len(np.intersect1d(a, b)) == len(plain_set(t) & plain_set(u))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(2000, 2001), (2001, 2000), (2001, 2001)]
    rng = random.Random(1)
    names = list(range(3000))
    rng.shuffle(names)
    got = dict(tuple(r) for r in components(spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")).collect())
    for nodes in (range(301), range(1000, 1400), (2000, 2001)):
        assert {got[names[i]] for i in nodes} == {min(names[i] for i in nodes)}
