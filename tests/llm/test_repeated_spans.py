import hashlib
import random
from collections import Counter

import pytest

from plantledger.llm.repeated_spans import LENGTH, remove_repeats

SCHEMA = "doc_id long, text string, unit int, _row long"


def expected(rows):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i:i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for r, d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = b"\1" * LENGTH
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in remove_repeats(df).select("_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def prose(rng, n):
    return "".join(rng.choice("abcdefgh  é\n") for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (60, 150, 185, 190, 200, 230, 400, 900)]
    texts = []
    for _ in range(90):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            passage = rng.choice(passages)
            if rng.random() < 0.4:
                start = rng.randrange(len(passage))
                passage = passage[start:start + rng.randrange(len(passage))]
            parts += [prose(rng, rng.choice([0, 0, 3, 100, 300])), passage if rng.random() < 0.6 else ""]
        texts.append("".join(parts))
    texts += [texts[0], texts[1], texts[1] + "x", "", None, "a" * 199, "b" * 200, "c" * 201, "ab" * 150, "d" * 3000, prose(rng, 700) * 2, prose(rng, 30) * 20]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], 1, 2), (3, texts[3], 1, 2), (None, texts[4], 1, 2)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(rows)


def test_long_text(spark):
    rng = random.Random(9)
    long = prose(rng, 700_000)
    rows = [(1, long, 0, 0), (2, "x" * 50 + long[1000:1400] + "y" * 50, 0, 0), (3, long[500_000:500_250], 0, 0)]
    found = {r["_id"]: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    size = [len(t.encode()) for t in (long, long[1000:1400], long[500_000:500_250])]
    assert found[1].n_bytes == size[0] and abs(found[1].n_removed - size[1] - size[2]) <= 8 and found[1].n_spans == 2
    assert found[3].n_removed == size[2] and found[2].n_spans == 1


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(spark.createDataFrame([(1, None, 0, 0)], SCHEMA)) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]
