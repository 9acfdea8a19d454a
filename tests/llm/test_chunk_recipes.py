import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plantledger.llm.chunk_recipes import LONGEST, SHORTEST, cuts, drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, kept string, _id string"


def expected(rows):
    groups = {}
    for row in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")
        groups.setdefault(body, []).append(row)
    out = []
    for body, members in groups.items():
        order = sorted(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for i, row in enumerate(order):
            out.append((row[0], order[0][0], len(members), i == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    found = df.select("_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def sample():
    rng = random.Random(4)
    long = "".join(rng.choice("abcdé \n") for _ in range(60_000))
    texts = [None, "", " \t\n", "a b", "ab", "a  b", " ab", long, long.replace(" ", "\n"), long + "x", "é" * 40_000, "aaaa" * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(50, "ab"), (50, "ab"), (51, "a    b"), (51, "ab"), (None, "ab"), (None, long), (None, None), (60, "only")]
    return [(a, b, "x", "y") for a, b in rows]


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_equals_brute_force(spark, id_bytes):
    rows = sample()
    assert got(exact_duplicates(spark.createDataFrame(rows, SCHEMA), id_bytes=id_bytes)) == expected(rows)


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_leaves_one_row_of_each_group(spark):
    rows = sample()
    out = drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "kept", "_id"]
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
    assert sorted(bodies) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows})


def test_chunks_are_bounded_and_follow_content():
    rng = random.Random(1)
    body = rng.randbytes(200_000)
    ends = cuts(body)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(body) and max(sizes) <= LONGEST and min(sizes[:-1]) >= SHORTEST
    moved = {bytes(b"xyz" + body)[a:b] for a, b in zip([0, *cuts(b"xyz" + body)], cuts(b"xyz" + body))}
    assert len(moved & {body[a:b] for a, b in zip([0, *ends], ends)}) > len(ends) * 0.9
    assert cuts(b"") == [0] and cuts(b"a" * 100_000)[-1] == 100_000
