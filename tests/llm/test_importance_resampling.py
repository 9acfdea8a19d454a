import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from plantledger.llm.importance_resampling import features, resample

SCHEMA = "doc_id long, text string, _id string, weight int, score string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def runs(text, longest):
    found = words(text)
    return [" ".join(found[i:i + k]) for k in range(1, longest + 1) for i in range(len(found) - k + 1)]


def expected(docs, targets, longest, least, percent, buckets=10_000):
    def counts(texts):
        out = [0] * buckets
        for text in texts:
            for run in runs(text, longest):
                out[zlib.crc32(run.encode()) % buckets] += 1
        return out
    s, t = counts(x for _, x in docs), counts(targets)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for key, text in docs:
        found = runs(text, longest)
        weight = sum(gain[zlib.crc32(r.encode()) % buckets] for r in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, row in enumerate(able[:percent * len(able) // 100]):
        row[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def sample():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Éa", "ñu", "a1", "x", "日本", "zeta", "B"]
    texts = [None, "", " \t.,", "one", "THE the ThE", "\x00a\x7fb", "é" * 50_000, " ".join(rng.choice(vocabulary) for _ in range(40_000))]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    docs = list(enumerate(texts)) + [(20, texts[20]), (20, texts[20]), (20, texts[21]), (None, texts[22]), (None, None), (500, texts[30])]
    return docs, [None, "", "the of of zeta", "ñu, ñu; the", "日本"]


@pytest.mark.parametrize(("longest", "least", "percent"), [(1, 20, 10), (2, 5, 50), (3, 0, 100), (1, 10**9, 10)])
def test_equals_brute_force(spark, longest, least, percent):
    docs, targets = sample()
    got = resample(spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in targets], "text string"),
                   longest=longest, least_words=least, percent=percent)
    assert got.columns == ["_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(docs, targets, longest, least, percent)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "text string, doc_id long")
    assert resample(none, none).count() == 0
    assert [tuple(r) for r in resample(docs, none).collect()] == expected([(1, "a b")], [], 1, 20, 10)
    assert resample(none, docs).count() == 0


def test_runs_stay_inside_a_text():
    per_text, found = features(pa.array(["a b", "", "c", "d e f"]), 3, 1 << 20)
    assert per_text.tolist() == [2, 0, 1, 3]
    assert [rows.tolist() for rows, _ in found] == [[0, 0, 2, 3, 3, 3], [0, 3, 3], [3]]
    assert found[2][1].tolist() == [zlib.crc32(b"d e f") % (1 << 20)]
