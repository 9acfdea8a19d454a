import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plantledger.llm import term_scan
from plantledger.llm.term_scan import rank_documents

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, score long, rank string", "item_id long, text string, _id long"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def expected(docs, items, top):
    bags = [(key, Counter(terms(text))) for key, text in docs]
    bags = [(key, bag) for key, bag in bags if bag]
    n, length, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    asked = {}
    for key, text in items:
        asked.setdefault(key, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for key, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // length
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                               for t in wanted if bag[t]), key))
        scores = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, i + 1, key, score) for i, (score, key) in enumerate(scores[:top])]
    return sorted(out, key=repr)


def sample():
    rng = random.Random(8)
    vocabulary = ["the", "of", "Éa", "É", "ñu", "a1", "a", "日本", "ze", "zeta", "B", "rare", "x" * 5000]
    weights = [60, 40, 5, 5, 5, 9, 9, 2, 3, 3, 2, 1, 1]
    texts = [None, "", " \t.,", "zeta", "ZETA", "ze-ta", "\x00a\x7fb", "É" * 50_000, " ".join(rng.choices(vocabulary, weights, k=50_000)), "  ze   ta  "]
    texts += [rng.choice(" .\n").join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(20, texts[20]), (20, texts[21]), (None, texts[22]), (None, None), (None, "rare")] + [(900 - i, "copy of zeta") for i in range(90)]
    items = [(1, "The zeta"), (2, None), (3, "nowhere"), (4, "of OF of"), (5, "É Éa a 日本"), (5, "rare"), (None, "rare"), (7, ""), (8, " ".join(vocabulary)), (8, "the")]
    return docs, items


@pytest.mark.parametrize(("top", "block"), [(50, 1 << 22), (3, 1 << 22), (7, 12)])
def test_equals_brute_force(spark, top, block):
    docs, items = sample()
    got = rank_documents(spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(4), spark.createDataFrame([(*i, 9) for i in items], ITEMS),
                         top=top, block_bytes=block)
    assert got.columns == ["_item", "rank", "_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(docs, items, top)


def test_best_rows_survive_settling(spark, monkeypatch):
    monkeypatch.setattr(term_scan, "SALTS", 3)
    docs = [(i, "w " * (1 + i % 40) + "v") for i in range(3000)]
    items = [(1, "w"), (2, "v w")]
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string").withColumn("extra", F.lit(1)).coalesce(1), spark.createDataFrame(items, "item_id long, text string"), top=5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(docs, items, 5)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(docs.where("false"), items).count() == 0
    assert rank_documents(docs, items.where("false")).count() == 0
