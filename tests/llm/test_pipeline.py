import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plantledger.llm.queries import tokenizer_path
from plantledger.llm.secret_index import MARK, RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": ["the", "thing", "where", "stone", "other", "in"], "de": ["und", "eine", "schön", "über", "keit", "der"]}


def documents():
    rng = random.Random(4)
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        rows.append([i, " ".join(rng.choice(WORDS[lang]) + str(rng.randrange(40)) for _ in range(rng.randrange(30, 120))), lang, "s"])
    rows += [[200, rows[3][1] + " \n", "en", "s"], [201, rows[4][1].replace(" ", "\t"), None, "s"], [202, rows[5][1] + " tail", "de", None],
             [203, None, "en", "s"], [204, "", "en", "s"], [205, "123 --", None, "s"], [206, "the thing password=hunter2hunter2 where stone", "en", "s"],
             [None, "other stone in the where thing of no number", "en", "s"], [7, rows[7][1], "en", "s"]]
    return [(a, t, l, s, len(t) if t is not None else None) for a, t, l, s in rows]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    """The documents that reach the last stage, by brute force."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        key = (-len(r[1]), r[0] is None, r[0] or 0)
        if body not in best or key < best[body][0]:
            best[body] = (key, r)
    rows, kept = [r for _, r in best.values()], []
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    for g in set(group):
        kept.append(min((r for r, h in zip(rows, group) if h == g), key=lambda r: (r[0] is None, r[0] or 0)))
    out = []
    for r in kept:
        text = r[1]
        for rule in RULES:
            text = re.sub(rule.pattern, lambda m: m[0][:len(m[0]) - len(m[rule.secret])] + MARK if len(m[rule.secret]) >= rule.shortest else m[0], text)
        out.append((r[0], text))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), []
    for number, text in expected(rows):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(number, i, i * 2048, len(ids[i * 2048:][:2048]), zlib.crc32(ids[i * 2048:][:2048].tobytes())) for i in range(-(-len(ids) // 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=repr) == sorted(want, key=repr)
    assert len(want) < len(rows) - 6 and MARK in "".join(t for _, t in expected(rows))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_takes_empty_and_wider_tables(spark, name, stage):
    empty = spark.createDataFrame([], SCHEMA)
    out = stage(spark, empty, "")
    assert out.count() == 0
    wide = spark.createDataFrame([(*r, "x", 1, "y") for r in documents()[:30] + documents()[-9:]], SCHEMA + ", _id string, kept int, _raw string")
    out = stage(spark, wide, "")
    assert out.count() > 0
    if name != "packing":
        assert out.columns == wide.columns
        assert set(map(tuple, out.select("doc_id", "_id", "kept", "_raw").collect())) <= {(r[0], "x", 1, "y") for r in documents()}
