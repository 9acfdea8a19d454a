import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plantledger.llm.exact_packing import Encoder, pack, packing_plan

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, offset int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


ODD = ["a b c\x1cd <|endoftext|>x<|startoftext|> <|ENDOFTEXT|> é ́x İstanbul ΑΣ ﬁ  z 'S don't I'LL ᠎ 1234 \x85q | a|b ||x |. x|. ab.. ab! 's. 5. á. É",
       "", " \n\t", "|", "word", "Word. WORD, word! wörd. ...", "x" * 3000, "　full width space"]


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcE'.,!|<>é́ \n\x1f 😀5st") for _ in range(rng.randrange(300))) for _ in range(400)]
    found = Encoder(PATH).encode([t.encode() for t in texts])
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_signs_after_a_letter_end_a_word(tokenizer):
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~1\u0338"
    texts = [f"{word}{a}{b} {word}{a}x" for word in ("roll", "É", "İ", "mill's", "<|endoftext", "<|endoftext|>") for a in signs for b in signs]
    encoder, learned = Encoder(PATH), []
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    known = Encoder(PATH)
    learn = known._learn
    known._learn = lambda words: (learned.extend(words), learn(words))
    known.encode([b"Roll roll. roll%% roll&&, \xc3\xa9t\xc3\xa9:", b"roll roll;"])
    assert sorted(learned) == sorted(["roll", ".", "%%", "&&,", "été", ":", ";"])  # the word once, whatever follows it


def test_plan_uses_every_piece_and_is_tight():
    rng = random.Random(8)
    for capacity in (10, 64, 2048):
        counts = Counter(min(capacity, int(rng.expovariate(3 / capacity)) + 1) for _ in range(3000))
        plan = packing_plan(dict(counts), capacity)
        used = Counter()
        for pattern in plan:
            assert sum(pattern.lengths) <= capacity and pattern.times > 0
            for n in pattern.lengths:
                used[n] += pattern.times
        assert used == counts
        least = -(-sum(n * c for n, c in counts.items()) // capacity)
        assert sum(p.times for p in plan) <= least * 1.01 + 1


def test_plan_finds_exact_fills():
    assert sorted(p.lengths for p in packing_plan({7: 1, 3: 1, 10: 2}, 10)) == [(7, 3), (10,)]
    assert [(p.lengths, p.times) for p in packing_plan({6: 4, 2: 8}, 10)] == [((6, 2, 2), 4)]
    assert [p.lengths for p in packing_plan({4: 1, 3: 1, 2: 1, 1: 1}, 10)] == [(4, 3, 2, 1)]
    assert packing_plan({}, 10) == []


@pytest.mark.parametrize("capacity", [16, 2048])
def test_rows(spark, tokenizer, capacity):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["mill", "roll", "paper", "hotstamping", "é."]) for _ in range(rng.randrange(60))), 1, 2) for i in range(150)]
    rows += [(200, None, 1, 2), (201, "", 1, 2), (None, "no id here", 1, 2), (3, "again", 1, 2), (3, "again", 1, 2), (300, "long text, " * 9000, 1, 2)]
    out = [r.asDict() for r in pack(spark.createDataFrame(rows, SCHEMA), PATH, capacity=capacity).collect()]
    want = Counter()
    for number, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), capacity)):
            body = np.array(ids[start:start + capacity], dtype="<u4")
            want[(number, k, start, len(body), zlib.crc32(body.tobytes()))] += 1
    assert Counter((r["_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(r["length"] for r in out) // capacity) * 1.02 + 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
