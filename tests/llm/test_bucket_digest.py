import hashlib
import random

from plantledger.llm.bucket_digest import digest, fingerprints, likeness, spliced

SCHEMA = "doc_id long, text string, fingerprint int, _place int"


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, row in enumerate(order):
        own, following = row[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = own[:len(own) - len(own) // 2] + following[:len(own) // 2]
        a, b, c = digest(own.encode()), digest(edited.encode()), digest(following.encode())
        out.append((row[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


def words(rng, n):
    return " ".join(rng.choice(["the", "mill", "é", "roll", "of", "paper", "lot", "pallet", "x"]) for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 101, words(rng, rng.randrange(0, 80)), 1, 2) for i in range(101)]
    rows += [(5, None, 1, 2), (5, "ab", 1, 2), (5, "ab", 1, 2), (None, "no id", 1, 2), (None, None, 1, 2), (400, words(rng, 60_000), 1, 2), (401, "", 1, 2)]
    got = sorted((tuple(r) for r in fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == expected(rows)


def test_one_row_and_none(spark):
    one = [(1, "abcdef", 0, 0)]
    assert [tuple(r) for r in fingerprints(spark.createDataFrame(one, SCHEMA)).collect()] == expected(one)
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_likeness_orders_texts():
    rng = random.Random(9)
    parts = ["the", "an", "er", "ing", "on", "st", "ea", "nd", "th", "ly", "re", "wh"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(700)) for _ in range(12)]
    for one, other in zip(texts, texts[1:]):
        a, half, b = digest(one.encode()), digest(spliced(one, other).encode()), digest(other.encode())
        assert likeness(a, a) == 1.0 and 0.0 <= likeness(a, b) < likeness(a, half) < 1.0
        assert likeness(a, b) == likeness(b, a)
    assert likeness(digest(b""), digest(b"")) == 1.0


def test_long_text_counts_every_triplet():
    rng = random.Random(2)
    data = rng.randbytes((1 << 20) + 5000)
    assert digest(data) != digest(data[:1 << 20]) and len(digest(data)) == 130
