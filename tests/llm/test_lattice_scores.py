import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from plantledger.llm import lattice_scores
from plantledger.llm.lattice_scores import MARK, PRIOR, UNIT, Lattice, score_texts, vocabulary
from plantledger.llm.queries import PIECES, tokenizer_path

SCHEMA = "doc_id long, text string, score string, _row int"
PATH = tokenizer_path(PIECES)
LEARN = "crc32(binary(string(doc_id))) % 10 <> 0"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


class Plain:
    """Every segmentation of a word written out."""

    def __init__(self):
        model = SentencePieceProcessor(model_file=PATH)
        self.pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size())
                       if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.bytes = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        size = model.get_piece_size()
        prior = {i: 1 / (2 - model.get_score(i)) for i in self.pieces.values()} | {i: 1 / (2 + size) for i in [*self.bytes.values(), size]}
        self.end, self.prior = size, {i: p / sum(prior.values()) for i, p in prior.items()}

    def ways(self, word, at=0):
        """Lists of (place, ids)."""
        text = MARK + word
        if at == len(text):
            yield []
            return
        first = text[at]
        if first not in self.pieces or (at and first == MARK):
            for rest in self.ways(word, at + 1):
                yield [(at, tuple(self.bytes[b] for b in first.encode())), *rest]
        for end in range(at + 1, len(text) + 1):
            part = text[at:end]
            if part in self.pieces and MARK not in (part[1:] if at == 0 else part):
                for rest in self.ways(word, end):
                    yield [(at, (self.pieces[part],)), *rest]

    def p(self, way, model):
        return math.prod(model[i] for _, ids in way for i in ids)

    def trained(self, counts, texts, rounds):
        model = self.prior
        for _ in range(rounds):
            mass = {i: PRIOR * p for i, p in self.prior.items()}
            mass[self.end] += texts
            for word, count in counts.items():
                ways = [(w, self.p(w, model)) for w in self.ways(word)]
                whole, edges = sum(p for _, p in ways), Counter()
                for way, p in ways:
                    for edge in way:
                        edges[edge] += p / whole
                for (_, ids), share in edges.items():
                    for i in ids:
                        mass[i] += round(share * UNIT) * count / UNIT
            model = {i: m / sum(mass.values()) for i, m in mass.items()}
        return model


def expected(rows, rounds):
    plain = Plain()
    learned = [t for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 10]
    counts = Counter(w for t in learned for w in words(t))
    model, n = plain.trained(counts, len(learned), rounds), counts.total() + len(learned)
    v = len(counts) + (1 if learned else 0)
    out = []
    for key, text in rows:
        found = words(text)
        c = [counts[w] for w in found] + [len(learned)]
        score = sum(math.log10(sum(plain.p(w, model) for w in plain.ways(x))) for x in found) + math.log10(model[plain.end])
        out.append((key, len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), score))
    return sorted(out, key=repr)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


def sample():
    texts = [None, "", " \t\n", "the The THE", "Été ▁a a▁b x", "的 zqx 😀y", "in on", "of the in", "and\x0band\x0cand", "\x00", "straße", "İi"]
    return list(enumerate(texts)) + [(3, "the"), (3, "the"), (None, "the unseen"), (None, None), (40, "held"), (41, "the in of")]


@pytest.mark.parametrize(("rounds", "frequent"), [(1, lattice_scores.FREQUENT), (2, 8), (1, 1)])
def test_equals_all_segmentations(spark, rounds, frequent):
    rows = sample()
    got = score_texts(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), PATH, F.expr(LEARN), rounds=rounds, frequent=frequent)
    assert got.columns == ["_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(sorted((tuple(r) for r in got.collect()), key=repr), expected(rows, rounds))


def test_nothing_to_learn_from(spark):
    rows = [(i, t) for i, t in enumerate(["the", None])]
    got = sorted(tuple(r) for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, F.lit(False)).collect())
    plain = Plain()
    end = math.log10(plain.prior[plain.end])
    the = math.log10(sum(plain.p(w, plain.prior) for w in plain.ways("the")))
    same(got, [(0, 2, 0, 0, 0.0, the + end), (1, 1, 0, 0, 0.0, end)])


def test_empty_table(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA), PATH, F.expr(LEARN)).count() == 0


def test_a_very_long_word_does_not_run_out_of_numbers():
    pieces, word = vocabulary(PATH), "abé的" * 3000
    logs = np.log(np.maximum(pieces.prior, 1e-300))
    plain = Plain()
    text, total = MARK + word, [0.0]
    longest = max(map(len, plain.pieces))
    for end in range(1, len(text) + 1):
        ways = [total[at] + math.log(plain.prior[plain.pieces[text[at:end]]]) for at in range(max(0, end - longest), end) if text[at:end] in plain.pieces]
        if text[end - 1] not in plain.pieces:
            ways.append(total[end - 1] + sum(math.log(plain.prior[plain.bytes[b]]) for b in text[end - 1].encode()))
        top = max(ways)
        total.append(top + math.log(sum(math.exp(w - top) for w in ways)))
    lattice = Lattice([word, "the"], pieces)
    assert lattice.log_probabilities(logs)[0] == pytest.approx(total[-1], rel=1e-9)
    # The pieces' masses write the word out: one for each letter, or one for each of its bytes.
    masses = Lattice([word], pieces).masses(logs, np.array([1])) / UNIT
    spelled = sum(m * len(p) for p, i in plain.pieces.items() if (m := masses[i]))
    assert spelled + sum(masses[i] for i in plain.bytes.values()) / 3 == pytest.approx(len(text), rel=1e-3)
