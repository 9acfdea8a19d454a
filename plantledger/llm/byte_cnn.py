"""Language identification with a small convolutional network over bytes, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed windows, the strongest response of each filter in the
window passes a softmax layer. The training windows are a bounded sample (``SAMPLE`` documents, ``SAMPLE_WINDOWS``
windows each) of the labelled rows given; every byte of every text is covered when languages are predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantledger.llm.common import text_or_empty, written

#: Bytes in a window; neighbours share all but the first byte of the widest filter, so no place is left out.
WINDOW = 128
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 16, 8
TAPS = max(WIDTHS)
STRIDE = WINDOW - TAPS + 1
#: Bounds of the training sample; labelled documents beyond it do not change the time or memory of training.
SAMPLE, SAMPLE_WINDOWS = 4000, 3
EPOCHS, BATCH, RATE, SEED = 6, 64, 4e-3, 7
#: Windows that are scored together: their responses stay in the processor's cache.
TOGETHER = 64
ROWS_AT_ONCE = 512
UNKNOWN = "und"
#: A text whose best language scores less is of no known language; less than that where this share of held-out labelled
#: rows would fall below it, so that a model that has learned little does not reject what it should know.
LEAST_SCORE, LEAST_SHARE = 0.5, 0.01


class Model(NamedTuple):
    labels: tuple[str, ...]
    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def _columns(model_embedding: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Embedded bytes of each place and the ``TAPS - 1`` after it: [windows, places, TAPS * EMBEDDED]."""
    flat = model_embedding[windows].reshape(len(windows), -1)
    places = windows.shape[1] - TAPS + 1
    step = flat.itemsize
    return np.lib.stride_tricks.as_strided(
        flat, (len(windows), places, TAPS * EMBEDDED), (flat.strides[0], EMBEDDED * step, step))


def probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """Softmax over the labels for rows of ``WINDOW`` bytes, padded with zeros."""
    pooled = np.empty((len(windows), model.filters.shape[1]), dtype=np.float32)
    for at in range(0, len(windows), TOGETHER):
        some = windows[at:at + TOGETHER]
        columns = np.ascontiguousarray(_columns(model.embedding, some)).reshape(-1, TAPS * EMBEDDED)
        pooled[at:at + TOGETHER] = (columns @ model.filters).reshape(len(some), -1, model.filters.shape[1]).max(axis=1)
    active = np.maximum(pooled + model.filter_bias, 0)
    return _softmax(active @ model.weights + model.bias)


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def cut(data: bytes) -> np.ndarray:
    """The windows of a text; the last is padded with zeros, an empty text has none."""
    if not data:
        return np.empty((0, WINDOW), dtype=np.uint8)
    count = max(1, -(-(len(data) - TAPS + 1) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + WINDOW, dtype=np.uint8)
    padded[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def train(texts: list[bytes], labels: list[str]) -> Model:
    """Fits the network to windows; the same windows in the same order give the same model."""
    names = tuple(sorted(set(labels)))
    rng = np.random.default_rng(SEED)
    used = np.zeros((TAPS * EMBEDDED, len(WIDTHS) * FILTERS), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        used[:width * EMBEDDED, k * FILTERS:(k + 1) * FILTERS] = 1
    params = [rng.normal(0, 0.5, (256, EMBEDDED)), rng.normal(0, 0.3, used.shape) * used, np.zeros(used.shape[1]),
              rng.normal(0, 0.1, (used.shape[1], len(names))), np.zeros(len(names))]
    params = [p.astype(np.float32) for p in params]
    params[0][0] = 0
    if len(names) < 2:
        return Model(names, *params)
    target = np.array([names.index(x) for x in labels])
    share = np.bincount(target) / len(target)
    rows = np.zeros((len(texts), WINDOW), dtype=np.uint8)
    for i, text in enumerate(texts):  # windows of all lengths down to a few words, so that short texts are known as well
        size = len(text) if i % 2 else min(len(text), int(rng.integers(12, WINDOW + 1)))
        rows[i, :min(size, WINDOW)] = np.frombuffer(text[:min(size, WINDOW)], dtype=np.uint8)
    first, second, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            grads = _gradients(params, used, rows[pick], target[pick], 1 / (share[target[pick]] * len(names)))
            turn += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)
    return Model(names, *params)


def _gradients(params, used, windows, target, importance):
    embedding, filters, filter_bias, weights, bias = params
    columns = np.ascontiguousarray(_columns(embedding, windows))
    response = columns.reshape(-1, TAPS * EMBEDDED) @ filters
    response = response.reshape(len(windows), -1, filters.shape[1])
    best = response.argmax(axis=1)
    row = np.arange(len(windows))[:, None]
    active = np.maximum(response[row, best, np.arange(filters.shape[1])] + filter_bias, 0)
    off = _softmax(active @ weights + bias)
    off[np.arange(len(windows)), target] -= 1
    off *= (importance / len(windows))[:, None].astype(np.float32)
    back = (off @ weights.T) * (active > 0)
    seen = columns[row, best]
    to_filters = np.einsum("bfk,bf->kf", seen, back) * used
    to_columns = (back[:, :, None] * filters.T[None]).reshape(-1, EMBEDDED)
    places = windows[row[:, :, None], best[:, :, None] + np.arange(TAPS)].reshape(-1)
    to_embedding = np.zeros_like(embedding)
    np.add.at(to_embedding, places, to_columns)
    to_embedding[0] = 0
    return to_embedding, to_filters, back.sum(axis=0), active.T @ off, off.sum(axis=0)


def sample_windows(labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[bytes], list[str]]:
    """At most ``SAMPLE`` documents, those with the smallest hash of the id, and windows spread evenly over each."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.xxhash64(id_col).alias("_hash"), F.lower(F.col(text_col)).alias("_text"), F.col(label_col).alias("_label"))
    chosen = rows.select("_hash").orderBy("_hash").limit(SAMPLE).agg(F.max("_hash")).first()[0]
    if chosen is None:
        return [], []
    size = F.char_length("_text")
    starts = [F.floor(size * k / SAMPLE_WINDOWS).cast("int") + 1 for k in range(SAMPLE_WINDOWS)]
    parts = F.array_distinct(F.array(*[F.substring(F.col("_text"), start, F.lit(WINDOW)) for start in starts]))
    found = (rows.where(F.col("_hash") <= chosen).select("_hash", "_label", F.explode(parts).alias("_part"))
             .orderBy("_hash", "_label", "_part").limit(2 * SAMPLE * SAMPLE_WINDOWS).collect())  # ids may repeat
    return [r["_part"].encode()[:WINDOW] for r in found], [r["_label"] for r in found]


def fitted(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    return train(*sample_windows(labelled, id_col, text_col, label_col))


def _predicted(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                names, scores = [], []
                for text in part.column("_text"):
                    data = text.as_py()
                    name, score = UNKNOWN, 0.0
                    if data and model.labels:
                        windows = cut(data)
                        found = probabilities(model, windows)
                        size = np.full(len(windows), WINDOW, dtype=np.float64)
                        size[-1] = len(data) - (len(windows) - 1) * STRIDE
                        mean = size @ found / size.sum()
                        name, score = model.labels[int(mean.argmax())], float(min(mean.max(), 1.0))
                    names.append(name)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=[*part.schema.names[:-1], "_lang", "_score"])
    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _lang, _score) of every row from the text alone; one pass without a shuffle.

    Texts are read in lower case. A document's score for a language is the mean of its windows' probabilities, weighted
    by their bytes; the highest names it. Texts that are null or hold no letter are ``und`` with score 0, and so is every
    text when the model has learned no language. Repeated rows stay repeated, null ids stay null, an empty table gives
    an empty result, other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_or_empty(text_col))).cast("binary").alias("_text"))
    kind = dict(source.dtypes)["_id"]
    return source.mapInArrow(_predicted(model), f"_id {kind}, _lang string, _score double")


def _ranked(scores: DataFrame, rank: int) -> float:
    """The score with so many before it in ascending order. Each turn counts the scores by 12 more binary digits within the
    cell that holds the rank, so at most 4,097 rows come back, however many scores there are."""
    score, inside, before = F.col("_score"), F.lit(True), 0
    for digits in range(12, 61, 12):
        cell = F.floor(score * float(1 << digits))
        found = scores.where(inside).groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n"), F.min(score).alias("_low"), F.max(score).alias("_high"))
        for row in sorted(found.collect()):
            if before + row["_n"] > rank:
                break
            before += row["_n"]
        if row["_low"] == row["_high"]:
            break
        inside = cell == row["_cell"]
    return row["_low"]


def least_score(model: Model, held_out: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> float:
    """The score below which a text is of no known language, measured on all labelled rows that the model has not seen; 0
    without such rows. Their scores are written and ranked where they stand."""
    if not model.labels:
        return 0.0
    rows = held_out.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    scores = written(identify(rows, model, id_col, text_col).select("_score"), "held-out-scores")
    total = scores.count()
    return min(LEAST_SCORE, _ranked(scores, int(LEAST_SHARE * (total - 1)))) if total else 0.0


def drop_unidentified(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scores less than ``least``; same columns, repeated rows stay.

    A model that has learned no language can reject none: then every text with a letter stays.
    """
    if not model.labels:
        return docs.where(F.col(f"`{text_col}`").rlike(r"\p{L}"))
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    text = inner[docs.columns.index(text_col)]
    source = docs.toDF(*inner).withColumn("_text", F.when(F.col(text).rlike(r"\p{L}"), F.lower(F.col(text))).cast("binary"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    told = source.mapInArrow(_predicted(model), f"{fields}, _lang string, _score double")
    return told.where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least)).select(*inner).toDF(*docs.columns)
