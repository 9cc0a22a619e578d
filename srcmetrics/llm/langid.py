"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader, calibrated by temperature."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcmetrics.llm.store import bounded, stored

#: Hash buckets of n-grams of 1 to ORDERS characters.
BUCKETS_BITS, ORDERS = 16, 3
#: Labelled rows for each language that the model is fitted on (the first by a hash of the
#: id); every fourth of them only sets the temperature.
ROWS_PER_LANGUAGE = 500
#: Follow-the-regularised-leader: learning rate, its smoothing, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 1e-4, 1e-4, 4
UNKNOWN = "und"
#: TF-IDF weights are relative frequencies times inverse document frequencies times this.
SCALE = 8.0
#: Characters that are worked on at a time.
PIECE = 1 << 17


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _pieces(column: pa.Array) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, int]]:
    """(first row, whether it begins here, letters or 0, row offsets, own) of about
    PIECE characters. A longer text comes as several pieces of one row, which overlap by what
    an n-gram needs; n-grams that begin at ``own`` or later belong to the next piece."""
    texts = column.to_pylist()
    at = 0
    while at < len(texts):
        text = texts[at] or ""
        if len(text) > PIECE:
            for begin in range(0, len(text), PIECE):
                points = _letters(text[begin : begin + PIECE + ORDERS - 1])
                yield at, not begin, points, np.array([0, len(points)]), min(PIECE, len(text) - begin)
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end] or "") <= PIECE:
            size += len(texts[end] or "")
            end += 1
        points = _letters("".join(t or "" for t in texts[at:end]))
        offsets = np.concatenate(([0], np.cumsum([len(t or "") for t in texts[at:end]])))
        yield at, True, points, offsets.astype(np.int64), len(points)
        at = end


def _letters(text: str) -> np.ndarray:
    return _folded()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def _ngrams(letters: np.ndarray, offsets: np.ndarray, own: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket and validity of the n-gram that begins at each character.
    N-grams end with their text; gaps (0) count as one more letter, but an n-gram of one gap
    or that begins with two is not counted."""
    n = len(letters)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    left[own:] = 0
    padded = np.concatenate((letters, np.zeros(ORDERS, np.uint32))).astype(np.uint64)
    full = letters != 0
    out = []
    h = np.zeros(n, np.uint64)
    for order in range(1, ORDERS + 1):
        h = (h + padded[order - 1 : order - 1 + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        some = full if order == 1 else full | (padded[1 : n + 1] != 0)
        out.append(((h >> np.uint64(64 - BUCKETS_BITS)).astype(np.int32), (left >= order) & some))
    return out


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << BUCKETS_BITS, np.int64)
    mark = np.zeros(1 << BUCKETS_BITS, bool)
    n = 0
    for batch in batches:
        for _, begins, letters, offsets, own in _pieces(batch.column("text")):
            grams = _ngrams(letters, offsets, own)
            for a, b in zip(offsets, offsets[1:], strict=False):
                if begins:
                    df += mark
                    mark[:] = False
                    n += 1
                for h, valid in grams:
                    mark[h[a:b][valid[a:b]]] = True
    df += mark
    bucket = np.append(np.flatnonzero(df), -1)
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.append(df[bucket[:-1]], n))], ["bucket", "df"])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        for at, _, letters, offsets, own in _pieces(batch.column("text")):
            found = _ngrams(letters, offsets, own)
            for row, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False), at):
                grams[row] += [h[a:b][valid[a:b]] for h, valid in found]
        unique = [np.unique(np.concatenate(g), return_counts=True) for g in grams]
        columns = [
            batch.column("lang"),
            batch.column("place"),
            pa.array([u for u, _ in unique], pa.list_(pa.int32())),
            pa.array([c / max(1, c.sum()) for _, c in unique], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "buckets", "weights"])


@dataclass(frozen=True)
class Model:
    """Weights per bucket (inverse document frequencies applied) and language, bias and
    temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int) -> np.ndarray:
    """Weights (the last row is the bias) by per-coordinate follow-the-regularised-leader
    with elastic-net penalties, over PASSES passes in the rows' order."""
    size = (1 << BUCKETS_BITS) + 1
    z, n = np.zeros((size, n_languages)), np.zeros((size, n_languages))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(PASSES):
        for at, x, label in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            root = np.sqrt(ni + g * g)
            z[at] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    return weights(z, n)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.
    Targets are smoothed as if one row more had each wrong label, so that rows without an
    error do not make every score 1."""
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1.0 / (n + k))
    target[np.arange(n), labels] = 1 - (k - 1) / (n + k)

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(_softmax(logits / np.exp(t)), 1e-12))).sum())

    low, high, ratio = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labelled: DataFrame) -> Model:
    """Fits a model to ``labelled(doc_id, text, lang)``; rows with a null text or lang teach
    nothing.

    Document frequencies cover all rows. The weights are fitted to ROWS_PER_LANGUAGE rows of
    each language at most, whose n-grams are extracted by the executors."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = rows.select("text").mapInArrow(_document_frequencies, "bucket bigint, df bigint")
    counts = counts.groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(1 << BUCKETS_BITS)
    known = counts[counts.bucket >= 0]
    df[known.bucket] = known.df
    total = int(counts.df[counts.bucket == -1].sum())
    idf = np.log((1 + total) / (1 + df)) + 1

    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    narrow = rows.select("doc_id", "lang").withColumn("place", F.row_number().over(order))
    chosen = stored(narrow.filter(F.col("place") <= ROWS_PER_LANGUAGE))
    texts = rows.join(bounded(chosen, 24), ["doc_id", "lang"])
    table = texts.select("lang", "place", "text").mapInArrow(
        _sample_features, "lang string, place int, buckets array<int>, weights array<double>"
    ).toArrow()
    languages = tuple(sorted(set(table["lang"].to_pylist())))
    examples: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for batch in table.to_batches():
        lists = zip(batch["lang"].to_pylist(), batch["place"].to_pylist(), batch["buckets"], batch["weights"], strict=True)
        for lang, place, buckets, weights in lists:
            at = buckets.values.to_numpy()
            x = weights.values.to_numpy() * idf[at] * SCALE
            examples.append((place, languages.index(lang), np.append(at, 1 << BUCKETS_BITS), np.append(x, 1.0)))
    examples.sort(key=lambda e: (e[0], e[1], len(e[2])))
    fitted = [(at, x, label) for place, label, at, x in examples if place % 4 or len(examples) < 8]
    held = [(at, x, label) for place, label, at, x in examples if not place % 4]
    weights = _fit_ftrl(fitted, len(languages)) if languages else np.zeros(((1 << BUCKETS_BITS) + 1, 0))
    logits = np.array([x @ weights[at] for at, x, _ in held]).reshape(len(held), len(languages))
    heat = _temperature(logits, np.array([label for *_, label in held], int))
    scaled = (weights[:-1] * (idf * SCALE)[:, None]).astype(np.float32)
    return Model(languages, np.ascontiguousarray(scaled), weights[-1], heat)


def _scored(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    sums = np.zeros((len(texts), len(model.languages)))
    count, letters_of = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for at, _, letters, offsets, own in _pieces(texts):
        filled = np.flatnonzero(np.diff(offsets))
        if not len(filled):
            continue
        begin = offsets[filled]
        for order, (h, valid) in enumerate(_ngrams(letters, offsets, own)):
            found = np.add.reduceat(valid, begin, dtype=np.int64)
            count[at + filled] += found
            if not order:
                letters_of[at + filled] += found
            part = np.where(valid[:, None], model.weights[h], np.float32(0))
            sums[at + filled] += np.add.reduceat(part, begin, axis=0, dtype=np.float64)
    known = (letters_of > 0) & (len(model.languages) > 0)
    names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if known.any():
        p = _softmax((sums[known] / count[known, None] + model.bias) / model.temperature)
        names[known] = np.array(model.languages, object)[p.argmax(axis=1)]
        score[known] = p.max(axis=1)
    return names, score


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _scored(batch.column("text"), model)
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return run


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least`` or more, with
    all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _scored(batch.column("text"), model)
            yield batch.filter(pa.array((names != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs(doc_id, text)`` from its whole text.

    ``score`` is the calibrated probability of the language. A text that is null or has no
    letter, and every text under a model without languages, is ``und`` with score 0."""
    kinds = "doc_id bigint, lang_pred string, score double"
    return docs.select("doc_id", "text").mapInArrow(_predictor(model), kinds)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4: rows with 2 are held out; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs(doc_id, text, lang)``; the
    model learns from rows whose fold is known and not 2."""
    model = train(docs.filter(fold() != 2))
    found = predict(docs, model)
    return found.withColumn("held_out", F.coalesce(fold() == 2, F.lit(False)))
