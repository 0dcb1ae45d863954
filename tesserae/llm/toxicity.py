"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of hashed words, word pairs, pairs that skip one word, and the first 4 to 7 bytes
of longer words (compounds of one stem share those). Training goes over a
bounded sample of labelled texts, one at a time, with per-coordinate rates; L1 keeps most weights at exactly zero, so the
broadcast model is a few kilobytes. Scoring finds the few features with a weight and never builds the others.

Defined cases: null text counts as empty; empty texts score the bias alone; without labelled rows every score is 0.5;
very long texts are scored whole; repeated rows give repeated rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.common import flat, FOLD, inputs, labelled_sample, mixed, slices, TABULATION, WORDLIKE, Words


#: Bytes of the word beginnings that are features.
STEM = (4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    epochs: int = 5
    #: Bounds of the fitting sample: labelled rows, and the characters of all of them; texts are never cut.
    rows: int = 8000
    chars: int = 24_000_000


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature; not yet distinct."""
    words = Words(*flat(column), WORDLIKE)
    h, text = words.hashes(FOLD), words.text
    shift = np.uint64(64 - bits)
    owners, buckets = [text], [h >> shift]
    for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            owners.append(text[gap:][same])
            buckets.append(mixed(h[:-gap][same] * np.uint64(odd) + h[gap:][same]) >> shift)
    stem = np.zeros(len(words), np.uint64)
    for k in range(STEM[-1]):
        longer = words.end - words.start > k + 1
        stem[longer] += TABULATION[k, FOLD[words.data[words.start[longer] + k]]]
        if k + 1 in STEM:
            owners.append(text[longer])
            buckets.append(mixed(stem[longer] + np.uint64(k)) >> shift)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[str, int]], s: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, buckets, weights) with the weights that are not zero."""
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    examples = []
    for text, y in rows:
        _, buckets = features(pa.array([text]), s.bits)
        examples.append((np.append(np.unique(buckets), size).astype(np.int32), y))
    for _ in range(s.epochs):
        for x, y in examples:
            zx, nx = z[x], n[x]
            l1 = np.full(len(x), s.l1)
            l1[-1] = 0  # the bias is free
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((s.beta + np.sqrt(nx)) / s.alpha + s.l2))
            g = sigmoid(w.sum()) - y
            rate = (np.sqrt(nx + g * g) - np.sqrt(nx)) / s.alpha
            z[x] += g - rate * w
            n[x] += g * g
    l1 = np.full(size + 1, s.l1)
    l1[-1] = 0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    kept = np.flatnonzero(w[:-1])
    return float(w[-1]), kept, w[kept]


def score_texts(column: pa.Array, model: tuple[float, np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    bias, buckets, weights = model
    total = np.full(len(column), bias)
    if len(buckets):
        owner, bucket = features(column, bits)
        at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
        hit = buckets[at] == bucket
        both = np.unique(owner[hit] * len(buckets) + at[hit])
        np.add.at(total, both // len(buckets), weights[both % len(buckets)])
    return sigmoid(total)


def score(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, buckets: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; fitted on labels that are not held out."""
    s = settings or Settings()
    model = fit(labelled_sample(docs, labels, "toxic", buckets, held, s.rows, s.chars), s)
    return scored(docs, lambda column: score_texts(column, model, s.bits), buckets, held, threshold)


def scored(docs: DataFrame, score_column, buckets: int, held: int, threshold: float) -> DataFrame:
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            p = score_column(texts)
            out = [None if i is None else zlib.crc32(str(i).encode()) % buckets == held for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return inputs(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
