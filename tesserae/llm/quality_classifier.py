"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (the last one may be shorter). An encoder maps every passage to
``hidden`` numbers, from the mean of its words' learned vectors (words are hashed, A-Z in lower case) and from surface
measures (shares of words with symbols, separators, capitals, repeats, sentence ends, ... and hashed word shapes). Gated
attention, tanh(Vh) * sigmoid(Uh), learns from document labels alone which passages count, and
a logistic unit scores the weighted passage representation. All parts are trained together on a bounded sample.

Defined cases: null text counts as empty; a text without a word is a bag of one empty passage; without labelled rows
every score is 0.5; very long texts are scored whole; repeated rows give repeated rows; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.common import byte_table, flat, FOLD, IDENTITY, labelled_sample, NOT_SPACE, SLICE_BYTES, small_batches, Words
from tesserae.llm.toxicity import scored, sigmoid

PASSAGE = 100
SHAPES = 16
UPPER = byte_table(lambda b: 65 <= b <= 90)
LOWERCASE = byte_table(lambda b: 97 <= b <= 122 or b >= 128)
DIGIT = byte_table(lambda b: 48 <= b <= 57)
SYMBOL = byte_table(lambda b: chr(b) in "#*$%&|<>")
BAR, BANG, NEWLINE = (byte_table(lambda b, c=c: chr(b) == c) for c in "|!\n")
STOP = byte_table(lambda b: chr(b) in ".?:;")
OTHER = byte_table(lambda b: b < 128 and not chr(b).isalnum() and b > 32)
CLASS = np.select([UPPER, LOWERCASE, DIGIT, SYMBOL, BANG, STOP, OTHER], range(1, 8), 0).astype(np.uint8)
N_FEATURES = 16 + SHAPES


@dataclass(frozen=True)
class Settings:
    hidden: int = 16
    attention: int = 8
    #: Hashed words that have a vector, and its length.
    bits: int = 13
    lexical: int = 8
    epochs: int = 15
    rate: float = 0.01
    decay: float = 1e-4
    lexical_decay: float = 1e-4
    batch: int = 128
    seed: int = 7
    #: Bounds of the fitting sample: labelled rows, and the characters of all of them; texts are never cut.
    rows: int = 6000
    chars: int = 16_000_000


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(measures [passages, N_FEATURES], number of the text of each passage, hashes of all words by passage, words of each
    passage); every text has at least one passage."""
    n_texts = len(column)
    data, offsets = flat(column)
    words = Words(data, offsets, NOT_SPACE)
    n = len(words)
    per_text = np.bincount(words.text, minlength=n_texts)
    bags = np.maximum(1, -(-per_text // PASSAGE))
    first_bag = np.cumsum(bags) - bags
    owner = np.repeat(np.arange(n_texts), bags)
    total = int(bags.sum())
    x = np.zeros((total, N_FEATURES))
    folded, counts = np.zeros(0, np.uint64), np.zeros(total, np.int64)
    if n:
        within = np.arange(n) - (np.cumsum(per_text) - per_text)[words.text]
        bag = first_bag[words.text] + within // PASSAGE
        size = np.bincount(bag, minlength=total).astype(float)
        h = words.hashes(IDENTITY)
        folded, counts = words.hashes(FOLD), size.astype(np.int64)
        length = (words.end - words.start).astype(float)
        has = lambda table: words.sums(table[data]) > 0
        same = np.zeros(n, bool)
        same[1:] = (h[1:] == h[:-1]) & (bag[1:] == bag[:-1])
        lines = np.concatenate([[0], np.cumsum(NEWLINE[data])])
        breaks = np.zeros(n, bool)
        breaks[:-1] = (lines[words.start[1:]] > lines[words.end[:-1]]) & (words.text[1:] == words.text[:-1])
        order = np.lexsort((h, bag))
        fresh = np.ones(n, bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (bag[order][1:] != bag[order][:-1])
        upper, lower = words.sums(UPPER[data]), words.sums(LOWERCASE[data])
        alone = length == 1
        parts = [
            has(SYMBOL), has(BAR) & alone, (upper > 1) & (lower == 0), (upper == 1) & (lower == 0), same, has(BANG), has(STOP), has(DIGIT),
            breaks, length > 16, length <= 3, upper > 0, has(OTHER),
        ]
        for k, part in enumerate(parts):
            x[:, k] = np.bincount(bag, part, total)
        x[:, 13] = np.bincount(bag[order], fresh, total)
        x[:, 14] = np.bincount(bag, np.log1p(length), total)
        # the shape of a word: its sequence of character classes without repeats, hashed
        kind = CLASS[data]
        change = np.ones(len(data), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[words.start] = True
        rank = np.cumsum(change)
        place = np.minimum(rank - np.repeat(rank[words.start], words.end - words.start)[np.cumsum(words.inside) - 1], 7)
        code = words.sums(np.where(change & words.inside, (kind + 1.0) * np.power(11.0, place), 0.0)).astype(np.int64)
        shape = (code * 2654435761 >> 7) % SHAPES
        x[:, 16:] = np.bincount(bag * SHAPES + shape, minlength=total * SHAPES).reshape(total, SHAPES)
        x /= np.maximum(size, 1)[:, None]
        x[:, 15] = np.log1p(size)
    return x, owner, folded, counts


def passages_in_steps(column: pa.Array, bits: int, step: int = SLICE_BYTES // 4) -> tuple[np.ndarray, ...]:
    """``passages`` of many texts, about ``step`` bytes at a time, with words as numbers of ``bits`` bits: what is held at once
    is their measures and these numbers."""
    sizes = np.cumsum([len(t) for t in column.to_pylist()]) // step if len(column) else np.zeros(0)
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(column)]
    found = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        x, owner, h, counts = passages(column.slice(a, b - a))
        found.append((x.astype(np.float32), owner + a, (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32), counts))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def mean_vectors(word: np.ndarray, counts: np.ndarray, vectors: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """The mean of the words' vectors of each passage (zero without a word); ``step`` words' vectors are held at a time."""
    out = np.zeros((len(counts), vectors.shape[1]))
    first = np.cumsum(counts) - counts
    some = np.flatnonzero(counts)
    at = 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(first[some], first[some[at]] + step)))
        part = some[at:end]
        a, b = first[part[0]], first[part[-1]] + counts[part[-1]]
        out[part] = np.add.reduceat(vectors[word[a:b]], first[part] - a) / counts[part, None]
        at = end
    return out


def attend(x: np.ndarray, owner: np.ndarray, n: int, p: dict) -> tuple:
    h = np.tanh(x @ p["We"] + p["be"])
    v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    a = (v * u) @ p["w"]
    first = np.searchsorted(owner, np.arange(n))
    e = np.exp(a - np.maximum.reduceat(a, first)[owner])
    att = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(att[:, None] * h, first, axis=0)
    return h, v, u, att, z, first, sigmoid(z @ p["c"] + p["b"])


def fit(rows: list[tuple[str, int]], s: Settings) -> dict | None:
    """The trained parameters (None without both labels), by Adam on the log loss."""
    if len({y for _, y in rows}) < 2:
        return None
    x, owner, word, counts = passages_in_steps(pa.array([t for t, _ in rows], pa.string()), s.bits)
    y = np.array([y for _, y in rows], float)
    rng = np.random.default_rng(s.seed)
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = ((x - mean) / scale).astype(np.float64)
    small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {
        "E": np.zeros((1 << s.bits, s.lexical)), "We": small(N_FEATURES + s.lexical, s.hidden), "be": np.zeros(s.hidden), "V": small(s.hidden, s.attention),
        "U": small(s.hidden, s.attention), "w": small(s.attention), "c": small(s.hidden), "b": np.zeros(()),
    }
    m, r = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    first, last = np.searchsorted(owner, np.arange(len(y))), np.searchsorted(owner, np.arange(len(y)), "right")
    word_at = np.cumsum(counts) - counts
    spread = lambda start, sizes: np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    step = 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(y))
        rate = s.rate * (1 - epoch / s.epochs) + 1e-4
        for at in range(0, len(y), s.batch):
            part = order[at : at + s.batch]
            sizes = last[part] - first[part]
            rows_at = spread(first[part], sizes)
            bag = np.repeat(np.arange(len(part)), sizes)
            n_words = counts[rows_at]
            words = word[spread(word_at[rows_at], n_words)]
            xb = np.concatenate([x[rows_at], mean_vectors(words, n_words, p["E"])], 1)
            h, v, u, att, z, starts, q = attend(xb, bag, len(part), p)
            d = (q - y[part]) / len(part)
            dz = d[:, None] * p["c"]
            datt = (dz[bag] * h).sum(1)
            da = att * (datt - np.add.reduceat(att * datt, starts)[bag])
            dv, du = da[:, None] * p["w"] * u * (1 - v * v), da[:, None] * p["w"] * v * u * (1 - u)
            dh = (att[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
            dx = (dh @ p["We"][N_FEATURES:].T) / np.maximum(n_words, 1)[:, None]
            dw = np.repeat(np.arange(len(rows_at)), n_words)
            de = np.stack([np.bincount(words, dx[dw, k], 1 << s.bits) for k in range(s.lexical)], 1)
            g = {"E": de, "We": xb.T @ dh, "be": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da, "c": z.T @ d, "b": d.sum()}
            step += 1
            for k in p:
                gk = g[k] + (s.lexical_decay if k == "E" else s.decay) * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                r[k] = 0.999 * r[k] + 0.001 * gk * gk
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(r[k] / (1 - 0.999**step)) + 1e-8)
    p["E"] = p["E"].astype(np.float32)
    return p | {"mean": mean, "scale": scale, "bits": s.bits}


def score_texts(column: pa.Array, model: dict | None) -> np.ndarray:
    """Scores to twelve places: what lies beyond depends on the shape of the batch that a text came in, and a retry may cut others."""
    if model is None:
        return np.full(len(column), 0.5)
    if not len(column):
        return np.zeros(0)
    x, owner, word, counts = passages_in_steps(column, model["bits"], SLICE_BYTES)
    x = np.concatenate([(x - model["mean"]) / model["scale"], mean_vectors(word, counts, model["E"])], 1)
    return attend(x, owner, len(column), model)[-1].round(12)


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, buckets: int = 4, held: int = 2) -> dict | None:
    s = settings or Settings()
    return fit(labelled_sample(docs, labels, "quality", buckets, held, s.rows, s.chars), s)


def score(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, buckets: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; fitted on labels that are not held out."""
    model = fitted(docs, labels, settings, buckets, held)
    return scored(docs, lambda column: score_texts(column, model), buckets, held, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.7) -> DataFrame:
    """The documents that score ``threshold`` or more, all columns as they were. Python sees only texts."""
    from pyspark.sql import functions as F

    model = fitted(docs, labels, settings)
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def quality(texts):
        import pandas as pd

        return pd.Series(score_texts(pa.array(texts.fillna(""), pa.string()), model))

    return docs.withColumn("__score", quality(F.col("text").cast("string"))).where(F.col("__score") >= threshold).drop("__score")
