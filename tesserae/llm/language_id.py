"""Language ID: a linear-chain conditional random field labels every word of a text, code-switched texts included.

Words are runs of letters, lower-cased. Their features, hashed: prefixes and suffixes of 1 to 3 bytes, all byte 2-grams
and 3-grams of the word with its edges marked, and the word itself (the learned lexicon). Emissions and the transition
matrix are trained together by the forward-backward gradient on a bounded sample; training chains join windows of
different documents, so that transitions learn switches. Every sampled text with a word gives windows, one of under
``window`` words a single shorter one. The language of a text is the label with the largest sum of word marginals, its
score that sum's share.

Inference runs forward-backward exactly over whole texts, all texts of a slice as one chain: where a text starts, the
transition is the start distribution whatever came before. The chain is cut into blocks whose transfer matrices are
multiplied for all blocks at once, so a text of millions of words costs no long Python loop. A slice longer than about a
megabyte, or one of more words than the number of languages allows, is read in parts, twice: the first pass leaves each
part's transfer matrix, the second computes marginals between what the parts before and after pass on. So features and
emissions are held for one part only, and the result is that of one chain.

Defined cases: a null text, an empty one and one without a letter give `und` with score 0; without any training row too;
a run of letters of over ``WORD_BYTES`` bytes counts as several words; repeated rows give repeated rows; extra columns are
left out.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import flat, IDENTITY, inputs, LETTERLIKE, mixed, remainder, slices, TABULATION, whole_texts, Words

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class Settings:
    bits: int = 16
    window: int = 16
    steps: int = 160
    batch: int = 192
    rate: float = 0.5
    seed: int = 11
    #: Bounds of the fitting sample, dealt evenly over all languages: documents, and the characters of all of them. Every
    #: language has one document at least; texts are never cut.
    rows: int = 2400
    chars: int = 6_000_000


#: Bytes of a text that features are held for at a time, and of the longest word.
PART_BYTES = 1 << 20
WORD_BYTES = 1024
#: Words of a block of the chain, and numbers that all blocks' transfer matrices may hold.
BLOCK = 64
CELLS = 1 << 22


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The runs of letters; one that is longer than ``WORD_BYTES`` as several words."""
    words = Words(data, offsets, LETTERLIKE)
    count = -(-(words.end - words.start) // WORD_BYTES)
    if len(words) and count.max() > 1:
        step = WORD_BYTES * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        end = np.repeat(words.end, count)
        words.start = np.repeat(words.start, count) + step
        words.end = np.minimum(end, words.start + WORD_BYTES)
        words.text = np.repeat(words.text, count)
    return words


def some_words(words: Words, first: int, last: int) -> Words:
    """Words ``first`` to ``last`` of a slice, with the bytes between them."""
    last = min(last, len(words))
    if first == 0 and last == len(words):
        return words
    part = copy.copy(words)
    a, b = words.start[first], words.end[last - 1]
    part.data, part.inside = words.data[a:b], words.inside[a:b]
    part.start, part.end, part.text = words.start[first:last] - a, words.end[first:last] - a, words.text[first:last]
    return part


def text_parts(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[Words, np.ndarray]]:
    """(words, whether each begins a text) of a slice in order, at most ``most`` words at a time.

    A slice of several texts has at most about ``PART_BYTES``; a longer one is a single text and cut after a word.
    """
    at, before = 0, -1
    while at < len(data):
        end = len(data)
        if len(offsets) == 2 and end - at > PART_BYTES:
            end = at + PART_BYTES
            while end < len(data):
                gap = np.flatnonzero(~LETTERLIKE[data[end : end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(len(data), end + 4096)
        words = words_of(data[at:end], offsets if end - at == len(data) else np.array([0, end - at]))
        first = 0
        while first < len(words):
            within = int(np.searchsorted(words.start, words.start[first] + 2 * PART_BYTES))
            part = some_words(words, first, min(first + most, within))
            first += len(part)
            begins = np.diff(part.text, prepend=before) != 0
            before = part.text[-1]
            yield part, begins
        at = end


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def word_features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of every word, by word."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.uint64(64 - bits)
    size = words.end - words.start
    whole = np.arange(n)
    owners, buckets = [whole], [mixed(words.hashes(IDENTITY) + np.uint64(1)) >> shift]
    # bytes with an edge mark (0) before and after every word
    at = np.flatnonzero(words.inside)
    number = np.repeat(whole, size)
    padded = np.zeros(len(at) + 2 * n, np.uint8)
    padded[np.arange(len(at)) + 2 * number + 1] = words.data[at]
    first = np.cumsum(size + 2) - (size + 2)
    last = first + size + 1
    owner = np.repeat(whole, size + 2)
    two = TABULATION[1, padded[:-1]] + TABULATION[2, padded[1:]]
    inner = owner[:-1] == owner[1:]
    owners.append(owner[:-1][inner])
    buckets.append(mixed(two[inner]) >> shift)
    three = two[:-1] + TABULATION[3, padded[2:]]
    inner = owner[:-2] == owner[2:]
    owners.append(owner[:-2][inner])
    buckets.append(mixed(three[inner] * np.uint64(3)) >> shift)
    head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(3):
        on = size > k
        head[on] += TABULATION[4 + k, padded[first[on] + 1 + k]]
        tail[on] += TABULATION[8 + k, padded[last[on] - 1 - k]]
        owners += [whole[on], whole[on]]
        buckets += [mixed(head[on] + np.uint64(k)) >> shift, mixed(tail[on] * np.uint64(5) + np.uint64(k)) >> shift]
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def emissions(words: Words, weights: np.ndarray, bits: int) -> np.ndarray:
    """Log emissions [words, labels]: the sum of the weights of each word's features."""
    owner, bucket = word_features(words, bits)
    return np.stack([np.bincount(owner, weights[bucket, k], len(words)) for k in range(weights.shape[1])], 1)


class Chain:
    """Forward-backward over a chain of words that begins anew wherever ``starts`` is true, in blocks of ``block`` words.

    Words that fill up the last block pass everything through unchanged.
    """

    def __init__(self, emit: np.ndarray, starts: np.ndarray, transition: np.ndarray, begin: np.ndarray, block: int = BLOCK) -> None:
        self.n, self.size = emit.shape
        self.block, self.blocks = block, -(-self.n // block)
        self.filled = self.n - (self.blocks - 1) * block  # words of the last block
        e = np.ones((self.blocks * block, self.size))
        e[: self.n] = np.exp(emit - emit.max(1, keepdims=True))
        begins = np.zeros(self.blocks * block, bool)
        begins[: self.n] = starts
        self.e, self.begins = e.reshape(self.blocks, block, self.size), begins.reshape(self.blocks, block)
        self.t, self.pi = np.exp(transition), np.exp(begin - begin.max())
        self.products = np.broadcast_to(np.eye(self.size), (self.blocks, self.size, self.size))
        for k in range(block):
            step = np.where(self.begins[:, k, None, None], self.pi[None, None, :], self.t[None]) * self.e[:, k, None, :]
            if k >= self.filled:
                step[-1] = np.eye(self.size)
            self.products = self.products @ step
            self.products = self.products / self.products.sum((1, 2), keepdims=True)

    def transfer(self) -> np.ndarray:
        """The product of the whole chain's matrices, scaled."""
        total = np.eye(self.size)
        for p in self.products:
            total = total @ p
            total = total / total.sum()
        return total

    def marginals(self, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
        """Word marginals [n, labels], between the forward message before and the backward message after the chain."""
        blocks, block, size, e, t, pi = self.blocks, self.block, self.size, self.e, self.t, self.pi
        ahead, back = np.ones((blocks, size)) / size, np.ones((blocks, size)) / size
        ahead[0] = ahead[0] if enter is None else enter
        back[-1] = back[-1] if leave is None else leave
        for b in range(1, blocks):
            v = ahead[b - 1] @ self.products[b - 1]
            ahead[b] = v / v.sum()
        for b in range(blocks - 2, -1, -1):
            v = self.products[b + 1] @ back[b + 1]
            back[b] = v / v.sum()
        alphas, alpha = np.empty((block, blocks, size)), ahead
        for k in range(block):
            moved = np.where(self.begins[:, k, None], alpha.sum(1, keepdims=True) * pi, alpha @ t) * e[:, k]
            if k >= self.filled:
                moved[-1] = alpha[-1]
            alpha = alphas[k] = moved / moved.sum(1, keepdims=True)
        out, beta = np.empty((block, blocks, size)), back
        for k in range(block - 1, -1, -1):
            both = alphas[k] * beta
            out[k] = both / both.sum(1, keepdims=True)
            step = e[:, k] * beta
            moved = np.where(self.begins[:, k, None], (step @ pi)[:, None], step @ t.T)
            if k >= self.filled:
                moved[-1] = beta[-1]
            beta = moved / moved.sum(1, keepdims=True)
        return out.transpose(1, 0, 2).reshape(-1, size)[: self.n]


def marginals(emit: np.ndarray, starts: np.ndarray, transition: np.ndarray, begin: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Word marginals [n, labels] of one chain."""
    return Chain(emit, starts, transition, begin, block).marginals()


def training_windows(word_text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each text's windows: every half window, the last one at the text's end."""
    texts, first, n = np.unique(word_text, return_index=True, return_counts=True)
    half = max(1, window // 2)
    count = 1 + -(-np.maximum(n - window, 0) // half)
    owner = np.repeat(np.arange(len(texts)), count)
    step = half * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    return first[owner] + np.minimum(step, np.maximum(n - window, 0)[owner]), np.minimum(n, window)[owner]


def fit(rows: list[tuple[str, str]], s: Settings) -> dict | None:
    """Labels, emission weights, transitions and start scores from (text, language) rows, by AdaGrad on the CRF likelihood."""
    names = sorted({y for _, y in rows})
    if not names:
        return None
    size = len(names)
    text_of, sizes, features = [], [], []
    for begin in range(0, len(rows), 64):
        words = words_of(*flat(lowered(pa.array([t for t, _ in rows[begin : begin + 64]], pa.string()))))
        owner, bucket_ = word_features(words, s.bits)
        features.append(bucket_[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(words)))
        text_of.append(words.text + begin)
    bucket, word_text = np.concatenate(features), np.concatenate(text_of)
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    label_of = np.array([names.index(y) for _, y in rows])
    # windows of words of one document, dealt by language
    n_words = len(word_text)
    weights, transition, begin = np.zeros((1 << s.bits, size)), np.zeros((size, size)), np.zeros(size)
    if size == 1 or not n_words:
        return {"names": names, "weights": weights, "transition": transition, "begin": begin}
    firsts, lengths = training_windows(word_text, s.window)
    texts, first_window, n_windows = np.unique(word_text[firsts], return_index=True, return_counts=True)
    by_language = [np.flatnonzero(label_of[texts] == k) for k in range(size)]
    present = [k for k in range(size) if len(by_language[k])]
    rng = np.random.default_rng(s.seed)
    gw, gt, gb = np.full(weights.shape, 1e-2), np.full(transition.shape, 1e-2), np.full(size, 1e-2)
    for _ in range(s.steps):
        # a chain is two windows, often of two languages; a window is drawn from a text drawn from its language
        pick = rng.choice(present, (s.batch, 2))
        pick[:, 1] = np.where(rng.random(s.batch) < 0.5, pick[:, 0], pick[:, 1])
        drawn = np.array([[by_language[k][rng.integers(len(by_language[k]))] for k in pair] for pair in pick])
        picked = first_window[drawn] + rng.integers(n_windows[drawn])
        begin_at, lead, total = firsts[picked], lengths[picked[:, :1]], lengths[picked].sum(1)
        length = total.max()
        place = np.arange(length)
        inside = place < total[:, None]  # shorter chains are padded at their end
        chain = np.where(inside, np.where(place < lead, begin_at[:, :1] + place, begin_at[:, 1:] + place - lead), 0)
        gold = label_of[word_text[chain]]
        flat_chain = chain[inside]
        counts = at[flat_chain + 1] - at[flat_chain]
        rows_at = np.repeat(at[flat_chain] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        token, feature = np.repeat(np.arange(len(flat_chain)), counts), bucket[rows_at]
        emit = np.stack([np.bincount(token, weights[feature, k], len(flat_chain)) for k in range(size)], 1)
        e = np.ones((*chain.shape, size))
        e[inside] = np.exp(emit - emit.max(1, keepdims=True))
        t, pi = np.exp(transition), np.exp(begin)
        on = inside.T[:, :, None]
        alphas, betas = np.empty((length, s.batch, size)), np.empty((length, s.batch, size))
        a = pi * e[:, 0]
        alphas[0] = a / a.sum(1, keepdims=True)
        for k in range(1, length):
            a = (alphas[k - 1] @ t) * e[:, k]
            alphas[k] = np.where(on[k], a / a.sum(1, keepdims=True), alphas[k - 1])
        betas[-1] = 1 / size
        for k in range(length - 2, -1, -1):
            v = (e[:, k + 1] * betas[k + 1]) @ t.T
            betas[k] = np.where(on[k + 1], v / v.sum(1, keepdims=True), betas[k + 1])
        p = alphas * betas
        p /= p.sum(2, keepdims=True)
        pairs = alphas[:-1, :, :, None] * t * (e.transpose(1, 0, 2)[1:] * betas[1:])[:, :, None, :]
        pairs *= on[1:, :, :, None] / pairs.sum((2, 3), keepdims=True)
        hot = np.eye(size)[gold]
        d = (hot - p.transpose(1, 0, 2))[inside] / s.batch
        seen = np.zeros((size, size))
        np.add.at(seen, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
        for store, grown, g in (
            (weights, gw, np.stack([np.bincount(feature, d[token, k], 1 << s.bits) for k in range(size)], 1)),
            (transition, gt, (seen - pairs.sum((0, 1))) / s.batch),
            (begin, gb, (hot[:, 0] - p[0]).mean(0)),
        ):
            grown += g * g
            store += s.rate * g / np.sqrt(grown)
    return {"names": names, "weights": weights.astype(np.float32), "transition": transition, "begin": begin}


def label_texts(column: pa.Array, model: dict | None, bits: int) -> tuple[list[str], np.ndarray]:
    """The language and score of each text (no nulls)."""
    n = len(column)
    if model is None:
        return ["und"] * n, np.zeros(n)
    size = len(model["names"])
    data, offsets = flat(lowered(column))
    most = BLOCK * max(1, CELLS // size**2)
    total, ascii_letter = np.zeros((n, size)), np.zeros(n, bool)

    def chain(words: Words, begins: np.ndarray) -> Chain:
        return Chain(emissions(words, model["weights"], bits), begins, model["transition"], model["begin"])

    def add(words: Words, p: np.ndarray) -> None:
        total[:] += np.stack([np.bincount(words.text, p[:, k], n) for k in range(size)], 1)
        has = words.sums(((words.data | 32) >= 97) & ((words.data | 32) <= 122)) > 0
        ascii_letter[words.text[has]] = True

    parts = list(islice(text_parts(data, offsets, most), 2))
    if len(parts) == 1:
        add(parts[0][0], chain(*parts[0]).marginals())
    elif parts:
        del parts
        passed = [chain(*part).transfer() for part in text_parts(data, offsets, most)]
        leave = [np.ones(size) / size]
        for t in reversed(passed[1:]):
            v = t @ leave[-1]
            leave.append(v / v.sum())
        enter = np.ones(size) / size
        for part in text_parts(data, offsets, most):
            add(part[0], chain(*part).marginals(enter, leave.pop()))
            enter = enter @ passed.pop(0)
            enter = enter / enter.sum()
    best = total.argmax(1)
    score = total[np.arange(n), best] / np.maximum(total.sum(1), 1e-12)
    names = [model["names"][k] for k in best]
    # texts whose only "letters" are bytes of other characters
    for i in np.flatnonzero(~ascii_letter):
        if not any(map(str.isalpha, column[i].as_py())):
            names[i], score[i] = "und", 0.0
    return names, score


def training_rows(docs: DataFrame, s: Settings, buckets: int, held: int) -> list[tuple[str, str]]:
    """Up to ``rows`` whole texts, evenly of all languages, chosen by hash among rows not held out.

    Rows are thinned by hash where they are read, so a language with a third of all rows never meets in one task. The
    table of languages is collected: a column of languages has few values.
    """
    usable = docs.select("lang", "doc_id", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", buckets) != held)
    )
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return []
    each, chars = max(1, s.rows // len(counts)), s.chars // len(counts)
    # each language is thinned by hash to about twice its share and some, then cut exactly on the driver
    share = pa.table({"lang": [r["lang"] for r in counts], "share": [min(1.0, (2.0 * each + 20) / r["count"]) for r in counts]})
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    found = usable.join(docs.sparkSession.createDataFrame(share), "lang").where(draw < F.col("share"))
    found = found.groupBy("doc_id", "lang").agg(F.max("text").alias("text"))
    return [(text, lang) for _, lang, text in whole_texts(found, ["doc_id", "lang"], each, chars, "lang")]


def identify(docs: DataFrame, settings: Settings | None = None, buckets: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; fitted on rows that are not held out."""
    s = settings or Settings()
    model = fit(training_rows(docs, s, buckets, held), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", PART_BYTES):
            names, score = label_texts(texts, model, s.bits)
            out = [None if i is None else zlib.crc32(str(i).encode()) % buckets == held for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.bool_()), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return inputs(docs).mapInArrow(run, SCHEMA)
