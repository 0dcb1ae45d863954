"""Line-first cleaning: rules judge each line, failing lines are removed, documents that lose too much are rejected.

Line rules, in this order (a line without a word has none and is kept):
 symbols      over ``symbol_words`` of the words hold a character of [#*$%&|<>]
 navigation   two or more separators | between words, or one for every two other words; or a line of at most ``link_line``
              words without sentence end: over half of them in links (web addresses, [label](target)), or two or more
              other separators (· • » › → /) between parts of at most ``label_words`` words, or at least three words
              over ``label_share`` of which are menu labels (``LABELS``)
 shouting     over ``loud_words`` of the words are upper case with letters, or end in !!
 repeated     ``repeat_words`` or more of the words equal the word before
 boilerplate  a phrase of cookie bars, script notices or placeholder text in a line of at most ``notice_line`` words; a
              longer line fails if sentences with such a phrase hold over ``notice_words`` of its words
 punctuation  fewer than ``short_words`` words and no sentence end in the line, in a document of several lines
A document is kept if it passes the base rules and keeps over ``keep_words`` of its words. Base rules: at least 50
words, and at most half of the words in 3-word windows that occur twice or more.

Defined cases: null text has no words and fails; a text of white space only fails; long texts are read whole; repeated
rows give repeated rows; extra columns are left out of the query and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import inputs, slices, small_batches

SYMBOLS = b"#*$%&|<>"
WORD_OF_SYMBOLS = re.compile(rb"[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*")
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SENTENCE_END = re.compile("(?:[.!?:;]|…|。|！|？)(?:[\"')\\]]|”|’|»)*\\s*$".encode())
SENTENCE_BREAK = re.compile("(?<=[.!?])\\s+|(?<=。|！|？)".encode())
LINK = re.compile(rb"\[[^\]]*\]\([^)\s]*\)|(?<!\S)[<(]*(?:https?://|www\.)\S+", re.IGNORECASE)
#: Signs that stand alone between the parts of a menu or path, and words that menus are made of (fixed values).
SEPARATORS = frozenset(x.encode() for x in "· • » › → / :: >".split())
LABELS = frozenset(
    b"home about us news blog shop store products services contact help faq support login log in out sign up register account profile search menu cart checkout"
    b" privacy terms sitemap careers jobs press team events gallery archive archives categories tags forum subscribe newsletter rss download downloads docs"
    b" documentation pricing features back next previous prev top more".split()
)
BOILERPLATE = re.compile(
    rb"lorem ipsum|ut enim ad minim|duis aute irure|excepteur sint|enable javascript|accept (?:all )?cookies|we use cookies|cookie policy|privacy policy|terms of (?:use|service)"
    rb"|all rights reserved|subscribe to our newsletter|click here|sign (?:in|up) to|share (?:this|on)\b"
)  # of lower-cased lines: faster than re.IGNORECASE
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines_removed long, n_words_kept long, reason string"
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    symbol_words: float = 0.3
    loud_words: float = 0.6
    repeat_words: float = 0.3
    short_words: int = 3
    keep_words: float = 0.5
    link_line: int = 20
    label_words: int = 3
    label_share: float = 0.7
    notice_line: int = 40
    notice_words: float = 0.5


def repeated_window_words(words: list[bytes]) -> int:
    """How many words lie in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    # a word's number is the place where it first stands; three of them make one exact integer
    ids = np.array(list(map({}.setdefault, words, range(n))), np.int64)
    if n < 1 << 21:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        windows = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * np.int64(n) + ids[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(windows, again))
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def shouting(line: bytes, words: list[bytes], most: float) -> bool:
    """Whether over ``most`` words are upper case with letters, or end in !!."""
    # bytes.isupper() knows ASCII letters only
    upper = sum(map(bytes.isupper, words)) if line.isascii() else sum(map(str.isupper, map(bytes.decode, words)))
    if upper <= most and b"!!" not in line:  # without !! no more words are loud than are upper case
        return False
    return sum(w.endswith("!!") or (len(w) > 1 and w.isupper()) for w in map(bytes.decode, words)) > most


def links(line: bytes, words: list[bytes]) -> bool:
    """Whether over half of the words are in links, in a line without sentence end."""
    if not (b"://" in line or b"](" in line or b"www." in line.lower()):  # what any link holds
        return False
    return 2 * len(LINK.sub(b" ", line).split()) < len(words) and not SENTENCE_END.search(line)


def menu(line: bytes, words: list[bytes], rules: Rules) -> bool:
    """Whether a short line without sentence end is a row of short parts between separators, or mostly menu labels."""
    if any(map(SEPARATORS.__contains__, words)):
        bars = [-1, *(i for i, w in enumerate(words) if w in SEPARATORS), len(words)]
        if len(bars) >= 4 and max(b - a - 1 for a, b in zip(bars, bars[1:], strict=False)) <= rules.label_words:
            return not SENTENCE_END.search(line)
    if len(words) < 3:
        return False
    return sum(w in LABELS for w in line.lower().split()) > rules.label_share * len(words) and not SENTENCE_END.search(line)


def boilerplate(line: bytes, n: int, rules: Rules) -> bool:
    """Whether a line of n words has a boilerplate phrase, or, if it is long, consists mostly of sentences that have one."""
    line = line.lower()
    if not BOILERPLATE.search(line):
        return False
    if n <= rules.notice_line:
        return True
    sizes = [(len(x.split()), bool(BOILERPLATE.search(x))) for x in SENTENCE_BREAK.split(line)]
    return sum(k for k, found in sizes if found) > rules.notice_words * sum(k for k, _ in sizes)


def line_rule(line: bytes, words: list[bytes], alone: bool, rules: Rules) -> str | None:
    """The rule that the line fails, if any. alone: it is the document's only line with words."""
    n = len(words)
    if len(line.translate(None, SYMBOLS)) < len(line):
        bars = words.count(b"|")
        if bars >= 2 or bars and 3 * bars >= n:
            return "navigation"
        if len(WORD_OF_SYMBOLS.findall(line)) > rules.symbol_words * n:
            return "symbols"
    if n <= rules.link_line and (links(line, words) or menu(line, words, rules)):
        return "navigation"
    if n >= 3 and shouting(line, words, rules.loud_words * n):
        return "shouting"
    if n >= 4 and sum(map(bytes.__eq__, words, words[1:])) >= rules.repeat_words * n:
        return "repeated"
    if boilerplate(line, n, rules):
        return "boilerplate"
    if not alone and n < rules.short_words and not SENTENCE_END.search(line):
        return "punctuation"
    return None


def judge(text: str, rules: Rules) -> tuple[dict, list[bytes]]:
    """The measures of a text, and its lines (UTF-8) without those that fail."""
    data = text.encode()
    split = [(line, line.split()) for line in data.split(b"\n")]  # bytes split at exactly \x20 and \x09-\x0D
    words = [w for _, in_line in split for w in in_line]
    n = len(words)
    n_repeat = repeated_window_words(words)
    seen: set[bytes] = set()
    n_dup = removed = kept_words = 0
    lines, reasons = [], {}
    alone = sum(bool(w) for _, w in split) == 1
    for line, in_line in split:
        if in_line:
            if line in seen:
                n_dup += 1
            seen.add(line)
            failed = line_rule(line, in_line, alone, rules)
            if failed:
                removed += 1
                reasons[failed] = reasons.get(failed, 0) + len(in_line)
                continue
            kept_words += len(in_line)
        lines.append(line)
    failed = n < rules.min_words or 100 * n_repeat > 50 * n
    kept = not failed and kept_words > rules.keep_words * n
    reason = None if kept else "base" if failed else max(sorted(reasons), key=reasons.get)
    measures = {
        "n_words": n, "word_chars": len(text) - len(data) + len(data.translate(None, SPACE)),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": kept, "n_lines_removed": removed, "n_words_kept": kept_words, "reason": reason,
    }
    return measures, lines


def quality(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id and the measures and verdict of every whole text."""
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            found = [judge(t.as_py(), rules)[0] for t in texts]
            names = list(found[0]) if found else []
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "reason": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[c] for x in found], kinds.get(c, pa.int64())) for c in names)], ["doc_id", *names])

    return inputs(docs).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, rules: Rules | None = None, drop: bool = True) -> DataFrame:
    """The kept documents with failing lines removed from ``text``; all columns, in their order. Python sees only texts."""
    rules = rules or Rules()
    small_batches(docs.sparkSession)

    @F.pandas_udf("kept boolean, text string")
    def cleaned(texts):
        import pandas as pd

        kept, out = [], []
        for t in texts:
            measures, lines = judge(t or "", rules)
            kept.append(measures["kept"])
            out.append(b"\n".join(lines).decode() if measures["kept"] or not drop else "")
        return pd.DataFrame({"kept": kept, "text": out})

    cleaned = cleaned.asNondeterministic()  # else filter and projection would each run it
    marked = docs.withColumn("__clean", cleaned(F.col("text").cast("string")))
    if drop:
        marked = marked.where("__clean.kept")
    return marked.withColumn("text", F.col("__clean.text")).drop("__clean")
