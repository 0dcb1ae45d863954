"""Text functions as columns: built-in expressions where they can say it, Arrow-batched functions where not."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# types as objects: this module can be imported before there is a session
STRING = StringType()
MAPPED = StructType().add("text", STRING).add("raw_start", ArrayType(IntegerType())).add("raw_end", ArrayType(IntegerType()))
SEGMENTS = ArrayType(StructType().add("seq", IntegerType()).add("start", IntegerType()).add("end", IntegerType()).add("tokens", IntegerType()))
QUOTES_AND_DASHES = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " "}


@F.pandas_udf(STRING)
def canonical(texts: pd.Series) -> pd.Series:
    """NFKC, plain quotes and dashes, one space between words, trimmed."""
    table = str.maketrans(QUOTES_AND_DASHES)
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(table).split()))


@F.pandas_udf(STRING)
def lookup_key(texts: pd.Series) -> pd.Series:
    """The canonical text, case-folded: the key of dictionary lookups."""
    table = str.maketrans(QUOTES_AND_DASHES)
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(table).split()).casefold())


@F.pandas_udf(STRING)
def folded_key(texts: pd.Series) -> pd.Series:
    """The lookup key without combining marks."""
    def fold(t: str | None) -> str | None:
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))

    return texts.map(fold)


@F.pandas_udf(MAPPED)
def visible_with_offsets(sources: pd.Series) -> pd.DataFrame:
    """Markup to text with maps back: character i of text came from source[raw_start[i]:raw_end[i]]."""
    unit = re.compile(r"<[^>]*>|&#?\w{1,30};|\s+|.", re.DOTALL)

    def one(source: str | None) -> tuple:
        if source is None:
            return None, None, None
        out, starts, ends = [], [], []
        for found in unit.finditer(source):
            piece = found.group()
            shown = " " if piece[0] == "<" and len(piece) > 1 else html.unescape(piece) if piece[0] == "&" else unicodedata.normalize("NFKC", piece)
            for c in shown:
                c = " " if c.isspace() else c
                if c == " " and (not out or out[-1] == " "):
                    continue
                out.append(c)
                starts.append(found.start())
                ends.append(found.end())
        if out and out[-1] == " ":
            for column in (out, starts, ends):
                column.pop()
        return "".join(out), starts, ends

    return pd.DataFrame([one(s) for s in sources], columns=["text", "raw_start", "raw_end"])


def raw_span(mapped: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The raw (start, end) of a span of normalised text."""
    return F.element_at(mapped["raw_start"], start + 1), F.element_at(mapped["raw_end"], end)


def strip_tags(source: Column) -> Column:
    """Markup without its tags, one space between words (no offsets, no character references)."""
    return F.trim(F.regexp_replace(F.regexp_replace(source, "<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " "))


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits of any script."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def token_count(text: Column) -> Column:
    """Tokens: a word character of any script, then word characters or .+&/- until the last word character."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_.+&/-]*"))


def slug(text: Column) -> Column:
    """Lower case, every other run of characters a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def stable_id(provider: str, pack: Column, label: Column, text: Column, given: Column) -> Column:
    return F.coalesce(given, F.concat_ws(":", F.lit("entity"), F.lit(provider), pack, label, slug(text)))


def initialism(text: Column, connectors: tuple[str, ...] = ("of", "the", "and", "for", "de", "la")) -> Column:
    """Upper-case first letters of the words that are no connectors; null under two letters."""
    parts = F.filter(F.split(F.trim(text), r"[\s#-]+"), lambda w: (w != "") & ~F.lower(w).isin(*connectors))
    letters = F.array_join(F.transform(parts, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.length(letters) >= 2, letters)


def surface_similarity(left: Column, right: Column) -> Column:
    """1 if equal, 0.9 if one contains the other, else the Jaccard of their words, to 4 places."""
    a, b = F.lower(F.trim(left)), F.lower(F.trim(right))
    x, y = F.array_distinct(F.split(a, " +")), F.array_distinct(F.split(b, " +"))
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(F.round(jaccard, 4))


def alias_variants(text: Column, suffixes: tuple[str, ...] = ("inc", "ltd", "llc", "corp", "plc", "gmbh", "sa")) -> Column:
    """Distinct surface variants: as it is, without a trailing company suffix, hyphens as spaces, without an article, initials."""
    stripped = F.regexp_replace(text, rf"(?i)[ ,]+({'|'.join(suffixes)})\.?$", "")
    spaced = F.trim(F.regexp_replace(text, "[-/#]+", " "))
    bare = F.regexp_replace(text, "(?i)^the +", "")
    return F.array_distinct(F.filter(F.array(text, stripped, spaced, bare, initialism(text)), lambda v: v.isNotNull() & (v != "")))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ? before white space, and at blank lines."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n{2,}"), lambda s: F.trim(s) != "")


@F.pandas_udf(SEGMENTS)
def segments(texts: pd.Series) -> pd.Series:
    """Sentences packed greedily into segments of at most 4000 characters and 800 tokens; longer ones are cut at tokens."""
    most_chars, most_tokens = 4000, 800
    token, cut = re.compile(r"\S+"), re.compile(r"(?<=[.!?])\s+|\n{2,}")

    def units(text: str):
        at = 0
        for found in [*cut.finditer(text), None]:
            end = found.start() if found else len(text)
            spans = [m.span() for m in token.finditer(text, at, end)]
            while spans:
                k = 1
                while k < len(spans) and k < most_tokens and spans[k][1] - spans[0][0] <= most_chars:
                    k += 1
                yield spans[0][0], spans[k - 1][1], k
                spans = spans[k:]
            at = found.end() if found else end

    def one(text: str | None) -> list:
        out = []
        for start, end, n in units(text or ""):
            if out and end - out[-1]["start"] <= most_chars and out[-1]["tokens"] + n <= most_tokens:
                out[-1]["end"], out[-1]["tokens"] = end, out[-1]["tokens"] + n
            else:
                out.append({"seq": len(out), "start": start, "end": end, "tokens": n})
        return out

    return texts.map(one)
