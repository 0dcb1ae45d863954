"""Names, keys, dates and numbers of source records in one form. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def undotted(text: Column) -> Column:
    """Single capitals with dots as one word: 'U. S. A.' and 'U.S.A.' become 'USA'; other texts stay."""
    return F.when(text.rlike(r"^([A-Z]\. ?){2,}$"), F.regexp_replace(text, r"[. ]", "")).otherwise(text)


def first_last(text: Column) -> Column:
    """First and last word of names of three or four words, else null."""
    w = F.split(F.trim(text), r"[ \t]+")
    return F.when(F.size(w).between(3, 4), F.concat_ws(" ", w[0], F.element_at(w, -1)))


def display_name(slug: Column, kind: Column) -> Column:
    """A slug as a name: currencies in capitals, other words with a capital first."""
    spaced = F.regexp_replace(slug, "[-_]+", " ")
    return F.when(kind == "currency", F.upper(spaced)).otherwise(F.initcap(spaced))


def day_of(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")) -> Column:
    """The date of a text in the first format that reads it; a bare year is its first day; null if none does."""
    year = F.when(text.rlike(r"^[0-9]{4}$"), F.concat(text, F.lit("-01-01")).cast("date"))
    return F.coalesce(year, *(F.try_to_date(text, f) for f in formats))


def qid(text: Column) -> Column:
    """The Q number in an address or prefixed id, upper case; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?:^|[/:])([Qq][1-9][0-9]*)$", 1)), F.lit(""))


def clamped(text: Column, otherwise: float) -> Column:
    """A text's number within 0 and 1; ``otherwise`` where it is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(text.try_cast("double"), F.lit(otherwise))))


def ticker_keys(ticker: Column, exchange: Column) -> Column:
    """Lookup keys of a ticker: with its exchange, then alone."""
    t = F.upper(F.trim(ticker))
    return F.array_compact(F.array(F.concat(F.upper(F.trim(exchange)), F.lit(":"), t), t))


def alias_drop_reason(alias: Column, stop: tuple[str, ...], least: int = 2) -> Column:
    """Why an alias is dropped: 'stop_list', 'too_short', 'no_letter_or_digit', 'number'; null if it stays."""
    a = F.lower(F.trim(alias))
    return (
        F.when(a.isin(*stop), "stop_list").when(F.length(a) < least, "too_short")
        .when(~a.rlike(r"[\p{L}\p{N}]"), "no_letter_or_digit").when(a.rlike(r"^[0-9]+$"), "number")
    )


def redirected(edges: Column, overrides: list[tuple[Column, str, str]]) -> Column:
    """Edges (array of structs with relation and direction): each override (condition, relation, direction) that holds applies."""
    def turn(condition: Column, relation: str, direction: str) -> Callable[[Column], Column]:
        return lambda e: F.when(F.coalesce(condition, F.lit(False)) & (e["relation"] == relation), e.withField("direction", F.lit(direction))).otherwise(e)

    for override in overrides:
        edges = F.transform(edges, turn(*override))
    return edges
