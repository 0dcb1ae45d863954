"""Rules on candidates, records and source entities as columns. Word lists and thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(score: Column, places: int = 4) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), places)


def has_strong_path(evidence: Column, confidence: Column, paths: Column) -> Column:
    """Direct evidence; shallow of .78 or more with a path; a path of one step with a direct edge; or one all of whose edges are
    direct or shallow with .8 or more. paths: array of (depth, edges of (relation, evidence, confidence))."""
    near = F.exists(paths, lambda p: (p["depth"] <= 1) & F.exists(p["edges"], lambda e: e["evidence"] == "direct"))
    firm = F.exists(paths, lambda p: (F.size(p["edges"]) > 0) & F.forall(p["edges"], lambda e: e["evidence"].isin("direct", "shallow") & (e["confidence"] >= 0.8)))
    return (evidence == "direct") | ((evidence == "shallow") & (confidence >= 0.78) & (F.size(paths) > 0)) | near | firm


def has_direct_listing(paths: Column, listings: list[str], least: float = 0.8) -> Column:
    """Whether any edge is a direct listing of ``least`` or more."""
    return F.exists(paths, lambda p: F.exists(p["edges"], lambda e: e["relation"].isin(listings) & (e["evidence"] == "direct") & (e["confidence"] >= least)))


def families(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The families one of whose keywords the text holds, without regard to case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(F.greatest(*(F.contains(low, F.lit(k)) for k in ks), F.lit(False)), F.lit(name)) for name, ks in keywords.items())))


def broad_proxy(text: Column, family: Column, paths: Column, words: list[str], sector: str = "sector") -> Column:
    """A broad stand-in for a market: a word says so, it is of country risk, or an index without a way over a sector."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.greatest(*(F.contains(low, F.lit(w)) for w in words), F.lit(False))
    by_sector = F.contains(low, F.lit(sector)) | F.exists(paths, lambda p: F.exists(p["edges"], lambda e: e["relation"] == f"{sector}_affects_index"))
    return named | F.array_contains(family, "country_risk") | (F.array_contains(family, "equity_index") & ~by_sector)


def compatible_events(edge_events: Column, signals: Column) -> Column:
    """The signals' types that an edge's event types hold."""
    return F.array_sort(F.array_intersect(edge_events, signals))


def record_accepted(flag: Column, status: Column, rejected_reason: Column, accept: list[str], reject: list[str]) -> Column:
    """A record's own flag first, then its status: a rejected one or one with a reason goes, else one of ``accept`` stays or any
    without status."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    refused = s.isin(reject) | F.greatest(*(F.contains(s, F.lit(r)) for r in reject), F.lit(False)) | (F.trim(F.coalesce(rejected_reason, F.lit(""))) != "")
    return F.when(refused, False).otherwise(F.coalesce(flag, (s == "") | s.isin(accept)))


def market_relevance(text: Column, market: list[str], refuse: list[str], boost: float = 1.25) -> Column:
    """A record's weight by its topics: 0 with a refused one, ``boost`` with one of the market, else 1."""
    words = lambda names: r"(?i)\b(" + "|".join(names) + r")\b"
    return F.when(text.rlike(words(refuse)), 0.0).when(text.rlike(words(market)), boost).otherwise(1.0)


def probable_outlet(name: Column, kind: Column, endings: list[str]) -> Column:
    """An organisation whose name ends like a news outlet's."""
    return kind.isin("organization", "org") & F.lower(name).rlike(r"\b(" + "|".join(endings) + r")$")


def enough_links(sitelinks: Column, kind: Column, least: dict[str, int], aliases: Column, otherwise: int = 5) -> Column:
    """Sitelinks reach the type's minimum; where they are not known, two or more aliases do."""
    minimum = F.coalesce(F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[kind], F.lit(otherwise)) if least else F.lit(otherwise)
    return F.when(sitelinks.isNull(), aliases >= 2).otherwise(sitelinks >= minimum)


def place_kept(feature: Column, population: Column, always: list[str], least: dict[str, int]) -> Column:
    """Places with a feature code that always counts, or as many people as their code asks for."""
    minimum = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[feature]
    return feature.isin(always) | F.coalesce(F.coalesce(population, F.lit(0)) >= minimum, F.lit(False))


def skip_single_word(matched: Column, alias: Column, label: Column, frequency: Column, stops: list[str], most: float = 4.95) -> Column:
    """The reason to skip a dictionary hit of one word, or null: lower case for a name, a stop word (calendar, numbers), only
    digits, an acronym written as a word, or a word so frequent (log10 of a billion words) that it means itself."""
    name = label.isin("person", "organization", "location")
    return (
        F.when(F.lower(matched).isin(stops), "stop_word").when(matched.rlike(r"^[0-9.,%]+$"), "number")
        .when(name & (matched == F.lower(matched)) & (matched != F.upper(matched)), "lower_case")
        .when(alias.rlike(r"^\p{Lu}{2,5}$") & (matched != alias), "acronym_case")
        .when((frequency >= most) & ~alias.rlike(r"^\p{Lu}{2,}$"), "frequent_word")
    )


def skip_phrase(matched: Column, label: Column, stops: list[str]) -> Column:
    """The reason to skip a dictionary hit of several words, or null: all lower case for a name, or only stop words and numbers."""
    words = F.split(F.lower(matched), " +")
    empty = F.forall(words, lambda w: w.isin(stops) | w.rlike("^[0-9]+$"))
    return F.when(empty, "stop_words").when(label.isin("person", "organization") & (matched == F.lower(matched)), "lower_case")


def hybrid_score(f: dict[str, Column]) -> Column:
    """The weighted sum of nine features (0 to 1; absent ones count 0), less .04 for a generated alias, 0 to 1."""
    weights = {
        "proposal": 0.24, "alias": 0.20, "prior": 0.12, "popularity": 0.08, "label": 0.12, "surface": 0.10, "anchor": 0.06, "context": 0.08, "source": 0.06,
    }
    total = sum((F.coalesce(f[k], F.lit(0.0)) * w for k, w in weights.items() if k in f), F.lit(0.0))
    return clamped(total - (F.when(f["generated"], 0.04).otherwise(0.0) if "generated" in f else 0.0))


def context_bonus(count: Column, step: float) -> Column:
    """A step for each time that something stands in the document, 1 at most."""
    return F.least(F.lit(1.0), F.coalesce(count, F.lit(0)) * step)


def authority_score(source: Column, status: Column, preferred: Column, popularity: Column, identifier: Column, label: Column, form_penalty: Column) -> Column:
    """Seven weighted features of an alias, 0 to 1, 4 places."""
    return clamped(source * 0.24 + status * 0.12 + preferred * 0.16 + popularity * 0.14 + identifier * 0.16 + label * 0.18 - form_penalty * 0.18)


def artifact_reasons(name: Column, kind: Column, most_words: int = 12) -> Column:
    """Why a name should not be shown: markup, an address, only signs, too many words, cut off, or no kind."""
    return F.array_compact(F.array(
        F.when(name.rlike(r"<[a-zA-Z/]|&[a-z]+;"), "markup"), F.when(name.rlike(r"https?://|@\S+\.\S"), "address"), F.when(~name.rlike(r"[\p{L}\p{N}]"), "no_letters"),
        F.when(F.size(F.split(F.trim(name), " +")) > most_words, "too_long"), F.when(name.rlike(r"(…|\.\.\.)\s*$"), "cut_off"), F.when(F.coalesce(kind, F.lit("")) == "", "no_kind"),
    ))
