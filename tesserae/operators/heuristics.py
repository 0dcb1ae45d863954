"""Candidates that no dictionary holds: defined acronyms, structured names, names before a hyphen, and what was missed.

All read a text once, and only candidates leave it. Word lists are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CONNECTORS = ("of", "the", "and", "for", "de", "la")


def acronym_definitions(docs: DataFrame, id_col: str, text: Column, connectors: tuple[str, ...] = CONNECTORS) -> DataFrame:
    """(id, acronym, long_form, n_later): acronyms in parentheses that the initials of the words before spell.

    The long form is the fewest words that spell it; connectors add no initial. n_later counts the acronym as a word
    after its definition. A document that defines one acronym in two ways has none; the first of equal definitions counts.
    """
    found = F.regexp_extract_all(text, F.lit(r"((?:\p{L}+ ){2,10}\(\p{Lu}{2,8}\))"), F.lit(1))
    each = docs.select(id_col, text.alias("__text"), F.explode(F.array_distinct(found)).alias("__def"))
    each = each.withColumn("acronym", F.regexp_extract("__def", r"\((\p{Lu}+)\)$", 1))
    each = each.withColumn("__words", F.split(F.rtrim(F.regexp_replace("__def", r"\(\p{Lu}+\)$", "")), " "))

    def tail(k: Column) -> Column:
        return F.slice("__words", F.size("__words") - k + 1, k)

    def spells(k: Column) -> Column:
        named = F.filter(tail(k), lambda w: ~F.lower(w).isin(*connectors))
        letters = F.array_join(F.transform(named, lambda w: F.upper(F.substring(w, 1, 1))), "")
        return (letters == F.col("acronym")) & ~F.lower(tail(k)[0]).isin(*connectors)

    fewest = F.array_min(F.filter(F.sequence(F.lit(1), F.size("__words")), spells))
    each = each.withColumn("__k", fewest).where("__k is not null")
    end = F.position(F.col("__def"), F.col("__text")) + F.length("__def")
    later = F.split(F.substr("__text", end), r"[^\p{L}\p{N}]+")
    rows = each.select(
        id_col, "acronym", F.array_join(tail(F.col("__k")), " ").alias("long_form"), F.size(F.filter(later, lambda w: w == F.col("acronym"))).cast("long").alias("n_later")
    )
    one = rows.groupBy(id_col, "acronym").agg(F.countDistinct("long_form").alias("__n"), F.min("long_form").alias("long_form"), F.max("n_later").alias("n_later"))
    return one.where("__n = 1").drop("__n")


def structured_names(docs: DataFrame, id_col: str, text: Column, heads: tuple[str, ...], most: int = 3) -> DataFrame:
    """(id, key, surface, start): runs of up to ``most`` capitalised words before a head word, the first of each key.

    Offsets of matches need an Arrow function: built-in expressions give matched texts but not where they stand.
    """
    pattern = rf"(?:\p{{Lu}}\p{{L}}+ ){{1,{most}}}(?:{'|'.join(heads)})(?=[^\p{{L}}]|$)"

    @F.pandas_udf("array<struct<surface: string, start: long>>")
    def found(texts):
        import regex

        unit = regex.compile(pattern)
        return texts.map(lambda t: [{"surface": m.group(), "start": m.start()} for m in unit.finditer(t or "")])

    each = docs.select(id_col, F.explode(found(text)).alias("m")).select(id_col, F.lower("m.surface").alias("key"), "m.*")
    return each.groupBy(id_col, "key").agg(F.min_by("surface", "start").alias("surface"), F.min("start").alias("start"))


def hyphen_prefixes(docs: DataFrame, id_col: str, text: Column, aliases: DataFrame) -> DataFrame:
    """(id, key, alias columns): aliases (key, ...) that stand capitalised before a hyphen and a lower-case word."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{Lu}\p{L}+)-\p{Ll}+"), F.lit(1)))
    return docs.select(id_col, F.explode(found).alias("__p")).select(id_col, F.lower("__p").alias("key")).join(aliases, "key")


def missed_acronyms(docs: DataFrame, id_col: str, text: Column, known: DataFrame) -> DataFrame:
    """(id, acronym, n): upper-case words of two to six letters that are no known (id, acronym)."""
    found = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}{2,6}$")))
    counts = docs.select(id_col, F.explode(found).alias("acronym")).groupBy(id_col, "acronym").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known.select(id_col, "acronym"), [id_col, "acronym"], "left_anti")


def covered(mentions: DataFrame, doc: str) -> DataFrame:
    """The mentions (start, end) with ``covered``: a longer mention of the document holds the span. One sort, no self-join."""
    same_start = W.partitionBy(doc, "start")
    before = F.max("end").over(W.partitionBy(doc).orderBy("start").rangeBetween(W.unboundedPreceding, -1))
    return mentions.withColumn("covered", (F.max("end").over(same_start) > F.col("end")) | (F.coalesce(before, F.lit(-1)) >= F.col("end")))


def mention_issues(mentions: DataFrame, doc: str, generic: tuple[str, ...]) -> DataFrame:
    """(doc, surface, issue): generic single words, and mentions that are part of a longer mention."""
    marked = covered(mentions, doc)
    issues = F.array_compact(F.array(F.when(F.lower("surface").isin(*generic), F.lit("generic_token")), F.when(F.col("covered"), F.lit("name_fragment"))))
    return marked.select(doc, "surface", F.explode(issues).alias("issue")).distinct()
