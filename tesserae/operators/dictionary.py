"""Dictionaries: alias tables from entities, cluster decisions, exact tagging, and alias search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesserae.functions import text as T


#: Words of the longest alias that is looked for, and first words that are compared as a text is read.
LONGEST = 8
FEW_STARTS = 5000


def token_windows(docs: DataFrame, id_col: str, tokens: Column, sizes: list[int]) -> DataFrame:
    """(id, start, n, surface): every window of n tokens, for each n of ``sizes``. One explode, no shuffle."""
    at = docs.select(F.col(id_col), tokens.alias("tokens"))
    n = F.explode(F.array(*map(F.lit, sizes))).alias("n")
    each = at.select(id_col, "tokens", n).where(F.size("tokens") >= F.col("n"))
    each = each.select(id_col, "tokens", "n", F.explode(F.sequence(F.lit(1), F.size("tokens") - F.col("n") + 1)).alias("start"))
    return each.select(id_col, (F.col("start") - 1).alias("start"), "n", F.array_join(F.slice("tokens", F.col("start"), F.col("n")), " ").alias("surface"))


def tag_exact(docs: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: list[int] | None = None) -> DataFrame:
    """Mentions (id, start, n, surface, alias columns) of aliases (surface, ...) in texts, as windows of whole words.

    Lengths of aliases are those in ``sizes`` (all up to ``LONGEST`` words, if not told otherwise; longer aliases never
    match). A word of a text goes on only if an alias starts with it: the first words are compared while the text is read
    where they are few (counted, at most ``FEW_STARTS``), else by a join with the table of first words, which Spark
    broadcasts only where its size allows. What goes on is the place and the next words, and only the lengths that aliases
    with that first word have become windows for the join by surface. So what is shuffled follows the hits.
    """
    words = F.split("surface", " ")
    sizes = sorted(set(sizes or range(1, LONGEST + 1)))
    named = aliases.where(F.size(words).isin(sizes))
    starts = named.groupBy(F.element_at(words, 1).alias("first")).agg(F.sort_array(F.collect_set(F.size(words))).alias("sizes"))
    few = [r["first"] for r in starts.select("first").limit(FEW_STARTS + 1).collect()]
    tokens = docs.select(F.col(id_col), T.words(F.col(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    places = F.sequence(F.lit(1), F.size("tokens"))
    if len(few) <= FEW_STARTS:
        places = F.filter(places, lambda i: F.get("tokens", i - 1).isin(few)) if few else F.array().cast("array<int>")
    ahead = F.transform(places, lambda i: F.struct(i.alias("at"), F.slice("tokens", i, F.lit(sizes[-1])).alias("next")))
    found = tokens.select(id_col, F.explode(ahead).alias("x")).select(id_col, "x.at", "x.next", F.get("x.next", F.lit(0)).alias("first"))
    found = found.join(starts, "first").select(id_col, "at", "next", F.explode("sizes").alias("n")).where(F.size("next") >= F.col("n"))
    windows = found.select(id_col, (F.col("at") - 1).alias("start"), "n", F.array_join(F.slice("next", F.lit(1), F.col("n")), " ").alias("surface"))
    return windows.join(named, "surface")


def with_offsets(mentions: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mentions (id, start and n in words, ...) with raw_start and raw_end, the span's characters in the text.

    Only texts with a mention are cut, into words and what is between them; a place is the length of all that is before.
    """
    rows = [c for c in mentions.columns if c != id_col]
    own = mentions.groupBy(id_col).agg(F.collect_list(F.struct(*rows)).alias("m"))
    parts = F.regexp_extract_all(F.col(text_col), F.lit(r"([\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+)"), F.lit(1))
    cut = own.join(docs.select(id_col, text_col), id_col).select(id_col, "m", parts.alias("parts"))
    lead = F.when(F.get("parts", F.lit(0)).rlike(r"^[\p{L}\p{M}\p{N}]"), 0).otherwise(1)
    # the first part of a word w (from 0) is number lead + 2 w
    length = lambda n: F.aggregate(F.slice("parts", F.lit(1), n), F.lit(0), lambda a, p: a + F.length(p))
    each = cut.select(id_col, "parts", lead.alias("lead"), F.explode("m").alias("m"))
    first = F.col("lead") + 2 * F.col("m.start")
    return each.select(
        id_col, *(F.col(f"m.{c}").alias(c) for c in rows), length(first.cast("int")).alias("raw_start"), length((first + 2 * F.col("m.n") - 1).cast("int")).alias("raw_end")
    )


def leftmost_longest(mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mentions that no longer one covers (start, n in words), in the order start, -n: of one place the longest, and none
    inside another. The largest end of a text's earlier mentions is a running value, so one sort a text is all."""
    end = F.col("start") + F.col("n")
    w = W.partitionBy(id_col).orderBy("start", F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    longest = mentions.groupBy(id_col, "start").agg(F.max("n").alias("n"))
    covered = longest.withColumn("reach", F.max(end).over(w)).where(F.col("reach").isNull() | (F.col("reach") < end)).drop("reach")
    return mentions.join(covered, [id_col, "start", "n"], "left_semi")


def best_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order`` (give a total order), by pre-aggregated max of structs where possible."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def resolve_clusters(candidates: DataFrame, margin: float = 0.05, retain: int = 3) -> DataFrame:
    """(alias_key, label_count, top_score, runner_up_score, ambiguous, retained_labels) of candidates (alias_key, label, score).

    Labels of an alias compete by their best score: a clear winner stays alone, close ones are ambiguous and stay together.
    """
    per_label = candidates.groupBy("alias_key", "label").agg(F.max("score").alias("score"))
    ranked = per_label.withColumn("rank", F.row_number().over(W.partitionBy("alias_key").orderBy(F.desc("score"), "label")))
    top = ranked.groupBy("alias_key").agg(
        F.count(F.lit(1)).alias("label_count"),
        F.max("score").alias("top_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("runner_up_score"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= retain, F.struct("rank", "label", "score")))).alias("best"),
    )
    ambiguous = F.col("runner_up_score").isNotNull() & (F.col("top_score") - F.col("runner_up_score") < margin)
    close = F.transform(F.filter("best", lambda b: F.col("top_score") - b["score"] < margin), lambda b: b["label"])
    return top.select("alias_key", "label_count", "top_score", "runner_up_score", ambiguous.alias("ambiguous"), F.array_join(close, ",").alias("retained_labels"))


def lookup_exact(aliases: DataFrame, queries: DataFrame) -> DataFrame:
    """Aliases (name, ...) whose lower-cased name equals a query (q), all of them."""
    return aliases.join(queries, F.lower("name") == F.lower("q"))


def lookup_like(aliases: DataFrame, needle: str, columns: list[str], limit: int, ties: list[str]) -> DataFrame:
    """Top rows with the needle in any column: equal before prefix before contained, then by name."""
    low = [F.lower(c) for c in columns]
    n = needle.lower()
    hit = F.greatest(*(F.when(c == n, 3).when(F.startswith(c, F.lit(n)), 2).when(F.contains(c, F.lit(n)), 1).otherwise(0) for c in low)) if len(low) > 1 else F.when(low[0] == n, 3).when(F.startswith(low[0], F.lit(n)), 2).when(F.contains(low[0], F.lit(n)), 1).otherwise(0)
    return aliases.withColumn("rank", hit).where("rank > 0").orderBy(F.desc("rank"), *columns, *ties).limit(limit)


def terms_of(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, length): the inverted index rows of a text column."""
    t = df.select(F.col(id_col), T.words(text).alias("w"))
    return t.select(id_col, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy(id_col, "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def lookup_prefix_and(index: DataFrame, id_col: str, prefixes: list[str]) -> DataFrame:
    """Ids with, for every prefix, a term that starts with it."""
    hits = index.select(id_col, F.explode(F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("term"), p))).alias("p"))
    return hits.groupBy(id_col).agg(F.countDistinct("p").alias("n")).where(F.col("n") == len(set(prefixes))).select(id_col)


def bm25(docs: DataFrame, id_col: str, text: Column, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): Okapi BM25 of the texts that hold a query term.

    A text becomes its length and one count a term as it is read; nothing but one row of totals (documents, mean length,
    documents of each term) is gathered, so no shuffle follows the corpus. id_col is unique.
    """
    terms = sorted(set(query))
    count = lambda q: (F.size("w") - F.size(F.array_remove("w", q)))

    def counts(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col), T.words(text).alias("w")).where(F.size("w") > 0)
        return rows.select(id_col, F.size("w").alias("length"), *(count(q).alias(f"tf{i}") for i, q in enumerate(terms)))

    counted = counts(docs)
    totals = counted.agg(
        F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        score = score + F.when(F.col(f"tf{i}") > 0, idf * tf).otherwise(0.0)
    # a text without the term's letters has no such word and is not cut into words again
    hit = counts(docs.where(F.greatest(*(F.contains(F.lower(text), F.lit(q)) for q in terms), F.lit(False))))
    hit = hit.where(F.greatest(*(F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0)
    return hit.crossJoin(F.broadcast(totals)).select(id_col, score.alias("score"))


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def lookup_trigram(aliases: DataFrame, id_col: str, name: str, query: str, least: float = 0.2) -> DataFrame:
    """(id, name, similarity): names whose trigram Jaccard with the query reaches ``least``; one scan, no join."""
    q = aliases.select(id_col, name, trigrams(F.col(name)).alias("t"), trigrams(F.lit(query)).alias("q"))
    s = F.size(F.array_intersect("t", "q")) / F.size(F.array_union("t", "q"))
    return q.select(id_col, name, F.round(s, 4).alias("similarity")).where(F.col("similarity") >= least)


def without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not among the others; only distinct keys of the others are shuffled."""
    return rows.join(others.select(*keys).distinct(), keys, "left_anti")
