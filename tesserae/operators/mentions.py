"""Mentions of one or many documents: rules, dedupe, merge, overlaps, relevance, topics and metrics."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as T


def rule_mentions(docs: DataFrame, rules: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, surface, n): matches of each label's pattern. All rules read the text once."""
    found = F.array(*(F.struct(F.lit(label).alias("label"), F.regexp_extract_all(text_col, F.lit(f"({p})"), F.lit(1)).alias("hits")) for label, p in rules.items()))
    each = docs.select(id_col, F.explode(found).alias("r")).select(id_col, F.col("r.label").alias("label"), F.explode("r.hits").alias("surface"))
    return each.groupBy(id_col, "label", "surface").agg(F.count(F.lit(1)).alias("n"))


def dedupe(mentions: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """One mention a key: the largest score, then the least ties (of any type); a min of structs, combined before the shuffle."""
    rest = [c for c in mentions.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(-F.col(score), *ties))
    return mentions.groupBy(*keys).agg(best.alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))


def merge_by_entity(mentions: DataFrame, doc: str, entity: str) -> DataFrame:
    """(doc, entity, mention_count, first_start, surfaces): a document's mentions of one entity as one row."""
    return mentions.groupBy(doc, entity).agg(
        F.count(F.lit(1)).alias("mention_count"), F.min("start").alias("first_start"), F.array_join(F.array_sort(F.collect_set("surface")), "|").alias("surfaces")
    )


def consistent_surfaces(mentions: DataFrame, doc: str, surface: str, entity: str, score: str) -> DataFrame:
    """Every mention of a surface in a document takes the entity of the surface's best mention (then the least entity)."""
    best = mentions.groupBy(doc, surface).agg(F.min_by(F.col(entity), F.struct(-F.col(score), F.col(entity))).alias("chosen"))
    return mentions.join(best, [doc, surface])


def relevance(merged: DataFrame, doc: str, tokens: DataFrame) -> DataFrame:
    """Score of an entity in a document: frequency, how early it stands, to 4 places; tokens has (doc, n_tokens)."""
    r = merged.join(tokens, doc)
    early = 1 - F.col("first_start") / F.greatest("n_tokens", F.lit(1))
    return r.withColumn("relevance", F.round(F.least(F.lit(1.0), 0.4 + 0.1 * F.least("mention_count", F.lit(4)) + 0.2 * early), 4))


def resolve_overlaps(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document the set of spans (start, end, score) without overlap of the largest total score, by interval DP.

    Ties prefer including the later span. A document's spans are bounded by its own text, so one group is one text.
    """
    schema = mentions.schema

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["end", "start", "score"], ascending=[True, True, True], kind="stable").reset_index(drop=True)
        ends = rows["end"].tolist()
        before = [bisect_right(ends, s, 0, i) for i, s in enumerate(rows["start"])]
        total = [0.0]
        for i, s in enumerate(rows["score"]):
            total.append(max(total[i], s + total[before[i]]))
        chosen, i = [], len(rows)
        while i:
            if rows["score"][i - 1] + total[before[i - 1]] >= total[i - 1]:
                chosen.append(i - 1)
                i = before[i - 1]
            else:
                i -= 1
        return rows.iloc[chosen[::-1]]

    return mentions.groupBy(doc).applyInPandas(best, schema)


def metrics(docs: DataFrame, mentions: DataFrame, doc: str = "doc_id", text_col: str = "text", low_density: float = 0.5, least_tokens: int = 100) -> DataFrame:
    """(doc, token_count, entity_count, per_100_tokens, low_density) with documents that have no mention."""
    counts = mentions.groupBy(doc).agg(F.count(F.lit(1)).alias("entity_count"))
    base = docs.select(doc, T.token_count(F.col(text_col)).cast("long").alias("token_count")).join(counts, doc, "left")
    n = F.coalesce("entity_count", F.lit(0)).cast("long")
    rate = F.round(100.0 * n / F.greatest("token_count", F.lit(1)), 4)
    return base.select(doc, "token_count", n.alias("entity_count"), rate.alias("per_100_tokens"), ((F.col("token_count") >= least_tokens) & (rate < low_density)).alias("low_density"))


def topics(mentions: DataFrame, domain: str) -> DataFrame:
    """(domain, label, mentions, docs): topic evidence by domain and label."""
    return mentions.groupBy(domain, "label").agg(F.sum("n").alias("mentions"), F.countDistinct("doc_id").alias("docs"))


def topic_scores(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, score): mean weight times .8 and .08 a mention up to .2, at most 1, to 4 places."""
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.round(F.least(F.lit(1.0), F.sum(weight) / n * 0.8 + F.least(F.lit(0.2), 0.08 * n)), 4).alias("score"))
