"""Golden sets over whole outputs, release gates and build reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.relations import codes


def share(part: Column, whole: Column, empty: float = 1.0) -> Column:
    """A share to 6 places; of nothing ``empty``."""
    return F.round(F.when(whole > 0, part / whole).otherwise(empty), 6)


def ranked_quality(found: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(cases, precision_at_k, recall_at_k, mrr, all_hit) of ranked answers (case, item, rank) against (case, item), over all cases
    that expect something; repeats of an expected item count once."""
    want = expected.select("case", "item").distinct()
    hits = found.where(F.col("rank") <= k).groupBy("case", "item").agg(F.min("rank").alias("rank"))
    both = want.withColumn("w", F.lit(1)).join(hits, ["case", "item"], "full_outer")
    each = both.groupBy("case").agg(
        F.count("w").alias("wanted"), F.count("rank").alias("given"), F.count_if(F.col("w").isNotNull() & F.col("rank").isNotNull()).alias("hit"),
        F.min(F.when(F.col("w") == 1, F.col("rank"))).alias("first"),
    ).where("wanted > 0")
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6)
    return each.agg(
        F.count(F.lit(1)).alias("cases"), share(F.sum("hit"), F.sum("given")).alias("precision_at_k"), share(F.sum("hit"), F.sum("wanted")).alias("recall_at_k"),
        mrr.alias("mrr"), F.count_if(F.col("hit") == F.col("wanted")).alias("all_hit"),
    )


def answer_rates(cases: DataFrame, found: DataFrame, expected: DataFrame) -> DataFrame:
    """(family, cases, useful_rate, empty_rate, unrelated_rate, recall, false_positives) of answers (case, item) to cases (case,
    family): useful with a wanted item, empty without any, unrelated with unwanted ones only."""
    f = found.select("case", "item").distinct().withColumn("f", F.lit(1))
    e = expected.select("case", "item").distinct().withColumn("e", F.lit(1))
    each = f.join(e, ["case", "item"], "full_outer").groupBy("case").agg(
        F.count("f").alias("found"), F.count("e").alias("wanted"), F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("hit")
    )
    rows = cases.join(each, "case", "left").fillna(0, ["found", "wanted", "hit"])
    n = F.count(F.lit(1))
    return rows.groupBy("family").agg(
        n.alias("cases"), share(F.count_if(F.col("hit") > 0), n).alias("useful_rate"), share(F.count_if(F.col("found") == 0), n).alias("empty_rate"),
        share(F.count_if((F.col("found") > 0) & (F.col("hit") == 0)), n).alias("unrelated_rate"), share(F.sum("hit"), F.sum("wanted")).alias("recall"),
        F.sum(F.col("found") - F.col("hit")).alias("false_positives"),
    )


def terminal_quality(found: DataFrame, expected: DataFrame, accepted: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(recall, precision, forbidden_hits) of terminals (case, item): accepted stand-ins (case, item, proxy) count for what they
    stand for, and are no false positives; forbidden ones (case, item) are counted."""
    f = found.select("case", "item").distinct()
    proxy = accepted.select("case", "item", F.col("proxy").alias("seen")).unionByName(expected.select("case", "item", F.col("item").alias("seen"))).distinct()
    allowed = proxy.join(expected.select("case", "item").distinct(), ["case", "item"], "left_semi")
    matched = allowed.join(f.withColumnRenamed("item", "seen"), ["case", "seen"], "left_semi")
    wanted = expected.select("case", "item").distinct().agg(F.count(F.lit(1)).alias("wanted"))
    hit = matched.select("case", "item").distinct().agg(F.count(F.lit(1)).alias("hit"))
    good = f.join(allowed.select("case", F.col("seen").alias("item")).distinct(), ["case", "item"], "left_semi").agg(F.count(F.lit(1)).alias("good"))
    total = f.agg(F.count(F.lit(1)).alias("given"))
    bad = f.join(forbidden.select("case", "item").distinct(), ["case", "item"], "left_semi").agg(F.count(F.lit(1)).alias("forbidden_hits"))
    row = wanted.crossJoin(hit).crossJoin(good).crossJoin(total).crossJoin(bad)  # five single rows
    return row.select(share(F.col("hit"), F.col("wanted")).alias("recall"), share(F.col("good"), F.col("given")).alias("precision"), "forbidden_hits")


def gate_reasons(least: dict[str, float], most: dict[str, float]) -> Column:
    """The gates that a report row fails: a column under its least value, over its most, or missing."""
    low = [(f"{c}_below_{v:g}", F.col(c).isNull() | (F.col(c) < v)) for c, v in least.items()]
    return codes(*low, *((f"{c}_above_{v:g}", F.col(c).isNull() | (F.col(c) > v)) for c, v in most.items()))


def build_report(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(label, entities, unique_canonicals, aliases, ambiguous, dropped_ratio) of a build: entities (id, label, canonical), aliases
    (id, alias, kept); an alias that several entities keep is ambiguous."""
    own = entities.groupBy("label").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct(F.lower("canonical")).alias("unique_canonicals"))
    spread = aliases.where("kept").groupBy("alias").agg(F.countDistinct("id").alias("owners"))
    rows = aliases.join(entities.select("id", "label"), "id").join(spread, "alias", "left")
    by = rows.groupBy("label").agg(
        F.count_if("kept").alias("aliases"), F.countDistinct(F.when(F.col("kept") & (F.col("owners") > 1), F.col("alias"))).alias("ambiguous"),
        share(F.count_if(~F.col("kept")), F.count(F.lit(1)), 0.0).alias("dropped_ratio"),
    )
    return own.join(by, "label", "left").fillna(0, ["aliases", "ambiguous"]).fillna(0.0, ["dropped_ratio"])


def latency_summary(runs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, runs, p50, p95, longest): percentiles interpolate between ranks, ends included."""
    p = lambda q: F.round(F.percentile(value, q), 6)
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max(value).alias("longest"))
