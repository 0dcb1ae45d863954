"""Entities by their keys: identity references, keys of one owner, cascades over kinds of key, merges and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def padded_digits(text: Column, width: int = 10) -> Column:
    """Only the digits, zero-padded; null without a digit."""
    digits = F.regexp_replace(text, "[^0-9]+", "")
    return F.when(digits != "", F.lpad(digits, width, "0"))


def identity_refs(rows: DataFrame, id_col: str, kinds: dict[str, Column]) -> DataFrame:
    """(id, kind, key): every key that a row has, as rows; absent ones are left out."""
    keys = F.array(*(F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key")) for kind, c in kinds.items()))
    return rows.select(id_col, F.explode(F.filter(keys, lambda k: k["key"].isNotNull() & (k["key"] != ""))).alias("k")).select(id_col, "k.*")


def unambiguous(refs: DataFrame, id_col: str) -> DataFrame:
    """(kind, key, id) of the keys that exactly one entity has; least and largest id are combined before the shuffle."""
    g = refs.groupBy("kind", "key").agg(F.min(id_col).alias(id_col), F.max(id_col).alias("__max"))
    return g.where(F.col(id_col) == F.col("__max")).drop("__max")


def resolve(refs: DataFrame, ref_col: str, index: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """(ref, id, kind): the entity that a reference's first matching kind of key leads to."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    hit = refs.join(index, ["kind", "key"]).where(place > 0)
    return hit.groupBy(ref_col).agg(F.min_by(F.struct(id_col, "kind"), F.struct(place, F.col(id_col))).alias("m")).select(ref_col, "m.*")


def short_aliases(aliases: DataFrame, key: str, entity: str, most: int = 3) -> DataFrame:
    """(key, entity, score): the best row of a key and entity; single-word keys of more than ``most`` entities are dropped."""
    one = aliases.groupBy(key, entity).agg(F.max("score").alias("score"))
    many = one.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > most) & ~F.contains(key, F.lit(" "))).select(key)
    return one.join(many, key, "left_anti")


def merge_candidates(rows: DataFrame, key: str) -> DataFrame:
    """(key, confidence, evidence, sources, mentions) of rows (confidence, evidence, source): direct evidence wins."""
    rank = F.when(F.col("evidence") == "direct", 0).when(F.col("evidence") == "shallow", 1).otherwise(2)
    return rows.groupBy(key).agg(
        F.max("confidence").alias("confidence"), F.min_by("evidence", F.struct(rank, F.col("evidence"))).alias("evidence"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("mentions"),
    )


def edge_confidence(confidence: Column, evidence: Column, official: Column) -> Column:
    """Confidence by evidence (direct 1, shallow .92, inferred .78, else .75) and source (official 1, else .94), 6 places."""
    by = F.when(evidence == "direct", 1.0).when(evidence == "shallow", 0.92).when(evidence == "inferred", 0.78).otherwise(0.75)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence * by * F.when(official, 1.0).otherwise(0.94))), 6)


def degree_specificity(degree: Column) -> Column:
    """1, .82, .58, .32 or .12 by degrees up to 4, 16, 64, 256 and beyond."""
    return F.when(degree <= 4, 1.0).when(degree <= 16, 0.82).when(degree <= 64, 0.58).when(degree <= 256, 0.32).otherwise(0.12)


def degree_penalty(degree: Column) -> Column:
    """0, .04, .08, .12 or .18 by degrees up to 16, 48, 128, 256 and beyond."""
    return F.when(degree <= 16, 0.0).when(degree <= 48, 0.04).when(degree <= 128, 0.08).when(degree <= 256, 0.12).otherwise(0.18)


def validation_codes(codes: dict[str, Column]) -> Column:
    """Array of the codes whose condition holds (null as false), in the order given."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in codes.items())))


def code_counts(rows: DataFrame, codes: dict[str, Column]) -> DataFrame:
    """(code, n) over all rows; rows without a code count as 'valid'."""
    found = validation_codes(codes)
    each = rows.select(F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("valid")))).alias("code"))
    return each.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def freshness(as_of: Column, end: Column, snapshot: Column, max_days: int) -> Column:
    """'expired', 'too_old' (no end and an old snapshot), 'no_date' or 'fresh'."""
    return (
        F.when(end < as_of, "expired").when(end.isNotNull(), "fresh").when(snapshot.isNull(), "no_date")
        .when(F.date_diff(as_of, snapshot) > max_days, "too_old").otherwise("fresh")
    )


def claimed_by_roots(closure: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): the root of least priority among a node's ancestors; roots are (root, priority)."""
    hit = closure.join(roots, closure["ancestor"] == roots["root"])
    return hit.groupBy("node").agg(F.min_by("root", F.struct("priority", "root")).alias("root"))


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, run, value, n): runs of adjacent rows of equal value within a key, in order."""
    w = W.partitionBy(key).orderBy(*order)
    begins = rows.withColumn("__new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = begins.withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n"))


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank; Spark limits each group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def forbidden(left: Column, right: Column, pairs: list[tuple[str, str]]) -> Column:
    """'forbidden_pair' where (left, right) is among ``pairs``, else 'ok'; a null side is no pair."""
    hit = F.lit(False)
    for a, b in pairs:
        hit = hit | (left.eqNullSafe(a) & right.eqNullSafe(b))
    return F.when(hit, "forbidden_pair").otherwise("ok")
