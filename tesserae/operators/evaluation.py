"""Quality evaluation, differences between versions, merges and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def precision_recall(rows: DataFrame, by: str, predicted: Column, actual: Column) -> DataFrame:
    """(by, tp, fp, fn, precision, recall) with empty classes as 1.0."""
    g = rows.groupBy(by).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    share = lambda miss: F.round(F.when(F.col("tp") + F.col(miss) > 0, F.col("tp") / (F.col("tp") + F.col(miss))).otherwise(1.0), 6)
    return g.select("*", share("fp").alias("precision"), share("fn").alias("recall"))


def health(observations: DataFrame, key: str, time: str, value: str, last: int) -> DataFrame:
    """(key, n, mean, p95) of the latest ``last`` observations of each key; p95 interpolates between ranks, ends included."""
    w = W.partitionBy(key).orderBy(F.desc(time), F.desc("event_id"))
    recent = observations.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    g = recent.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.95), 6).alias("p95"))
    return g


def diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged, by one full outer join on the key."""
    a, b = old.select(key, F.col(content).alias("o"), F.lit(1).alias("in_old")), new.select(key, F.col(content).alias("n"), F.lit(1).alias("in_new"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("changed")
    return j.select(key, change.alias("change"))


def upsert(base: DataFrame, delta: DataFrame, key: str, deleted: str) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those of the same key, and without keys that delta marks deleted."""
    columns = base.columns
    stays = base.join(delta.select(key), key, "left_anti").select(columns)
    return stays.unionByName(delta.where(~F.col(deleted)).select(columns))


def merge_seeds(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, score, sources): the larger score of two scored lists (key, score), and in how many the key is."""
    j = left.select(key, F.col("score").alias("a")).join(right.select(key, F.col("score").alias("b")), key, "full_outer")
    return j.select(key, F.greatest("a", "b").alias("score"), (F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")).alias("sources"))


def dependency_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """(determinant, n_values): where one value of a determinant has several dependents."""
    return df.groupBy(determinant).agg(F.countDistinct(dependent).alias("n_values")).where("n_values > 1")


def by_priority(df: DataFrame, key: str, kind: str, priority: list[str]) -> DataFrame:
    """(key, kind): of each key the kind that stands first in ``priority`` (others last, by name)."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col(kind)), F.lit(0)), F.lit(len(priority) + 1))
    return df.groupBy(key).agg(F.min_by(kind, F.struct(place, F.col(kind))).alias(kind))


def prefix_limits(files: DataFrame, order: str, size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """The rows with ``status``: files are taken in order (unique) until a count or byte limit trips; all later ones are skipped.

    Only the first max_rows rows in order are summed up, found by a distributed top-k; where a limit trips is one row,
    which all others are compared with. So no task sees more than max_rows rows.
    """
    first = files.orderBy(order).limit(max_rows)
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ran = first.select(order, F.sum(size).over(w).alias("total"))
    trips = ran.agg(
        F.max(order).alias("__last"), F.count(F.lit(1)).alias("__n"), F.min(F.when(F.col("total") > max_bytes, F.col(order))).alias("__bytes")
    )
    status = (
        F.when((F.col("__n") == max_rows) & (F.col(order) > F.col("__last")), "max_files")
        .when(F.col(order) >= F.col("__bytes"), "max_bytes").otherwise("taken")
    )
    return files.crossJoin(F.broadcast(trips)).withColumn("status", status).drop("__last", "__n", "__bytes")


def routed(rows: DataFrame, routes: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """The rows with the ``route`` of a sink: the first condition that holds."""
    cascade = F.lit(otherwise)
    for name, condition in reversed(routes):
        cascade = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(cascade)
    return rows.withColumn("route", cascade)


def running_maximum(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """Each row with ``before``: the largest value of its key's earlier rows."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("before", F.max(value).over(w))


def match_counts(expected: DataFrame, actual: DataFrame, group: str, item: str) -> DataFrame:
    """(group, matched, missing, unexpected) of two sets of (group, item), repeats counted once; one shuffle."""
    both = expected.select(group, item, F.lit(1).alias("e")).unionByName(actual.select(group, item, F.lit(2).alias("e")))
    sides = both.groupBy(group, item).agg(F.bit_or("e").alias("e"))
    return sides.groupBy(group).agg(F.count_if(F.col("e") == 3).alias("matched"), F.count_if(F.col("e") == 1).alias("missing"), F.count_if(F.col("e") == 2).alias("unexpected"))


def deltas(base: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, delta): new less base, to 6 places; a key absent on one side counts as 1.0 there."""
    j = base.select(key, F.col(value).alias("o")).join(new.select(key, F.col(value).alias("n")), key, "full_outer")
    return j.select(key, F.round(F.coalesce("n", F.lit(1.0)) - F.coalesce("o", F.lit(1.0)), 6).alias("delta"))
