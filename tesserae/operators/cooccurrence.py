"""Co-occurrence of entities in dated documents over trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_pairs(records: DataFrame, as_of: str, windows: dict[str, int]) -> DataFrame:
    """(window, left, right, weight): documents (doc, entity, ts) that hold both entities, for each window of days up to as_of.

    Pairs are built inside a document from its distinct entities (a document's list is bounded by the document), once,
    and counted for all windows by conditional sums; nothing is joined.
    """
    t = F.lit(as_of).cast("timestamp")
    widest = max(windows.values())
    recent = records.where((F.col("ts") <= t) & (F.col("ts") > t - F.expr(f"INTERVAL {widest} DAYS")))
    docs = recent.groupBy("doc").agg(F.array_sort(F.collect_set("entity")).alias("e"), F.max("ts").alias("ts")).where(F.size("e") > 1)
    lefts = docs.select("ts", "e", F.posexplode("e").alias("i", "left"))
    pairs = lefts.select("ts", "left", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("right"))
    counts = pairs.groupBy("left", "right").agg(*(F.count_if(F.col("ts") > t - F.expr(f"INTERVAL {d} DAYS")).alias(n) for n, d in windows.items()))
    long = counts.select("left", "right", F.explode(F.array(*(F.struct(F.lit(n).alias("window"), F.col(n).alias("weight")) for n in windows))).alias("w"))
    return long.select(F.col("w.window").alias("window"), "left", "right", F.col("w.weight").alias("weight")).where("weight > 0")


def supports(pairs: DataFrame, seeds: DataFrame, window: str) -> DataFrame:
    """(entity, seed_count, weight): how the seeds (entity) support others by co-occurrence in a window."""
    both = pairs.where(F.col("window") == window)
    both = both.select("left", "right", "weight").unionByName(both.select(F.col("right").alias("left"), F.col("left").alias("right"), "weight"))
    hit = both.join(seeds.select(F.col("entity").alias("left")), "left", "left_semi")
    return hit.groupBy(F.col("right").alias("entity")).agg(F.countDistinct("left").alias("seed_count"), F.sum("weight").alias("weight"))


def record_weight(value: Column, time: Column, as_of: str, scale: float) -> Column:
    """A record's weight of 1 to 5: value over scale, times 1.45 in the last day and 1.2 in the last week before ``as_of``."""
    now = F.lit(as_of).cast("timestamp")
    recency = F.when(time > now - F.expr("INTERVAL 1 DAY"), 1.45).when(time > now - F.expr("INTERVAL 7 DAYS"), 1.2).otherwise(1.0)
    return F.greatest(F.lit(1), F.least(F.lit(5), F.round(value * recency / scale))).cast("int")
