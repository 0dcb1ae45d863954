"""Connected components by alternating large-star and small-star steps, each written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import join_groups, stored


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One step over links (a, b), a > b: every node's neighbours (larger or smaller ones) move to its least neighbour.

    A hub's links never meet in one task: its minimum is a pre-aggregated value, and ``join_groups`` brings it back.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = stored(both, "star")
    least = both.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("degree"))
    least = stored(least.select("u", F.least("u", "least").alias("m"), "degree"), "least")
    seen = join_groups(both, least, "u", "degree", both.count())
    if small:  # all smaller neighbours and the node itself
        moved = seen.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:  # larger neighbours
        moved = seen.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return stored(moved.where("a > b").distinct(), "links")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of its component. Roots are left out."""
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = _state(links)
    while state[0]:
        links = _star(_star(links, False), True)
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
