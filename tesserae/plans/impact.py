"""Compositions: a market graph from the tables, and article analysis (mentions, event signals, expansion)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import dictionary, events, graph


def market_edges(nation: DataFrame, customer: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence): regions to nations, nations to the segments of their customers."""
    down = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("contains").alias("relation"), F.lit(0.9).alias("confidence"))
    trade = customer.groupBy("c_nationkey", "c_mktsegment").agg((0.5 + 0.01 * (F.count(F.lit(1)) % 40)).alias("confidence"))
    return down.unionByName(trade.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("m"), "c_mktsegment").alias("dst"), F.lit("trades").alias("relation"), "confidence"))


def customer_edges(nation: DataFrame, customer: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence): regions to nations, nations to their customers, customers to their segment."""
    key = F.concat(F.lit("c"), "c_custkey")
    down = market_edges(nation, customer).where("relation = 'contains'")
    serves = customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), key.alias("dst"), F.lit("serves").alias("relation"), (0.5 + 0.01 * (F.col("c_custkey") % 40)).alias("confidence"))
    buys = customer.select(key.alias("src"), F.concat(F.lit("m"), "c_mktsegment").alias("dst"), F.lit("buys").alias("relation"), F.lit(0.8).alias("confidence"))
    return down.unionByName(serves).unionByName(buys)


def analyze(docs: DataFrame, aliases: DataFrame, edges: DataFrame, signals: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, node, signals, confidence): for documents with a mention and a signal, what their entity's seed reaches.

    A mentioned item stands for the region of its number modulo five; expansion runs once over the distinct seeds, not
    once a document, and joins back.
    """
    found = dictionary.tag_exact(docs, aliases, sizes=[5]).select("doc_id", F.concat(F.lit("r"), F.col("item_id") % 5).alias("seed")).distinct()
    signal = events.first_signals(docs, signals, "doc_id", "text").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))
    seeds = found.select(F.col("seed").alias("node")).distinct()
    reached = graph.expand_paths(edges, seeds).select("seed", "node", "confidence")
    return found.join(signal, "doc_id").join(reached, "seed").groupBy("doc_id", "node", "signals").agg(F.max("confidence").alias("confidence"))
