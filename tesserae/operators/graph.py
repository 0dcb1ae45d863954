"""Relationship graphs as edge tables: building, degrees, neighbours, hierarchy closure, paths and bounded expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def merge_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One edge a key: the largest confidence, the union of packs (column pack), the number of rows merged."""
    return edges.groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("pack")), ",").alias("packs"), F.count(F.lit(1)).alias("evidence")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree_total) of edges (src, dst); each side pre-aggregated before the shuffle."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree_total"))


def degree_summary(degrees: DataFrame) -> DataFrame:
    """One row (nodes, max_degree, mean_degree, p95_degree) of node degrees; the 95th percentile is the nearest rank."""
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY degree_total)").cast("long")
    mean = F.round(F.avg("degree_total"), 4)
    return degrees.agg(F.count(F.lit(1)).alias("nodes"), F.max("degree_total").alias("max_degree"), mean.alias("mean_degree"), p95.alias("p95_degree"))


def top_neighbors(edges: DataFrame, k: int) -> DataFrame:
    """The k strongest neighbours of each node: by weight, then id; ranked in Spark's windowed group limit."""
    w = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shared_neighbors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(dst, seed_count): nodes that two or more seeds (src) point to. The seeds are a stated query set."""
    hit = edges.join(seeds.select("src").distinct(), "src", "left_semi").select("src", "dst").distinct()
    return hit.groupBy("dst").agg(F.count(F.lit(1)).alias("seed_count")).where("seed_count >= 2")


def closure(parents: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, hops) up to ``depth`` of (child, parent) rows; the fewest hops where there are several ways."""
    step = parents.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    reached = last = step.withColumn("hops", F.lit(1))
    for h in range(2, depth + 1):
        up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        last = last.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(h).alias("hops")).distinct()
        reached = reached.unionByName(last)
    return reached.groupBy("node", "ancestor").agg(F.min("hops").alias("hops"))


def shared_ancestors(parents: DataFrame, left: DataFrame, right: DataFrame, depth: int) -> DataFrame:
    """(left, right, ancestor, hops): the common ancestors of stated pairs (left and right are id columns 'node')."""
    c = closure(parents, depth)
    a = left.join(c, "node").select(F.col("node").alias("left"), "ancestor", F.col("hops").alias("h1"))
    b = right.join(c, "node").select(F.col("node").alias("right"), "ancestor", F.col("hops").alias("h2"))
    return a.join(b, "ancestor").select("left", "right", "ancestor", (F.col("h1") + F.col("h2")).alias("hops"))


def shortest_paths(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, node, hops) by breadth-first levels from a stated source set; each level goes on only from new nodes."""
    step = edges.select("src", "dst").distinct()
    found = frontier = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"))
    for h in range(1, depth + 1):
        nxt = frontier.join(step, frontier["node"] == step["src"]).select("source", F.col("dst").alias("node"), F.lit(h).alias("hops")).distinct()
        frontier = nxt.join(found.select("source", "node"), ["source", "node"], "left_anti")
        found = found.unionByName(frontier)
    return found


def depth_decay(hops: int) -> float:
    """1 at the seed, .9 after one step, .75 after two, and half as much with every step from there."""
    return {0: 1.0, 1: 0.9}.get(hops, 0.75 * 0.5 ** max(hops - 2, 0))


def expand_paths(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_node: int = 64, top: int = 25) -> DataFrame:
    """(seed, node, hops, confidence, rank): acyclic expansion; a path's confidence is that of its seed (0 to 1; 1 where seeds
    has no column confidence, or null) times its weakest edge's times ``depth_decay`` of its hops. Edges carry their effective
    confidence (``resolution.edge_confidence``).

    Of each node only its ``per_node`` strongest edges are followed; of each seed the ``top`` best reached nodes stay.
    Both are the feature's own limits and have total orders. Nodes of a path are kept to reject cycles.
    """
    w = W.partitionBy("src").orderBy(F.desc("confidence"), "dst", "relation")
    strong = edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_node).select("src", "dst", F.col("confidence").alias("edge"))
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))) if "confidence" in seeds.columns else F.lit(1.0)
    paths = seeds.select(F.col("node").alias("seed"), F.col("node").alias("at"), F.array("node").alias("path"), F.lit(1.0).alias("weakest"), own.alias("own"))
    levels = []
    for h in range(1, depth + 1):
        paths = (
            paths.join(strong, paths["at"] == strong["src"]).where(~F.array_contains("path", F.col("dst")))
            .select("seed", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.least("weakest", "edge").alias("weakest"), "own")
        )
        levels.append(paths.select("seed", F.col("at").alias("node"), F.lit(h).alias("hops"), F.round(F.col("own") * F.col("weakest") * depth_decay(h), 6).alias("confidence")))
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    best = reached.groupBy("seed", "node").agg(F.max_by("hops", F.struct("confidence", -F.col("hops"))).alias("hops"), F.max("confidence").alias("confidence"))
    rank = F.row_number().over(W.partitionBy("seed").orderBy(F.desc("confidence"), "hops", "node"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top)


def best_paths(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_node: int = 64, most: int = 3) -> DataFrame:
    """(node, rank, hops, confidence, path): the ``most`` best distinct paths that reach a node from any seed.

    Fewer hops first, then the stronger weakest edge, then the edges (src, relation, dst) in order. Edges are limited and
    cycles rejected as in ``expand_paths``.
    """
    w = W.partitionBy("src").orderBy(F.desc("confidence"), "dst", "relation")
    strong = edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_node).select(F.struct("src", "relation", "dst").alias("step"), F.col("confidence").alias("edge"))
    none = F.array().cast("array<struct<src:string,relation:string,dst:string>>")
    paths = seeds.select(F.col("node").alias("at"), F.array("node").alias("seen"), none.alias("path"), F.lit(1.0).alias("confidence")).distinct()
    levels = []
    for h in range(1, depth + 1):
        paths = (
            paths.join(strong, paths["at"] == strong["step.src"]).where(~F.array_contains("seen", F.col("step.dst")))
            .select(F.col("step.dst").alias("at"), F.concat("seen", F.array("step.dst")).alias("seen"), F.concat("path", F.array("step")).alias("path"), F.least("confidence", "edge").alias("confidence"))
        )
        levels.append(paths.select(F.col("at").alias("node"), F.lit(h).alias("hops"), "confidence", "path"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    once = found.groupBy("node", "hops", "path").agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(W.partitionBy("node").orderBy("hops", F.desc("confidence"), "path"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("node", "rank", "hops", "confidence", "path")


def identity_bridge(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, node, shared): nodes (node, key) that share an identity key with a reference (ref, key)."""
    return refs.join(nodes, "key").groupBy("ref", "node").agg(F.countDistinct("key").alias("shared"))


def template_edges(nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """Every node of a kind with every target of the kind's template: an equi-join on the kind; templates are a constant table."""
    return nodes.join(F.broadcast(templates), "kind").select("node", "target", "relation", "confidence")


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge (src, dst) in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
