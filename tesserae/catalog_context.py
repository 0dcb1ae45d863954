"""Registered queries over graph context, the relation catalogue, candidate rules and golden sets, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tesserae.functions import candidates as C
from tesserae.operators import context, gates, linked, relations
from tesserae.registry import query
from tesserae.storage import stored

# Orders stand for documents, the suppliers of their lines for linked entities; suppliers are linked to the parts that they
# supply most and to the next supplier, and descend from their nation and region. Decisions take all parts that they supply.
CONTEXT_SQL = """lines AS (SELECT DISTINCT l_orderkey AS doc, 's' || l_suppkey AS qid FROM lineitem),
base AS (SELECT 's' || s_suppkey AS qid, 's' || (s_suppkey + 1) AS nxt, 'n' || s_nationkey AS nation, 'r' || n_regionkey AS region, round((s_suppkey % 50) / 50.0, 2) AS baseline FROM supplier JOIN nation ON s_nationkey = n_nationkey),
seeds AS (SELECT doc, qid, baseline, baseline AS local FROM lines JOIN base USING (qid)),
parts AS (SELECT 's' || l_suppkey AS qid, 'p' || l_partkey AS neighbour, least(1.0, 0.2 * count(*)) AS weight, l_partkey FROM lineitem GROUP BY l_suppkey, l_partkey QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) <= 24),
nb AS (SELECT qid, neighbour, weight::DOUBLE AS weight FROM parts UNION ALL SELECT qid, nxt, 0.5 FROM base),
up AS (SELECT qid, nation AS ancestor FROM base UNION SELECT qid, region FROM base),
links AS (SELECT qid AS a, neighbour AS b FROM nb UNION ALL SELECT qid, ancestor FROM up),
deg AS (SELECT node, count(*) AS degree_total FROM (SELECT a AS node FROM links UNION ALL SELECT b FROM links) GROUP BY node),
spec AS (SELECT node, degree_total, CASE WHEN degree_total <= 4 THEN 1.0 WHEN degree_total <= 16 THEN 0.82 WHEN degree_total <= 64 THEN 0.58 WHEN degree_total <= 256 THEN 0.32 ELSE 0.12 END AS sp,
CASE WHEN degree_total <= 16 THEN 0.0 WHEN degree_total <= 48 THEN 0.04 WHEN degree_total <= 128 THEN 0.08 WHEN degree_total <= 256 THEN 0.12 ELSE 0.18 END AS pen FROM deg),
pr AS (SELECT a.doc, a.qid AS l, b.qid AS r FROM seeds a JOIN seeds b ON a.doc = b.doc AND a.qid < b.qid), dp AS (SELECT DISTINCT l, r FROM pr),
d AS (SELECT l, r, max(weight) * 0.75 AS x FROM dp JOIN nb ON (qid = l AND neighbour = r) OR (qid = r AND neighbour = l) GROUP BY l, r),
sh AS (SELECT l, r, sum(least(a.weight, b.weight) * sp) AS x FROM dp JOIN nb a ON a.qid = l JOIN nb b ON b.qid = r AND a.neighbour = b.neighbour JOIN spec ON node = a.neighbour WHERE a.neighbour <> l AND a.neighbour <> r GROUP BY l, r),
an AS (SELECT l, r, sum(0.3 * sp) AS x FROM dp JOIN up a ON a.qid = l JOIN up b ON b.qid = r AND a.ancestor = b.ancestor JOIN spec ON node = a.ancestor GROUP BY l, r),
ps AS (SELECT l, r, round(least(1.0, coalesce(d.x, 0) + least(coalesce(sh.x, 0), 0.75) + least(coalesce(an.x, 0), 0.4)), 6)::DOUBLE AS score FROM dp LEFT JOIN d USING (l, r) LEFT JOIN sh USING (l, r) LEFT JOIN an USING (l, r)),
ev AS (SELECT doc, l AS qid, score FROM pr JOIN ps USING (l, r) UNION ALL SELECT doc, r, score FROM pr JOIN ps USING (l, r)),
pe AS (SELECT doc, qid, sum(score) AS total, count(*) FILTER (score >= 0.12) AS supporting FROM ev GROUP BY doc, qid), cn AS (SELECT doc, count(*) AS seeds FROM seeds GROUP BY doc),
m AS (SELECT doc, qid, seeds, local, baseline, coalesce(supporting, 0) AS supporting, round(coalesce(total / greatest(seeds - 1, 1), 0)::DOUBLE::DECIMAL(20,12), 6)::DOUBLE AS mean_peer_support, coalesce(pen, 0) AS pen, least(1, greatest(seeds - 1, 1)) AS needed
FROM seeds JOIN cn USING (doc) LEFT JOIN pe USING (doc, qid) LEFT JOIN spec ON node = qid),
c AS (SELECT *, round(greatest(0.0, 0.45 * local + 0.55 * mean_peer_support - pen)::DOUBLE::DECIMAL(20,12), 6)::DOUBLE AS cluster_fit FROM m),
t AS (SELECT *, CASE WHEN seeds >= 3 AND ((supporting = 0 AND mean_peer_support <= 0.03 AND local < 0.56 AND cluster_fit < 0.26) OR (supporting < needed AND mean_peer_support < 0.12 AND local < 0.52 AND cluster_fit < 0.28)) THEN 'suppress'
WHEN seeds >= 3 AND mean_peer_support < 0.14 AND local < 0.56 AND cluster_fit < 0.38 THEN 'downgrade' WHEN seeds >= 3 AND supporting >= needed AND mean_peer_support >= 0.45 AND baseline < 0.82 THEN 'boost'
WHEN seeds = 2 AND supporting = 0 AND local < 0.45 AND pen >= 0.08 AND cluster_fit < 0.38 THEN 'downgrade' WHEN seeds = 2 AND supporting > 0 AND mean_peer_support >= 0.55 AND baseline < 0.82 THEN 'boost' ELSE 'keep' END AS action FROM c),
decisions AS (SELECT doc, qid, seeds, mean_peer_support::DOUBLE AS mean_peer_support, supporting, cluster_fit::DOUBLE AS cluster_fit, action, round(CASE WHEN action = 'downgrade' THEN CASE WHEN seeds >= 3 THEN -0.06 ELSE -0.05 END
WHEN action = 'boost' THEN CASE WHEN seeds >= 3 THEN least(0.08, mean_peer_support * 0.18) ELSE least(0.07, mean_peer_support * 0.16) END ELSE 0 END::DOUBLE::DECIMAL(20,12), 6)::DOUBLE AS score_delta FROM t),
strong AS (SELECT doc, qid FROM decisions WHERE action = 'boost' OR (action = 'keep' AND (cluster_fit >= 0.35 OR mean_peer_support >= 0.1 OR (supporting > 0 AND cluster_fit >= 0.3))))"""
MOST_PARTS = " QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) <= 24"
WHOLE_SQL = CONTEXT_SQL.replace(MOST_PARTS, "")


def context_tables(t: Callable, most_parts: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Seeds (doc, qid, local, baseline), base (qid, ...) of all suppliers, and their neighbours, ancestors and degrees."""
    nation = t("nation").select("n_nationkey", "n_regionkey")
    base = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("s"), "s_suppkey").alias("qid"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("next"), F.concat(F.lit("n"), "s_nationkey").alias("nation"),
        F.concat(F.lit("r"), "n_regionkey").alias("region"), F.round((F.col("s_suppkey") % 50) / 50.0, 2).alias("baseline"),
    )
    lines = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("s"), "l_suppkey").alias("qid"))
    seeds = lines.join(base, "qid").select("doc", "qid", "baseline", F.col("baseline").alias("local"))
    parts = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    if most_parts:
        w = W.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_partkey")
        parts = parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_parts)
    parts = parts.select(F.concat(F.lit("s"), "l_suppkey").alias("qid"), F.concat(F.lit("p"), "l_partkey").alias("neighbour"), F.least(F.lit(1.0), 0.2 * F.col("n")).alias("weight"))
    neighbours = stored(parts.unionByName(base.select("qid", F.col("next").alias("neighbour"), F.lit(0.5).alias("weight"))), "neighbours")
    ancestors = base.select("qid", F.explode(F.array("nation", "region")).alias("ancestor"))
    ends = neighbours.select("qid", F.col("neighbour").alias("to")).unionByName(ancestors.select("qid", F.col("ancestor").alias("to")))
    degrees = ends.select(F.explode(F.array("qid", "to")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree_total"))
    return seeds, base, neighbours, ancestors, degrees


def context_seeds(t: Callable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds (doc, qid, local, baseline), their links, and the numbers of nodes (both of ``linked.links``)."""
    seeds, _, *tables = context_tables(t, 24)
    return seeds, *linked.links(*tables)


@query(f'WITH {CONTEXT_SQL} SELECT l AS "left", r AS "right", score FROM ps')
def context_pair_supports(t):
    seeds, links, _ = context_seeds(t)
    return context.pair_supports(seeds, links)


@query(f"WITH {WHOLE_SQL} SELECT * FROM decisions")
def context_seed_decisions(t):
    return context.whole_decisions(*context_tables(t, None)).drop("baseline")


RELATED_SQL = f"""{CONTEXT_SQL}, ways AS (SELECT doc, s.qid AS seed, neighbour AS qid, weight, 1 AS depth, 'shared_neighbor' AS source FROM strong s JOIN nb ON nb.qid = s.qid
UNION ALL SELECT doc, s.qid, ancestor, 0.3, 2, 'shared_ancestor' FROM strong s JOIN up ON up.qid = s.qid), w AS (SELECT * FROM ways WHERE NOT EXISTS (SELECT 1 FROM strong z WHERE z.doc = ways.doc AND z.qid = ways.qid)),
g AS (SELECT doc, qid, count(DISTINCT seed) AS seeds, sum(weight) AS support, min(depth) AS depth, count(DISTINCT source) AS sources, max(source) AS source FROM w GROUP BY doc, qid HAVING count(DISTINCT seed) >= 2),
sc AS (SELECT doc, g.qid, seeds, round(greatest(0.0, least(1.0, (support + least(0.36, (seeds - 1) * 0.18) + CASE WHEN depth <= 1 THEN 0.08 ELSE 0.04 END + CASE WHEN sources >= 2 THEN 0.06 ELSE 0 END) * sp - pen
- CASE WHEN sources = 1 AND source = 'shared_ancestor' THEN CASE WHEN seeds <= 2 THEN 0.06 ELSE 0.03 END ELSE 0 END)), 6)::DOUBLE AS score FROM g JOIN spec ON node = g.qid)"""


@query(f"WITH {RELATED_SQL} SELECT doc, qid, seeds, score, (row_number() OVER (PARTITION BY doc ORDER BY score DESC, qid))::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= 5")
def context_related_entities(t):
    seeds, links, nodes = context_seeds(t)
    return context.related_entities(context.strong_seeds(context.seed_decisions(seeds, links)), nodes)


@query(f"WITH {CONTEXT_SQL} SELECT s.doc, s.qid, round(least(1.0, greatest(0.0, baseline + score_delta)), 6)::DOUBLE AS score, action FROM seeds s JOIN decisions USING (doc, qid) WHERE action <> 'suppress'")
def context_refined_scores(t):
    seeds, links, _ = context_seeds(t)
    return context.refined_seeds(context.seed_decisions(seeds, links, carry=False))


# Ship modes stand for relations, priorities for events.
def ship_catalogue(t: Callable) -> DataFrame:
    """A row a ship mode that has at least one line, with properties by its first letters."""
    m = t("lineitem").select(F.col("l_returnflag").alias("relation")).distinct()
    first = F.substring("relation", 1, 1)
    some = lambda c, *names: F.when(c, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    return m.select(
        "relation", F.when(first == "A", "returned").when(first == "N", "new").alias("family"), some(first == "A", "recall", "refund").alias("event_types"),
        some(first == "N", "in_stock").alias("preconditions"), some(first == "A", "F").alias("source_types"), some(first == "N", "O", "F").alias("target_types"),
        some(first != "R", "discount", "tax").alias("evidence"), F.when(first == "A", "latest").alias("conflict_policy"), F.when(first == "R", "both").alias("direction"),
    )


def line_edges(t: Callable) -> DataFrame:
    fields = F.array_compact(F.array(F.when(F.col("l_discount") > 0, F.lit("discount")), F.when(F.col("l_tax") > 0, F.lit("tax"))))
    events = F.when(F.col("l_quantity") > 45, F.array(F.lit("recall"))).when(F.col("l_quantity") > 40, F.array(F.lit("strike"))).otherwise(F.array().cast("array<string>"))
    status = F.col("l_linestatus")
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("relation"), status.alias("source_type"), status.alias("target_type"), fields.alias("fields"), events.alias("given_events")
    )


SHIP_SQL = """k AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_linestatus AS s, l_discount > 0 AS hd, l_tax > 0 AS ht, l_quantity AS q FROM lineitem)"""


@query(f"""WITH {SHIP_SQL} SELECT f AS relation, family, conflict_policy, direction, warnings, count(*) AS n FROM (SELECT f, CASE f WHEN 'A' THEN 'returned' WHEN 'N' THEN 'new' ELSE 'other' END AS family,
CASE f WHEN 'A' THEN 'latest' ELSE 'keep_all' END AS conflict_policy, CASE f WHEN 'R' THEN 'both' ELSE 'source_to_target' END AS direction,
array_to_string(list_filter([CASE WHEN f NOT IN ('A', 'N') THEN 'unknown_relation' END, CASE WHEN f = 'A' AND s <> 'F' THEN 'source_type_not_allowed' END, CASE WHEN f = 'N' AND s NOT IN ('O', 'F') THEN 'target_type_not_allowed' END,
CASE WHEN f <> 'R' AND NOT (hd AND ht) THEN 'evidence_missing' END, CASE WHEN q > 40 AND q <= 45 THEN 'event_unknown' END, CASE WHEN q > 40 AND NOT (f = 'A' AND q > 45) THEN 'event_not_of_relation' END], lambda x: x IS NOT NULL), ',') AS warnings FROM k) GROUP BY ALL""")
def relation_metadata_warnings(t):
    rows = relations.with_catalogue(line_edges(t), ship_catalogue(t))
    rows = rows.withColumn("warnings", F.array_join(relations.metadata_warnings(["recall", "refund"]), ","))
    return rows.groupBy("relation", "family", "conflict_policy", "direction", "warnings").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SHIP_SQL} SELECT f AS relation, count(*) AS n FROM k WHERE f NOT IN ('A', 'N') OR (CASE WHEN q > 45 THEN 'recall' WHEN q > 40 THEN 'strike' WHEN f = 'A' THEN 'recall' END) = 'recall' GROUP BY f""")
def relation_event_gate(t):
    rows = relations.with_catalogue(line_edges(t).withColumnRenamed("given_events", "event_types"), ship_catalogue(t))
    kept = relations.event_gated(rows, ["A", "N"], F.array(F.lit("recall")))
    return kept.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, warnings, policy, count(*) AS n FROM (SELECT event_type, array_to_string(list_filter([CASE WHEN trim(nm) = '' THEN 'source_name_missing' END, CASE WHEN trim(url) = '' THEN 'source_url_missing' END,
CASE WHEN trim(url) <> '' AND NOT regexp_matches(url, '^https?://') THEN 'source_url_without_scheme' END, CASE WHEN trim(snap) = '' THEN 'snapshot_missing' END,
CASE WHEN trim(snap) <> '' AND NOT regexp_matches(snap, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'snapshot_no_date' END], lambda x: x IS NOT NULL), ',') AS warnings, CASE WHEN event_type IN ('click', 'view') THEN 'auto' WHEN event_type = 'error' THEN 'blocked' ELSE 'review' END AS policy
FROM (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN ' ' ELSE event_type END AS nm, CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a.example' ELSE 'https://a.example' END AS url, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'May' ELSE '2024-05-01' END AS snap FROM events)) GROUP BY ALL""")
def source_attribution(t):
    u = F.col("user_id") % 4
    rows = t("events").select(
        "event_type", F.when(F.col("user_id") % 3 == 0, " ").otherwise(F.col("event_type")).alias("name"), F.when(u == 0, "").when(u == 1, "a.example").otherwise("https://a.example").alias("url"),
        F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "May").otherwise("2024-05-01").alias("snapshot"),
    )
    warnings = F.array_join(relations.attribution_warnings(F.col("name"), F.col("url"), F.col("snapshot")), ",").alias("warnings")
    policy = relations.tier_policy(F.col("event_type"), {"auto": ["click", "view"], "blocked": ["error"]}).alias("policy")
    return rows.select("event_type", warnings, policy).groupBy("event_type", "warnings", "policy").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT src, relation, dst, confidence FROM (SELECT 'c' || c_custkey AS src, 'in_segment' AS relation, 'm' || c_mktsegment AS dst, 0.8 AS confidence FROM customer WHERE c_mktsegment IS NOT NULL
UNION ALL SELECT 'c' || c_custkey, 'in_nation', 'n' || c_nationkey, 0.9 FROM customer UNION ALL SELECT 'n' || c_nationkey, 'exposed_to', 'c' || c_custkey, 0.5 FROM customer WHERE c_acctbal > 5000)""")
def row_edges(t):
    c, n, m = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("m"), "c_mktsegment")
    rich = F.when(F.col("c_acctbal") > 5000, c)
    return relations.row_edges(t("customer"), [(c, "in_segment", m, F.lit(0.8)), (c, "in_nation", n, F.lit(0.9)), (n, "exposed_to", rich, F.lit(0.5))])


# A part is a candidate; its lines are the edges of its paths.
PATH_SQL = """e AS (SELECT l_partkey, list(struct_pack(relation := l_linestatus, evidence := CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'R' THEN 'shallow' ELSE 'inferred' END, confidence := 1 - l_discount::DOUBLE)) AS edges,
count(*) AS k FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_partkey)"""


def part_paths(t: Callable) -> DataFrame:
    evidence = F.when(F.col("l_returnflag") == "A", "direct").when(F.col("l_returnflag") == "R", "shallow").otherwise("inferred")
    edge = F.struct(F.col("l_linestatus").alias("relation"), evidence.alias("evidence"), (1 - F.col("l_discount").cast("double")).alias("confidence"))
    e = t("lineitem").where("l_linenumber <= 2").groupBy("l_partkey").agg(F.collect_list(edge).alias("edges"), F.count(F.lit(1)).alias("k"))
    p = t("part").join(e, F.col("p_partkey") == F.col("l_partkey"), "left")
    none = F.array().cast("array<struct<depth:bigint,edges:array<struct<relation:string,evidence:string,confidence:double>>>>")
    paths = F.when(F.col("k").isNull(), none).otherwise(F.array(F.struct(F.col("k").alias("depth"), F.col("edges"))))
    kind = F.when(F.col("p_size") % 9 == 0, "direct").when(F.col("p_size") % 3 == 0, "shallow").otherwise("inferred")
    return p.select("p_partkey", "p_type", "p_name", kind.alias("evidence"), (F.col("p_size") / 50.0).alias("confidence"), paths.alias("paths"))


@query(f"""WITH {PATH_SQL}, c AS (SELECT p_partkey, lower(p_type) AS x, CASE WHEN p_size % 9 = 0 THEN 'direct' WHEN p_size % 3 = 0 THEN 'shallow' ELSE 'inferred' END AS ev, p_size / 50.0 AS cf, edges, k FROM part LEFT JOIN e ON p_partkey = l_partkey)
SELECT p_partkey, ev = 'direct' OR (ev = 'shallow' AND cf >= 0.78 AND k IS NOT NULL) OR coalesce(k <= 1 AND len(list_filter(edges, lambda z: z.evidence = 'direct')) > 0, false)
OR coalesce(len(list_filter(edges, lambda z: z.evidence IN ('direct', 'shallow') AND z.confidence >= 0.8)) = k, false) AS strong_path,
coalesce(len(list_filter(edges, lambda z: z.relation = 'F' AND z.evidence = 'direct' AND z.confidence >= 0.8)) > 0, false) AS listing,
array_to_string(list_filter([CASE WHEN contains(x, 'promo') OR contains(x, 'small') THEN 'country_risk' END, CASE WHEN contains(x, 'econ') OR contains(x, 'large') THEN 'equity_index' END], lambda z: z IS NOT NULL), ',') AS families,
contains(x, 'medium') OR contains(x, 'promo') OR contains(x, 'small') OR ((contains(x, 'econ') OR contains(x, 'large')) AND NOT contains(x, 'sector')) AS broad FROM c""")
def candidate_path_rules(t):
    f = C.families(F.col("p_type"), {"country_risk": ["promo", "small"], "equity_index": ["econ", "large"]})
    return part_paths(t).select(
        "p_partkey", C.has_strong_path(F.col("evidence"), F.col("confidence"), F.col("paths")).alias("strong_path"), C.has_direct_listing(F.col("paths"), ["F"]).alias("listing"),
        F.array_join(f, ",").alias("families"), C.broad_proxy(F.col("p_type"), f, F.col("paths"), ["medium"]).alias("broad"),
    )


@query(r"""SELECT o_orderpriority, accepted, weight, count(*) AS n FROM (SELECT o_orderpriority, CASE WHEN st = 'p' OR contains(st, 'p') OR why <> '' THEN false ELSE coalesce(flag, st = '' OR st IN ('f')) END AS accepted,
CASE WHEN regexp_matches(o_orderpriority, '(?i)\b(low|none)\b') THEN 0.0 WHEN regexp_matches(o_orderpriority, '(?i)\b(urgent|high)\b') THEN 1.25 ELSE 1.0 END AS weight
FROM (SELECT o_orderpriority, lower(trim(o_orderstatus)) AS st, CASE WHEN o_custkey % 10 = 0 THEN 'old' ELSE '' END AS why, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS flag FROM orders)) GROUP BY ALL""")
def record_rules(t):
    why, flag = F.when(F.col("o_custkey") % 10 == 0, "old"), F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    rows = t("orders").select(
        "o_orderpriority", C.record_accepted(flag, F.col("o_orderstatus"), why, ["f"], ["p"]).alias("accepted"), C.market_relevance(F.col("o_orderpriority"), ["urgent", "high"], ["low", "none"]).alias("weight")
    )
    return rows.groupBy("o_orderpriority", "accepted", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, CASE WHEN links IS NULL THEN s_suppkey % 4 >= 2 ELSE links >= (CASE kind WHEN 'k0' THEN 3 WHEN 'k1' THEN 20 ELSE 5 END) END AS linked,
kind = 'k2' OR (kind = 'k0' AND pop >= 1000) OR (kind = 'k1' AND pop >= 5000) AS place, round(greatest(0.0, least(1.0, 0.24 * a + 0.12 * a + 0.16 * b + 0.14 * a + 0.16 * b + 0.18 * a - 0.18 * b)), 4) AS authority,
round(greatest(0.0, least(1.0, a * 0.24 + b * 0.2 + a * 0.12 + b * 0.08 + 0.12 + b * 0.1 + least(1.0, 0.25 * (s_suppkey % 6)) * 0.06 + a * 0.06 - CASE WHEN s_suppkey % 2 = 0 THEN 0.04 ELSE 0 END)), 4) AS hybrid
FROM (SELECT s_suppkey, 'k' || (s_suppkey % 3) AS kind, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 30 END AS links, s_acctbal AS pop, (s_suppkey % 11) / 10.0 AS a, (s_nationkey % 6) / 5.0 AS b FROM supplier)""")
def entity_keep_and_scores(t):
    k = F.col("s_suppkey")
    kind, links, a, b = F.concat(F.lit("k"), k % 3), F.when(k % 5 != 0, k % 30), (k % 11) / 10.0, (F.col("s_nationkey") % 6) / 5.0
    features = {"proposal": a, "alias": b, "prior": a, "popularity": b, "label": F.lit(1.0), "surface": b, "anchor": C.context_bonus(k % 6, 0.25), "source": a, "generated": k % 2 == 0}
    return t("supplier").select(
        "s_suppkey", C.enough_links(links, kind, {"k0": 3, "k1": 20}, k % 4).alias("linked"), C.place_kept(kind, F.col("s_acctbal"), ["k2"], {"k0": 1000, "k1": 5000}).alias("place"),
        C.authority_score(a, a, b, a, b, a, b).alias("authority"), C.hybrid_score(features).alias("hybrid"),
    )


# The ten nearest vectors answer a query; those of its label among the first hundred ids are wanted.
@query("""WITH found AS (SELECT l_orderkey AS "case", l_suppkey AS item, l_linenumber AS rank FROM lineitem), expected AS (SELECT DISTINCT l_orderkey AS "case", l_suppkey AS item FROM lineitem WHERE l_suppkey % 3 = 0),
h AS (SELECT "case", item, min(rank) AS rank FROM found WHERE rank <= 3 GROUP BY ALL), b AS (SELECT coalesce(e."case", h."case") AS c, e.item IS NOT NULL AS w, h.rank FROM expected e FULL JOIN h ON e."case" = h."case" AND e.item = h.item),
x AS (SELECT c, count(*) FILTER (w) AS wanted, count(rank) AS given, count(*) FILTER (w AND rank IS NOT NULL) AS hit, min(rank) FILTER (w) AS first FROM b GROUP BY c HAVING count(*) FILTER (w) > 0),
r AS (SELECT count(*) AS cases, round(sum(hit) / sum(given), 6) AS precision_at_k, round(sum(hit) / sum(wanted), 6) AS recall_at_k, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) FILTER (hit = wanted) AS all_hit FROM x)
SELECT *, array_to_string(list_filter([CASE WHEN precision_at_k < 0.75 THEN 'precision_at_k_below_0.75' END, CASE WHEN recall_at_k < 0.6 THEN 'recall_at_k_below_0.6' END, CASE WHEN mrr < 0.7 THEN 'mrr_below_0.7' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def release_gates(t):
    found = t("lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("rank"))
    report = gates.ranked_quality(found, found.where("item % 3 = 0").select("case", "item"), 3)
    return report.withColumn("reasons", F.array_join(gates.gate_reasons({"precision_at_k": 0.75, "recall_at_k": 0.6, "mrr": 0.7}, {}), ","))


@query("""WITH cases AS (SELECT o_orderkey AS "case", o_orderpriority AS family FROM orders), f AS (SELECT DISTINCT l_orderkey AS "case", l_suppkey AS item FROM lineitem WHERE l_discount > 0.05),
e AS (SELECT DISTINCT l_orderkey AS "case", l_suppkey AS item FROM lineitem WHERE l_tax > 0.02), x AS (SELECT coalesce(f."case", e."case") AS "case", count(f.item) AS found, count(e.item) AS wanted, count(*) FILTER (f.item IS NOT NULL AND e.item IS NOT NULL) AS hit
FROM f FULL JOIN e ON f."case" = e."case" AND f.item = e.item GROUP BY 1), r AS (SELECT family, coalesce(found, 0) AS found, coalesce(wanted, 0) AS wanted, coalesce(hit, 0) AS hit FROM cases LEFT JOIN x USING ("case"))
SELECT family, count(*) AS cases, round(count(*) FILTER (hit > 0) / count(*), 6) AS useful_rate, round(count(*) FILTER (found = 0) / count(*), 6) AS empty_rate, round(count(*) FILTER (found > 0 AND hit = 0) / count(*), 6) AS unrelated_rate,
round(sum(hit) / sum(wanted), 6) AS recall, sum(found - hit)::BIGINT AS false_positives FROM r GROUP BY family""")
def golden_answer_rates(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_suppkey").alias("item"), "l_discount", "l_tax")
    return gates.answer_rates(t("orders").select(F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("family")), lines.where("l_discount > 0.05"), lines.where("l_tax > 0.02"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS "case", l_suppkey AS item FROM lineitem WHERE l_discount > 0.03), e AS (SELECT DISTINCT l_orderkey AS "case", l_suppkey AS item FROM lineitem WHERE l_tax > 0.04),
pr AS (SELECT "case", item, item AS seen FROM e UNION SELECT "case", item, item + 1 FROM e), m AS (SELECT DISTINCT pr."case", pr.item FROM pr JOIN f ON f."case" = pr."case" AND f.item = pr.seen),
good AS (SELECT count(*) AS n FROM f WHERE EXISTS (SELECT 1 FROM pr WHERE pr."case" = f."case" AND pr.seen = f.item)), bad AS (SELECT count(*) AS n FROM f WHERE item % 10 = 0)
SELECT round((SELECT count(*) FROM m) / (SELECT count(*) FROM e), 6) AS recall, round((SELECT n FROM good) / (SELECT count(*) FROM f), 6) AS precision, (SELECT n FROM bad) AS forbidden_hits""")
def golden_terminals(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_suppkey").alias("item"), "l_discount", "l_tax")
    expected = lines.where("l_tax > 0.04").select("case", "item")
    accepted = expected.select("case", "item", (F.col("item") + 1).alias("proxy"))
    return gates.terminal_quality(lines.where("l_discount > 0.03").select("case", "item"), expected, accepted, lines.where("item % 10 = 0").select("case", "item"))


@query("""WITH a AS (SELECT p_partkey AS id, p_type AS label, p_brand AS alias, p_size > 5 AS kept, lower(p_name) AS canonical FROM part), o AS (SELECT alias, count(DISTINCT id) AS owners FROM a WHERE kept GROUP BY alias)
SELECT label, count(*) AS entities, count(DISTINCT canonical) AS unique_canonicals, count(*) FILTER (kept) AS aliases, count(DISTINCT CASE WHEN kept AND owners > 1 THEN alias END) AS ambiguous, round(count(*) FILTER (NOT kept) / count(*), 6) AS dropped_ratio
FROM a LEFT JOIN o USING (alias) GROUP BY label""")
def pack_build_report(t):
    p = t("part")
    entities = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), F.col("p_name").alias("canonical"))
    return gates.build_report(entities, p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("alias"), (F.col("p_size") > 5).alias("kept")))


@query("SELECT event_type, count(*) AS runs, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS longest FROM events GROUP BY event_type")
def latency_percentiles(t):
    return gates.latency_summary(t("events"), "event_type", "value")
