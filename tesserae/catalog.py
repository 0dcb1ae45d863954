"""All registered queries of the library over the given tables, with the SQL that DuckDB runs for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import catalog_context, catalog_resolution  # register their queries  # noqa: F401
from tesserae.functions import text as T
from tesserae.operators import cooccurrence, dictionary, evaluation, events, graph, mentions, vectors
from tesserae.plans import impact
from tesserae.registry import QUERIES, Query, query, SQL
from tesserae.streaming import windows

RULES = {"email": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "number": r"[0-9]{4,}", "license": r"[Ll]icensed? under"}
SIGNALS = [("question", r"\?"), ("number", r"[0-9]{2,}"), ("symbols", r"[#$%&*]{2,}"), ("short", r"^\S{1,12}$")]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tag_exact_alias"](spark, sf_dir)


WORDS_SQL = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"


def phrases(t: Callable) -> DataFrame:
    """Alias table: the first five words of each benchmark text."""
    w = t("benchmark").select("item_id", T.words(F.col("text")).alias("w")).where(F.size("w") >= 5)
    return w.select("item_id", F.array_join(F.slice("w", 1, 5), " ").alias("surface"))


TAGGED_SQL = f"""
    aliases AS (SELECT item_id, array_to_string(w[1:5], ' ') AS surface FROM (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark) WHERE len(w) >= 5),
    tokens AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents),
    windows AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM tokens WHERE len(w) >= 5),
    tagged AS (SELECT doc_id, i - 1 AS start, item_id, surface FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS surface FROM windows) JOIN aliases USING (surface))
"""


@query(f"WITH {TAGGED_SQL} SELECT doc_id, start, item_id, surface FROM tagged")
def tag_exact_alias(t):
    return dictionary.tag_exact(t("documents"), phrases(t), sizes=[5]).select("doc_id", F.col("start").cast("long").alias("start"), "item_id", "surface")


PARTS_SQL = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+')"


@query(f"""WITH names AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
aliases AS (SELECT min(item_id) AS item_id, surface, n FROM (SELECT item_id, n, array_to_string(w[1:n], ' ') AS surface FROM names, (SELECT unnest([2, 3, 5, 8]) AS n) WHERE len(w) >= n) GROUP BY surface, n),
tokens AS (SELECT doc_id, text, {WORDS_SQL.format('text')} AS w FROM documents), windows AS (SELECT doc_id, n, i - 1 AS start, array_to_string(w[i:i + n - 1], ' ') AS surface FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
FROM tokens, (SELECT unnest([2, 3, 5, 8]) AS n) WHERE len(w) >= n)), hits AS (SELECT doc_id, start, n, surface, item_id FROM windows JOIN aliases USING (surface, n)),
longest AS (SELECT h.* FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.doc_id = h.doc_id AND g.start <= h.start AND g.start + g.n >= h.start + h.n AND g.n > h.n)),
parts AS (SELECT doc_id, {PARTS_SQL} AS p FROM documents), led AS (SELECT doc_id, p, CASE WHEN regexp_matches(p[1], '^[\\p{{L}}\\p{{M}}\\p{{N}}]') THEN 0 ELSE 1 END AS lead FROM parts)
SELECT doc_id, start, n::INT AS n, surface, item_id, coalesce(list_sum(list_transform(p[1:lead + 2 * start], lambda x: length(x))), 0)::INT AS raw_start,
list_sum(list_transform(p[1:lead + 2 * start + 2 * n - 1], lambda x: length(x)))::INT AS raw_end FROM longest JOIN led USING (doc_id)""")
def tag_longest_spans(t):
    """Aliases of several lengths: of overlapping ones the leftmost longest, with their characters in the raw text."""
    w = t("benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    names = w.select("item_id", "w", F.explode(F.array(*map(F.lit, (2, 3, 5, 8)))).alias("k")).where(F.size("w") >= F.col("k"))
    aliases = names.groupBy(F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("surface")).agg(F.min("item_id").alias("item_id"))
    found = dictionary.leftmost_longest(dictionary.tag_exact(t("documents"), aliases))
    spans = dictionary.with_offsets(found, t("documents"))
    return spans.select("doc_id", F.col("start").cast("long").alias("start"), "n", "surface", "item_id", "raw_start", "raw_end")


@query()
def feature_hash_signed(t):
    f = F.explode(F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("type="), "p_type"), F.concat(F.lit("size="), "p_size"))).alias("feature")
    return vectors.signed_feature_hash(t("part").select("p_partkey", f, F.lit(1.0).alias("weight")), "p_partkey")


@query(f"WITH {TAGGED_SQL} SELECT doc_id, item_id, count(*) AS mention_count, min(start) AS first_start, array_to_string(list_sort(list(DISTINCT surface)), '|') AS surfaces FROM tagged GROUP BY ALL")
def entity_merge_by_link(t):
    return mentions.merge_by_entity(tag_exact_alias(t), "doc_id", "item_id")


@query(f"""WITH {TAGGED_SQL}, merged AS (SELECT doc_id, item_id, count(*) AS mention_count, min(start) AS first_start FROM tagged GROUP BY ALL)
SELECT doc_id, item_id, mention_count, round(least(1.0, 0.4 + 0.1 * least(mention_count, 4) + 0.2 * (1 - first_start / greatest(len(w), 1))), 4) AS relevance FROM merged JOIN tokens USING (doc_id)""")
def entity_relevance(t):
    n = t("documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n_tokens"))
    return mentions.relevance(entity_merge_by_link(t), "doc_id", n).select("doc_id", "item_id", "mention_count", "relevance")


@query(f"""WITH {TAGGED_SQL}, best AS (SELECT doc_id, surface, arg_min(item_id, struct_pack(a := -((item_id * 7 + start) % 5), b := item_id)) AS chosen FROM tagged GROUP BY ALL)
SELECT doc_id, start, item_id, surface, chosen FROM tagged JOIN best USING (doc_id, surface)""")
def surface_consistency(t):
    m = tag_exact_alias(t).withColumn("score", (F.col("item_id") * 7 + F.col("start")) % 5)
    return mentions.consistent_surfaces(m, "doc_id", "surface", "item_id", "score").select("doc_id", "start", "item_id", "surface", "chosen")


@query()
def overlap_resolution(t):
    m = dictionary.tag_exact(t("documents"), phrases(t), sizes=[5])
    spans = m.select("doc_id", F.col("start").cast("long"), (F.col("start") + F.col("n")).cast("long").alias("end"), "item_id", (1.0 + F.col("item_id") % 3).alias("score"))
    return mentions.resolve_overlaps(spans)


@query(f"""SELECT n, count(*) AS windows, count(DISTINCT surface) AS surfaces FROM (
SELECT n, array_to_string(w[i:i + n - 1], ' ') AS surface FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT {WORDS_SQL.format('text')} AS w FROM benchmark), (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)) GROUP BY n""")
def alias_window_counts(t):
    w = dictionary.token_windows(t("benchmark"), "item_id", T.words(F.col("text")), [1, 2, 3])
    return w.groupBy("n").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("surface").alias("surfaces"))


@query()
def document_window_counts(t):
    w = dictionary.token_windows(t("documents"), "doc_id", T.words(F.col("text")), [1, 2, 3])
    return w.groupBy("n").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("surface").alias("surfaces"))


RULES_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, unnest(regexp_extract_all(text, '{p}')) AS surface FROM documents" for k, p in RULES.items())


@query(f"SELECT doc_id, label, surface, count(*) AS n FROM ({RULES_SQL}) GROUP BY ALL")
def rule_regex_matches(t):
    return mentions.rule_mentions(t("documents"), RULES)


@query(f"WITH m AS (SELECT doc_id, label, surface, count(*) AS n FROM ({RULES_SQL}) GROUP BY ALL) SELECT doc_id, label, max(n) AS n, arg_min(surface, struct_pack(a := -n, b := length(surface), c := surface)) AS surface FROM m GROUP BY ALL")
def mention_dedupe_argmax(t):
    m = rule_regex_matches(t).withColumn("size", F.length("surface"))
    return mentions.dedupe(m, ["doc_id", "label"], "n", ["size", "surface"]).select("doc_id", "label", "n", "surface")


@query(f"WITH m AS (SELECT doc_id, label, surface, count(*) AS n FROM ({RULES_SQL}) GROUP BY ALL) SELECT source, label, sum(n)::BIGINT AS mentions, count(DISTINCT doc_id) AS docs FROM m JOIN documents USING (doc_id) GROUP BY ALL")
def topics_by_domain(t):
    return mentions.topics(rule_regex_matches(t).join(t("documents").select("doc_id", "source"), "doc_id"), "source")


@query(f"""WITH m AS (SELECT doc_id, label, surface, count(*) AS n FROM ({RULES_SQL}) GROUP BY ALL), c AS (SELECT doc_id, count(*) AS entity_count FROM m GROUP BY doc_id),
d AS (SELECT doc_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_.+&/-]*'))::BIGINT AS token_count, coalesce(entity_count, 0)::BIGINT AS entity_count FROM documents LEFT JOIN c USING (doc_id))
SELECT *, round(100.0 * entity_count / greatest(token_count, 1), 4) AS per_100_tokens, token_count >= 100 AND round(100.0 * entity_count / greatest(token_count, 1), 4) < 0.5 AS low_density FROM d""")
def doc_metrics(t):
    return mentions.metrics(t("documents"), rule_regex_matches(t))


@query(f"""WITH m AS (SELECT doc_id, label, surface, count(*) AS n FROM ({RULES_SQL}) GROUP BY ALL), c AS (SELECT doc_id, count(*) AS entity_count FROM m GROUP BY doc_id),
d AS (SELECT doc_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_.+&/-]*'))::BIGINT AS token_count, coalesce(entity_count, 0)::BIGINT AS entity_count FROM documents LEFT JOIN c USING (doc_id))
SELECT doc_id, token_count, entity_count FROM d WHERE token_count >= 50 AND round(100.0 * entity_count / token_count, 4) < 1.0""")
def density_warning(t):
    m = mentions.metrics(t("documents"), rule_regex_matches(t), low_density=1.0, least_tokens=50)
    return m.where("low_density").select("doc_id", "token_count", "entity_count")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM pages""")
def html_visible_text(t):
    return t("pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query()
def segment_documents(t):
    return t("documents").select("doc_id", F.explode(T.segments("text")).alias("s")).select("doc_id", "s.*")


@query("""SELECT doc_id, n_chars, CASE WHEN row_number() OVER (ORDER BY doc_id) > 300 THEN 'max_files' WHEN sum(n_chars) OVER (ORDER BY doc_id) > 500000 THEN 'max_bytes' ELSE 'taken' END AS status FROM documents""")
def file_discovery_limits(t):
    return evaluation.prefix_limits(t("documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 300, 500_000).select("doc_id", "n_chars", "status")


@query("""WITH o AS (SELECT doc_id, sha256(text) AS f FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS f FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.f = n.f THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id)""")
def manifest_replay_diff(t):
    d = t("documents")
    # the two versions are made from the table: some documents are missing in either, some have changed
    old = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("f"))
    new = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.expr("doc_id % 7 = 0"), F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("f"))
    return evaluation.diff(old, new, "doc_id", "f")


@query("""SELECT p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.v = n.v THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT p_partkey, p_brand AS v FROM part WHERE p_size > 5) o FULL JOIN (SELECT p_partkey, CASE WHEN p_size > 45 THEN p_type ELSE p_brand END AS v FROM part WHERE p_size < 48) n USING (p_partkey)""")
def pack_diff(t):
    p = t("part")
    new = p.where("p_size < 48").select("p_partkey", F.when(F.col("p_size") > 45, F.col("p_type")).otherwise(F.col("p_brand")).alias("v"))
    return evaluation.diff(p.where("p_size > 5").select("p_partkey", F.col("p_brand").alias("v")), new, "p_partkey", "v")


@query("SELECT p_partkey, p_name FROM part JOIN (SELECT DISTINCT lower(p_name) AS q FROM part WHERE p_partkey % 20 = 0) ON lower(p_name) = q")
def lookup_exact(t):
    p = t("part")
    return dictionary.lookup_exact(p.select("p_partkey", F.col("p_name").alias("name")), p.where("p_partkey % 20 = 0").select(F.lower("p_name").alias("q")).distinct()).select("p_partkey", F.col("name").alias("p_name"))


@query("""SELECT p_partkey, rank, p_name, p_brand FROM (SELECT p_partkey, p_name, p_brand, greatest(CASE WHEN lower(p_name) = 'brand#1' THEN 3 WHEN starts_with(lower(p_name), 'brand#1') THEN 2 WHEN contains(lower(p_name), 'brand#1') THEN 1 ELSE 0 END,
CASE WHEN lower(p_brand) = 'brand#1' THEN 3 WHEN starts_with(lower(p_brand), 'brand#1') THEN 2 WHEN contains(lower(p_brand), 'brand#1') THEN 1 ELSE 0 END) AS rank FROM part) WHERE rank > 0 ORDER BY rank DESC, p_name, p_brand, p_partkey LIMIT 50""")
def lookup_like_ranked(t):
    p = t("part").select("p_partkey", "p_name", "p_brand")
    return dictionary.lookup_like(p, "Brand#1", ["p_name", "p_brand"], 50, ["p_partkey"]).select("p_partkey", "rank", "p_name", "p_brand")


INDEX_SQL = f"ix AS (SELECT doc_id, len(w) AS length, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents)) GROUP BY ALL)"


@query(f"WITH {INDEX_SQL} SELECT doc_id FROM ix WHERE starts_with(term, 'er') GROUP BY doc_id INTERSECT SELECT doc_id FROM ix WHERE starts_with(term, 'th') GROUP BY doc_id")
def lookup_prefix_and(t):
    return dictionary.lookup_prefix_and(dictionary.terms_of(t("documents"), "doc_id", F.col("text")), "doc_id", ["er", "th"])


@query(f"""WITH {INDEX_SQL}, n AS (SELECT count(*) AS docs, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM ix)), q AS (SELECT * FROM ix WHERE term IN ('the', 'idiot', 'license')),
f AS (SELECT term, count(*) AS df FROM q GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 4) AS score FROM q JOIN f USING (term), n GROUP BY doc_id""")
def lookup_bm25(t):
    b = dictionary.bm25(t("documents"), "doc_id", F.col("text"), ["the", "idiot", "license"])
    return b.select("doc_id", F.round("score", 4).alias("score"))


TRIGRAM_SQL = "list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)))"


@query(f"""WITH p AS (SELECT p_partkey, p_brand, {TRIGRAM_SQL} AS t FROM (SELECT p_partkey, p_brand, '  ' || lower(p_brand) || ' ' AS x FROM part)), q AS (SELECT {TRIGRAM_SQL} AS q FROM (SELECT '  ' || 'brand#12' || ' ' AS x))
SELECT * FROM (SELECT p_partkey, p_brand, round(len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))), 4) AS similarity FROM p, q) WHERE similarity >= 0.2""")
def lookup_trigram(t):
    return dictionary.lookup_trigram(t("part"), "p_partkey", "p_brand", "brand#12")


@query("""WITH c AS (SELECT p_brand AS alias_key, p_type AS label, max(p_size / 50.0) AS score FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY alias_key ORDER BY score DESC, label) AS rank FROM c),
g AS (SELECT alias_key, count(*) AS label_count, max(score) AS top_score, max(CASE WHEN rank = 2 THEN score END) AS runner_up_score FROM r GROUP BY alias_key)
SELECT g.*, runner_up_score IS NOT NULL AND top_score - runner_up_score < 0.05 AS ambiguous, (SELECT string_agg(label, ',' ORDER BY rank) FROM r WHERE r.alias_key = g.alias_key AND rank <= 3 AND g.top_score - score < 0.05) AS retained_labels FROM g""")
def alias_cluster_resolution(t):
    return dictionary.resolve_clusters(t("part").select(F.col("p_brand").alias("alias_key"), F.col("p_type").alias("label"), (F.col("p_size") / 50.0).alias("score")))


@query("SELECT p_brand, p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_size DESC, p_partkey) = 1")
def alias_upsert_winner(t):
    return dictionary.best_rows(t("part"), ["p_brand", "p_type"], [F.desc("p_retailprice"), F.desc("p_size"), F.col("p_partkey")]).select("p_brand", "p_type", "p_partkey", "p_retailprice")


@query("""SELECT DISTINCT c_custkey, variant FROM (SELECT c_custkey, unnest([c_name, regexp_replace(c_name, '[ ,]+(inc|ltd|llc|corp|plc|gmbh|sa)\\.?$', '', 'i'), trim(regexp_replace(c_name, '[-/#]+', ' ', 'g')), regexp_replace(c_name, '^the +', '', 'i'),
(SELECT CASE WHEN len(p) >= 2 THEN array_to_string(list_transform(p, lambda w: upper(w[1])), '') END FROM (SELECT list_filter(regexp_split_to_array(trim(c_name), '[\\s#-]+'), lambda w: w <> '' AND lower(w) NOT IN ('of', 'the', 'and', 'for', 'de', 'la')) AS p))]) AS variant FROM customer) WHERE variant IS NOT NULL AND variant <> ''""")
def alias_variants(t):
    return t("customer").select("c_custkey", F.explode(T.alias_variants(F.col("c_name"))).alias("variant"))


EDGE_SQL = "SELECT o_custkey AS src, l_partkey AS dst, 1 - l_discount AS confidence, l_returnflag AS pack FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def order_edges(t: Callable) -> DataFrame:
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    return o.join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("src", F.col("l_partkey").alias("dst"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_returnflag").alias("pack"))


@query(f"SELECT src, dst, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT pack)), ',') AS packs, count(*) AS evidence FROM ({EDGE_SQL}) GROUP BY ALL")
def graph_build_merge_edges(t):
    return graph.merge_edges(order_edges(t), ["src", "dst"])


@query("SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree_total FROM (SELECT l_suppkey AS node, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT l_partkey + 1000000, 0, 1 FROM lineitem) GROUP BY node")
def graph_degree_stats(t):
    return graph.degrees(t("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")))


@query("WITH d AS (SELECT count(*) AS n FROM (SELECT l_suppkey AS node FROM lineitem UNION ALL SELECT l_partkey + 1000000 FROM lineitem) GROUP BY node) SELECT count(*) AS nodes, max(n) AS max_degree, round(avg(n), 4) AS mean_degree, quantile_disc(n, 0.95) AS p95_degree FROM d")
def graph_degree_summary(t):
    return graph.degree_summary(graph_degree_stats(t))


@query(f"SELECT pack AS predicate, count(*) AS edges FROM ({EDGE_SQL}) GROUP BY ALL")
def graph_predicate_histogram(t):
    return order_edges(t).groupBy(F.col("pack").alias("predicate")).agg(F.count(F.lit(1)).alias("edges"))


PAIRS_SQL = "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL"


@query(f"SELECT src, dst, weight, (row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst))::INT AS rank FROM ({PAIRS_SQL}) QUALIFY rank <= 10")
def graph_neighbors_topn(t):
    return graph.top_neighbors(t("lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight")), 10)


@query(f"SELECT dst, count(*) AS seed_count FROM ({PAIRS_SQL}) WHERE src % 20 = 0 GROUP BY dst HAVING count(*) >= 2")
def graph_shared_neighbors(t):
    seeds = t("supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("src"))
    return graph.shared_neighbors(t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), seeds)


def hierarchy(t: Callable) -> DataFrame:
    return (
        t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
        .unionByName(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
        .unionByName(t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent")))
    )


PARENTS_SQL = "h AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"
CLOSURE_SQL = f"WITH RECURSIVE {PARENTS_SQL}, c(node, ancestor, hops) AS (SELECT child, parent, 1 FROM h UNION ALL SELECT c.node, h.parent, c.hops + 1 FROM c JOIN h ON c.ancestor = h.child WHERE c.hops < 3)"


@query(f"{CLOSURE_SQL} SELECT node, ancestor, min(hops) AS hops FROM c GROUP BY ALL")
def type_closure(t):
    return graph.closure(hierarchy(t), 3)


@query(f"{CLOSURE_SQL} SELECT a.node AS \"left\", b.node AS \"right\", a.ancestor, a.hops + b.hops AS hops FROM c a JOIN c b USING (ancestor) WHERE a.node LIKE 'n%' AND b.node LIKE 'r%'")
def graph_shared_ancestors(t):
    # every nation with every region: two lists that do not grow
    h = hierarchy(t)
    nations = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.shared_ancestors(h, nations, t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")), 3)


@query(f"{CLOSURE_SQL}, s AS (SELECT 'c' || c_custkey AS source FROM customer WHERE c_custkey % 20 = 0) SELECT source, ancestor AS node, min(hops) AS hops FROM c JOIN s ON node = source GROUP BY ALL UNION ALL SELECT source, source, 0 FROM s")
def graph_shortest_path(t):
    h = hierarchy(t)
    sources = t("customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return graph.shortest_paths(h.select(F.col("child").alias("src"), F.col("parent").alias("dst")), sources, 3)


IMPACT_SQL = """WITH e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 0.9 AS confidence FROM nation UNION ALL SELECT 'n' || c_nationkey, 'm' || c_mktsegment, 0.5 + 0.01 * (count(*) % 40) FROM customer GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS rn FROM e QUALIFY rn <= 64), p1 AS (SELECT src AS seed, dst AS node, 1 AS hops, confidence FROM s WHERE src LIKE 'r%'),
p2 AS (SELECT p1.seed, s.dst AS node, 2 AS hops, least(p1.confidence, s.confidence) AS confidence FROM p1 JOIN s ON p1.node = s.src), a AS (SELECT seed, node, hops, round(confidence * 0.9, 6) AS confidence FROM p1 UNION ALL SELECT seed, node, hops, round(confidence * 0.75, 6) FROM p2),
b AS (SELECT seed, node, arg_max(hops, struct_pack(x := confidence, y := -hops)) AS hops, max(confidence)::DOUBLE AS confidence FROM a GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, hops, node))::INT AS rank FROM b QUALIFY rank <= 25"""


@query(IMPACT_SQL)
def impact_expand(t):
    return graph.expand_paths(impact.market_edges(t("nation"), t("customer")), t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")))


ORDER_GRAPH_SQL = """e AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, max(1 - l_discount::DOUBLE) AS confidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, max(1 - l_tax::DOUBLE) FROM lineitem GROUP BY ALL),
s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) <= 64), seeds AS (SELECT 'c' || c_custkey AS seed, 0.5 + c_nationkey / 50.0 AS own FROM customer WHERE c_custkey % 20 = 0),
p1 AS (SELECT seed, own, dst AS node, confidence FROM seeds JOIN s ON src = seed), p2 AS (SELECT seed, own, s.dst AS node, least(p1.confidence, s.confidence) AS confidence FROM p1 JOIN s ON s.src = p1.node),
a AS (SELECT seed, node, 1 AS hops, round(own * confidence * 0.9, 6) AS confidence FROM p1 UNION ALL SELECT seed, node, 2, round(own * confidence * 0.75, 6) FROM p2),
b AS (SELECT seed, node, arg_max(hops, struct_pack(x := confidence, y := -hops)) AS hops, max(confidence)::DOUBLE AS confidence FROM a GROUP BY ALL)"""


@query(f"WITH {ORDER_GRAPH_SQL} SELECT *, (row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, hops, node))::INT AS rank FROM b QUALIFY rank <= 25")
def impact_expand_orders(t):
    """Many seeds (a stated set of customers, each with its own confidence) over a graph of hundreds of thousands of edges."""
    lines = t("lineitem").select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("part"), F.concat(F.lit("s"), "l_suppkey").alias("supplier"), "l_discount", "l_tax")
    buys = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.col("part").alias("dst"))
    buys = buys.agg(F.max(1 - F.col("l_discount").cast("double")).alias("confidence")).withColumn("relation", F.lit("buys"))
    made = lines.groupBy(F.col("part").alias("src"), F.col("supplier").alias("dst")).agg(F.max(1 - F.col("l_tax").cast("double")).alias("confidence"))
    seeds = t("customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"), (0.5 + F.col("c_nationkey") / 50.0).alias("confidence"))
    return graph.expand_paths(buys.unionByName(made.withColumn("relation", F.lit("made_by"))), seeds)


@query()
def impact_expand_customers(t):
    regions = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.expand_paths(impact.customer_edges(t("nation"), t("customer")), regions, depth=3)


@query()
def impact_best_paths(t):
    regions = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.best_paths(impact.customer_edges(t("nation"), t("customer")), regions, depth=3)


@query("SELECT o_custkey AS ref, l_partkey AS node, count(DISTINCT o_orderkey) AS shared FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def identity_bridge(t):
    # an order is the identity: customers are references to it, parts are nodes that carry it
    refs = t("orders").select(F.col("o_custkey").alias("ref"), F.col("o_orderkey").alias("key"))
    return graph.identity_bridge(refs, t("lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("key")))


@query("SELECT 'n' || n_nationkey AS node, 'region:' || r_name AS target, 'located_in' AS relation, 0.8::DOUBLE AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey")
def proxy_edge_template(t):
    templates = t("region").select(F.col("r_regionkey").alias("kind"), F.concat(F.lit("region:"), "r_name").alias("target"), F.lit("located_in").alias("relation"), F.lit(0.8).alias("confidence"))
    return graph.template_edges(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_regionkey").alias("kind")), templates)


def neighbours(t: Callable, k: int = 10) -> DataFrame:
    e = t("embeddings")
    return vectors.top_cosine(e, e.where("vec_id % 20 = 0"), k)


COSINE_SQL = "kn AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id QUALIFY rank <= 10)"


@query(f"WITH {COSINE_SQL} SELECT query_id, vec_id, cosine, rank::INT AS rank FROM kn")
def vector_topk_cosine(t):
    return neighbours(t)


@query(f"WITH {COSINE_SQL}, s AS (SELECT query_id, a.label, sum((a.label = b.label)::INT) / 10.0 AS share FROM kn JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = kn.vec_id GROUP BY ALL) SELECT label, count(*) AS seeds, round(avg(share), 4) AS coherence FROM s GROUP BY label")
def doc_coherence(t):
    return vectors.coherence(neighbours(t), t("embeddings").select("vec_id", "label"), 10)


@query(f"WITH {COSINE_SQL} SELECT query_id, sum((a.label = b.label)::INT)::BIGINT AS support, round(avg(cosine), 4) AS mean_cosine FROM kn JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = kn.vec_id GROUP BY query_id")
def vector_seed_support(t):
    return vectors.seed_support(neighbours(t), t("embeddings").select("vec_id", "label"))


@query(f"WITH {COSINE_SQL}, f AS (SELECT query_id, min(CASE WHEN a.label = b.label THEN rank END) AS r FROM kn JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = kn.vec_id GROUP BY query_id) SELECT count(*) AS queries, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f")
def vector_mrr_at_k(t):
    return vectors.reciprocal_rank(neighbours(t), t("embeddings").select("vec_id", "label"))


@query(f"WITH {COSINE_SQL}, g AS (SELECT label, kn.vec_id, count(*) AS seeds, max(cosine) AS best FROM kn JOIN embeddings a ON a.vec_id = query_id GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY label ORDER BY seeds DESC, best DESC, vec_id))::INT AS rank FROM g QUALIFY rank <= 5")
def related_aggregate(t):
    return vectors.related(neighbours(t), t("embeddings").select("vec_id", "label"), 5)


@query("""WITH f AS (SELECT p_partkey, unnest(['brand=' || p_brand, 'type=' || p_type, 'size=' || p_size]) AS feature FROM part), s AS (SELECT p_partkey, ('0x' || substr(md5(feature), 1, 8))::BIGINT % 384 AS bucket, sum(1.0::DOUBLE) AS value FROM f GROUP BY ALL)
SELECT p_partkey, bucket, round(value / sqrt(sum(value * value) OVER (PARTITION BY p_partkey)), 6) AS value FROM s""")
def feature_hash_sparse(t):
    f = F.explode(F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("type="), "p_type"), F.concat(F.lit("size="), "p_size"))).alias("feature")
    return vectors.feature_hash(t("part").select("p_partkey", f, F.lit(1.0).alias("weight")), "p_partkey")


COOC_SQL = """rec AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS entity, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate > TIMESTAMP '1997-12-02'),
pairs AS (SELECT w AS "window", a.entity AS "left", b.entity AS "right", count(*) AS weight FROM rec a JOIN rec b ON a.doc = b.doc AND a.entity < b.entity, (SELECT unnest(['d1', 'd7', 'd30']) AS w, unnest([1, 7, 30]) AS days) WHERE a.ts > TIMESTAMP '1998-01-01' - to_days(days) GROUP BY ALL)"""


def order_pairs(t: Callable) -> DataFrame:
    r = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("entity"), F.col("o_orderdate").alias("ts"))
    return cooccurrence.window_pairs(r, "1998-01-01", {"d1": 1, "d7": 7, "d30": 30})


@query(f"WITH {COOC_SQL} SELECT * FROM pairs")
def cooccurrence_windows(t):
    return order_pairs(t)


@query(f"""WITH {COOC_SQL}, both_ways AS (SELECT "left" AS l, "right" AS r, weight FROM pairs WHERE "window" = 'd30' UNION ALL SELECT "right", "left", weight FROM pairs WHERE "window" = 'd30')
SELECT r AS entity, count(DISTINCT l) AS seed_count, sum(weight)::BIGINT AS weight FROM both_ways WHERE l IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY r""")
def cooccurrence_supports(t):
    return cooccurrence.supports(order_pairs(t), t("part").where("p_size <= 10").select(F.col("p_partkey").alias("entity")), "d30")


SIGNAL_SQL = " ".join(f"WHEN regexp_matches(sentence, '{p}') THEN '{name}'" for name, p in SIGNALS)


@query(rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+|\n{{2,}}', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS w FROM documents),
e AS (SELECT doc_id, (i - 1)::INT AS seq, w[i] AS sentence FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s))
SELECT * FROM (SELECT doc_id, seq, CASE {SIGNAL_SQL} END AS signal FROM e) WHERE signal IS NOT NULL""")
def event_signals_first_match(t):
    return events.first_signals(t("documents"), SIGNALS, "doc_id", "text")


@query("SELECT event_type, reason, count(*) AS n FROM (SELECT event_type, CASE WHEN value IS NULL THEN 'no_value' WHEN value < 10 THEN 'too_small' WHEN event_type = 'error' THEN 'error' WHEN user_id % 10 = 0 THEN 'blocked_user' ELSE 'pass' END AS reason FROM events) GROUP BY ALL")
def event_gate_reasons(t):
    g = events.gate(t("events"), [("no_value", F.col("value").isNull()), ("too_small", F.col("value") < 10), ("error", F.col("event_type") == "error"), ("blocked_user", F.col("user_id") % 10 == 0)])
    return g.groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events QUALIFY rn <= 100)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM r GROUP BY event_type""")
def pack_health_last_n(t):
    return evaluation.health(t("events"), "event_type", "ts", "value", 100)


@query("""WITH r AS (SELECT source, regexp_matches(text, '[#$%&*|]{2}|!!') = false AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)), g AS (SELECT source, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn FROM r GROUP BY source)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END, 6) AS recall FROM g""")
def golden_precision_recall(t):
    rows = t("documents").join(t("labels"), "doc_id")
    return evaluation.precision_recall(rows, "source", ~F.col("text").rlike(r"[#$%&*|]{2}|!!"), F.col("quality") == 1)


@query("SELECT p_brand, arg_min(p_type, struct_pack(a := CASE p_type WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END, b := p_type)) AS p_type FROM part GROUP BY p_brand")
def priority_type_resolution(t):
    return evaluation.by_priority(t("part"), "p_brand", "p_type", ["PROMO", "LARGE"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey, upper(c_name), c_acctbal + 1 FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 22 <> 0")
def delta_merge(t):
    base = t("customer").select("c_custkey", "c_name", "c_acctbal")
    delta = base.where("c_custkey % 11 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.expr("c_custkey % 22 = 0").alias("gone"))
    return evaluation.upsert(base, delta, "c_custkey", "gone")


@query("""SELECT k, greatest(a, b) AS score, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS sources FROM (SELECT c_nationkey AS k, max(c_acctbal) AS a FROM customer WHERE c_nationkey < 18 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, max(s_acctbal) AS b FROM supplier WHERE s_nationkey > 5 GROUP BY 1) USING (k)""")
def seed_full_outer_merge(t):
    a = t("customer").where("c_nationkey < 18").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("score"))
    b = t("supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("score"))
    return evaluation.merge_seeds(a, b, "k")


@query("SELECT p_brand, count(DISTINCT p_type) AS n_values FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def fd_violation_check(t):
    return evaluation.dependency_violations(t("part"), "p_brand", "p_type")


@query("SELECT route, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_totalprice, CASE WHEN o_totalprice <= 0 THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderpriority LIKE '1%' THEN 'accepted' ELSE 'review' END AS route FROM orders) GROUP BY route")
def routed_sink_counts(t):
    r = evaluation.routed(t("orders"), [("rejected", F.col("o_totalprice") <= 0), ("accepted", (F.col("o_orderstatus") == "F") | F.startswith("o_orderpriority", F.lit("1")))], "review")
    return r.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT conv_id, turn, max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::INT AS before FROM conversations")
def surname_running_max(t):
    return evaluation.running_maximum(t("conversations"), "conv_id", "turn", F.length("text")).select("conv_id", "turn", "before")


@query("SELECT event_type, count(*) AS n, count(DISTINCT ts::DATE) AS days FROM events GROUP BY event_type")
def stream_windowed_counts(t):
    stream = windows.file_stream(t("events"))
    w = windows.run_available(windows.windowed_counts(stream), "complete")
    return w.groupBy("event_type").agg(F.sum("n").alias("n"), F.countDistinct("start").alias("days"))


@query()
def news_analyze(t):
    return impact.analyze(t("documents"), phrases(t), impact.market_edges(t("nation"), t("customer")), SIGNALS)
