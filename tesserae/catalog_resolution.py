"""Registered queries over heuristic candidates, entity resolution, page articles, validation and evaluation deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import articles, normalise
from tesserae.operators import cooccurrence, dictionary, evaluation, graph, heuristics, mentions, resolution
from tesserae.registry import query
from tesserae.streaming import windows

CONNECTORS_SQL = "('of', 'the', 'and', 'for', 'de', 'la')"
LETTERS_SQL = r"list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
HEADS = ("the", "der", "la", "el")


def defining_texts(t: Callable) -> DataFrame:
    """Benchmark texts after a definition of the initials of their first four words, and followed by them."""
    w = F.slice(F.filter(F.split("text", r"[^\p{L}]+"), lambda x: x != ""), 1, 4)
    name = F.array_join(F.transform(w, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 99))), " ")
    initials = F.array_join(F.transform(F.filter(w, lambda x: ~F.lower(x).isin(*heuristics.CONNECTORS)), lambda x: F.upper(F.substring(x, 1, 1))), "")
    return t("benchmark").select("item_id", F.concat(name, F.lit(" ("), initials, F.lit("). "), "text", F.lit(" "), initials).alias("text"))


@query()
def acronym_definitions(t):
    return heuristics.acronym_definitions(defining_texts(t), "item_id", F.col("text"))


NAMES_SQL = rf"((?:\p{{Lu}}\p{{L}}+ ){{1,3}}(?:{'|'.join(HEADS)}))[^\p{{L}}]"


@query(rf"""WITH f AS (SELECT doc_id, regexp_extract_all(text || chr(10), '{NAMES_SQL}', 0) AS m, regexp_extract_all(text || chr(10), '{NAMES_SQL}', 1) AS s, regexp_split_to_array(text || chr(10), '{NAMES_SQL}') AS gaps FROM documents),
g AS (SELECT doc_id, s[i] AS surface, list_sum(list_transform(gaps[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)::BIGINT AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f))
SELECT doc_id, lower(surface) AS key, arg_min(surface, start) AS surface, min(start) AS start FROM g GROUP BY ALL""")
def structured_names(t):
    return heuristics.structured_names(t("documents"), "doc_id", F.col("text"), HEADS)


@query("""WITH a AS (SELECT split_part(p_name, ' ', 1) AS key, count(*) AS parts FROM part GROUP BY 1)
SELECT p_partkey, key, parts FROM part JOIN a ON split_part(p_name, ' ', 1) = key""")
def hyphen_prefix_lookup(t):
    first = F.split("p_name", " ")[0]
    names = t("part").select("p_partkey", F.concat(F.initcap(first), F.lit("-based "), F.col("p_type")).alias("text"))
    aliases = t("part").groupBy(first.alias("key")).agg(F.count(F.lit(1)).alias("parts"))
    return heuristics.hyphen_prefixes(names, "p_partkey", F.col("text"), aliases)


CAPS_SQL = rf"SELECT doc_id, x AS acronym, count(*) AS n FROM (SELECT doc_id, unnest({LETTERS_SQL.format('text')}) AS x FROM documents) WHERE regexp_full_match(x, '\p{{Lu}}{{2,6}}') GROUP BY ALL"


@query(f"SELECT * FROM ({CAPS_SQL}) WHERE n < 2")
def missed_acronyms(t):
    # what was seen twice or more is known
    docs = t("documents")
    found = heuristics.missed_acronyms(docs, "doc_id", F.col("text"), docs.select("doc_id", F.lit("").alias("acronym")).limit(0))
    return heuristics.missed_acronyms(docs, "doc_id", F.col("text"), found.where("n >= 2"))


def order_spans(t: Callable) -> DataFrame:
    return t("lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("start"),
        (F.col("l_linenumber") + F.col("l_quantity") % 4 + 1).cast("long").alias("end"), F.col("l_returnflag").alias("surface"),
    )


SPANS_SQL = "SELECT l_orderkey AS doc, l_linenumber::BIGINT AS start, (l_linenumber + l_quantity % 4 + 1)::BIGINT AS \"end\", l_returnflag AS surface FROM lineitem"
COVERED_SQL = f"""s AS ({SPANS_SQL}), c AS (SELECT *, EXISTS (SELECT 1 FROM s b WHERE b.doc = a.doc AND b.start <= a.start AND b."end" >= a."end" AND b."end" - b.start > a."end" - a.start) AS covered FROM s a)"""


@query(f"WITH {COVERED_SQL} SELECT doc, start, \"end\", surface, covered FROM c")
def covered_mentions(t):
    return heuristics.covered(order_spans(t), "doc")


@query(f"""WITH {COVERED_SQL} SELECT DISTINCT doc, surface, 'generic_token' AS issue FROM c WHERE surface = 'N' UNION ALL SELECT DISTINCT doc, surface, 'name_fragment' FROM c WHERE covered""")
def mention_issues(t):
    return heuristics.mention_issues(order_spans(t), "doc", ("n",))


def supplier_refs(t: Callable) -> DataFrame:
    return resolution.identity_refs(t("supplier"), "s_suppkey", {"number": resolution.padded_digits(F.col("s_name")), "balance": F.format_string("%.2f", "s_acctbal"), "nation": F.col("s_nationkey")})


REFS_SQL = "refs AS (SELECT s_suppkey, unnest([{kind: 'number', key: lpad(regexp_replace(s_name, '[^0-9]+', '', 'g'), 10, '0')}, {kind: 'balance', key: printf('%.2f', s_acctbal)}, {kind: 'nation', key: s_nationkey::VARCHAR}], recursive := true) FROM supplier)"
INDEX_SQL = f"{REFS_SQL}, ix AS (SELECT kind, key, min(s_suppkey) AS s_suppkey FROM refs GROUP BY ALL HAVING min(s_suppkey) = max(s_suppkey))"


@query(f"WITH {REFS_SQL} SELECT s_suppkey, kind, key FROM refs")
def identity_refs(t):
    return supplier_refs(t)


@query(f"WITH {INDEX_SQL} SELECT kind, key, s_suppkey FROM ix")
def unambiguous_keys(t):
    return resolution.unambiguous(supplier_refs(t), "s_suppkey")


@query(f"""WITH {INDEX_SQL}, c AS (SELECT c_custkey, unnest([{{kind: 'number', key: lpad(regexp_replace(c_name, '[^0-9]+', '', 'g'), 10, '0'), place: 1}}, {{kind: 'balance', key: printf('%.2f', c_acctbal), place: 2}}], recursive := true) FROM customer)
SELECT c_custkey, arg_min(s_suppkey, struct_pack(a := place, b := s_suppkey)) AS s_suppkey, arg_min(kind, struct_pack(a := place, b := s_suppkey)) AS kind FROM c JOIN ix USING (kind, key) GROUP BY c_custkey""")
def issuer_resolution(t):
    refs = resolution.identity_refs(t("customer"), "c_custkey", {"number": resolution.padded_digits(F.col("c_name")), "balance": F.format_string("%.2f", "c_acctbal")})
    return resolution.resolve(refs, "c_custkey", resolution.unambiguous(supplier_refs(t), "s_suppkey"), "s_suppkey", ["number", "balance"])


@query("""WITH o AS (SELECT unnest([p_name, split_part(p_name, ' ', 1)]) AS key, p_brand AS entity, p_size / 50.0 AS score FROM part), g AS (SELECT key, entity, max(score) AS score FROM o GROUP BY ALL)
SELECT * FROM g WHERE key NOT IN (SELECT key FROM g WHERE NOT contains(key, ' ') GROUP BY key HAVING count(*) > 3)""")
def short_aliases(t):
    keys = F.explode(F.array("p_name", F.split("p_name", " ")[0])).alias("key")
    return resolution.short_aliases(t("part").select(keys, F.col("p_brand").alias("entity"), (F.col("p_size") / 50.0).alias("score")), "key", "entity")


def evidence_rows(t: Callable) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "direct").when(F.col("l_returnflag") == "N", "shallow").otherwise("inferred")
    return t("lineitem").select("l_partkey", "l_suppkey", (1 - F.col("l_discount")).alias("confidence"), kind.alias("evidence"), F.col("l_linestatus").alias("source"))


EVIDENCE_SQL = "e AS (SELECT l_partkey, l_suppkey, 1 - l_discount AS confidence, CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'N' THEN 'shallow' ELSE 'inferred' END AS evidence, l_linestatus AS source FROM lineitem)"


@query(f"""WITH {EVIDENCE_SQL} SELECT l_partkey, max(confidence) AS confidence, arg_min(evidence, CASE evidence WHEN 'direct' THEN 0 WHEN 'shallow' THEN 1 ELSE 2 END) AS evidence,
array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS mentions FROM e GROUP BY l_partkey""")
def candidate_merge(t):
    return resolution.merge_candidates(evidence_rows(t), "l_partkey")


@query(f"""WITH {EVIDENCE_SQL} SELECT l_suppkey, evidence, source, count(*) AS n, max(round(confidence * CASE evidence WHEN 'direct' THEN 1.0 WHEN 'shallow' THEN 0.92 ELSE 0.78 END::DOUBLE * CASE WHEN source = 'F' THEN 1.0 ELSE 0.94 END::DOUBLE, 6)) AS best FROM e GROUP BY ALL""")
def edge_confidence(t):
    c = resolution.edge_confidence(F.col("confidence"), F.col("evidence"), F.col("source") == "F")
    return evidence_rows(t).groupBy("l_suppkey", "evidence", "source").agg(F.count(F.lit(1)).alias("n"), F.max(c).alias("best"))


@query("""WITH d AS (SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1)
SELECT node, degree, CASE WHEN degree <= 4 THEN 1.0 WHEN degree <= 16 THEN 0.82 WHEN degree <= 64 THEN 0.58 WHEN degree <= 256 THEN 0.32 ELSE 0.12 END::DOUBLE AS specificity,
CASE WHEN degree <= 16 THEN 0.0 WHEN degree <= 48 THEN 0.04 WHEN degree <= 128 THEN 0.08 WHEN degree <= 256 THEN 0.12 ELSE 0.18 END::DOUBLE AS penalty FROM d""")
def degree_specificity(t):
    d = t("lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.countDistinct("l_suppkey").alias("degree"))
    return d.select("node", "degree", resolution.degree_specificity(F.col("degree")).alias("specificity"), resolution.degree_penalty(F.col("degree")).alias("penalty"))


@query("""WITH c AS (SELECT o_orderkey, unnest(CASE WHEN len(x) > 0 THEN x ELSE ['valid'] END) AS code FROM (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice <= 0 THEN 'no_price' END, CASE WHEN o_totalprice > 400000 THEN 'too_large' END,
CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'low' END], lambda v: v IS NOT NULL) AS x FROM orders)) SELECT code, count(*) AS n FROM c GROUP BY code""")
def validation_counters(t):
    return resolution.code_counts(t("orders"), {
        "no_price": F.col("o_totalprice") <= 0, "too_large": F.col("o_totalprice") > 400_000,
        "status": ~F.col("o_orderstatus").isin("F", "O"), "low": F.startswith("o_orderpriority", F.lit("5")),
    })


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN e < DATE '1998-01-01' THEN 'expired' WHEN e IS NOT NULL THEN 'fresh' WHEN s IS NULL THEN 'no_date' WHEN date_diff('day', s, DATE '1998-01-01') > 365 THEN 'too_old' ELSE 'fresh' END AS verdict
FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 365 END AS e, CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_orderdate::DATE END AS s FROM orders)) GROUP BY verdict""")
def source_freshness(t):
    day = F.to_date("o_orderdate")
    end, snapshot = F.when(F.col("o_orderstatus") == "F", F.date_add(day, 365)), F.when(~F.startswith("o_orderpriority", F.lit("1")), day)
    verdict = resolution.freshness(F.lit("1998-01-01").cast("date"), end, snapshot, 365)
    return t("orders").select(verdict.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


PARENTS_SQL = "h AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@query(f"""WITH RECURSIVE {PARENTS_SQL}, c(node, ancestor) AS (SELECT child, parent FROM h UNION SELECT c.node, h.parent FROM c JOIN h ON c.ancestor = h.child)
SELECT node, arg_min(r, struct_pack(a := priority, b := r)) AS root FROM c JOIN (SELECT 'r' || r_regionkey AS r, length(r_name) AS priority FROM region) ON ancestor = r GROUP BY node""")
def claimed_types(t):
    h = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    h = h.unionByName(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
    roots = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"), F.length("r_name").alias("priority"))
    return resolution.claimed_by_roots(graph.closure(h, 2), roots)


@query(f"""WITH {PARENTS_SQL}, u AS (SELECT child AS a, parent AS b FROM h UNION SELECT parent, child FROM h), l1 AS (SELECT 'r' || r_regionkey AS source, b AS node FROM region JOIN u ON a = 'r' || r_regionkey),
l2 AS (SELECT DISTINCT source, b AS node FROM l1 JOIN u ON node = a) SELECT source, node, min(hops) AS hops FROM (SELECT 'r' || r_regionkey AS source, 'r' || r_regionkey AS node, 0 AS hops FROM region UNION ALL SELECT source, node, 1 FROM l1 UNION ALL SELECT source, node, 2 FROM l2) GROUP BY ALL""")
def graph_undirected_paths(t):
    h = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    h = h.unionByName(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")))
    return graph.shortest_paths(graph.undirected(h), t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")), 2)


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, coalesce((event_type <> lag(event_type) OVER w)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM e) SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL""")
def adjacent_segments(t):
    return resolution.runs(t("events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INT AS rank FROM documents QUALIFY rank <= 20")
def top_per_source(t):
    return resolution.top_rows(t("documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 20)


@query("""SELECT p_brand AS alias_key, count(DISTINCT p_type) AS label_count, count(*) AS candidates FROM part GROUP BY 1 ORDER BY label_count DESC, candidates DESC, alias_key LIMIT 10""")
def top_collision_clusters(t):
    g = t("part").groupBy(F.col("p_brand").alias("alias_key")).agg(F.countDistinct("p_type").alias("label_count"), F.count(F.lit(1)).alias("candidates"))
    return g.orderBy(F.desc("label_count"), F.desc("candidates"), "alias_key").limit(10)


@query("""SELECT g, count(*) FILTER (e AND a) AS matched, count(*) FILTER (e AND NOT a) AS missing, count(*) FILTER (a AND NOT e) AS unexpected FROM
(SELECT l_suppkey AS g, l_partkey, bool_or(l_returnflag = 'R') AS e, bool_or(l_quantity > 25) AS a FROM lineitem GROUP BY ALL) GROUP BY g HAVING bool_or(e OR a)""")
def golden_set_matches(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("g"), "l_partkey", "l_returnflag", "l_quantity")
    return evaluation.match_counts(rows.where("l_returnflag = 'R'"), rows.where("l_quantity > 25"), "g", "l_partkey")


@query("""WITH a AS (SELECT source, avg(quality::DOUBLE) AS v FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') GROUP BY 1), b AS (SELECT source, avg(quality::DOUBLE) AS v FROM documents JOIN labels USING (doc_id) WHERE lang NOT IN ('en', 'de') GROUP BY 1)
SELECT source, round(coalesce(b.v, 1) - coalesce(a.v, 1), 6) AS delta FROM a FULL JOIN b USING (source)""")
def quality_deltas(t):
    rows = t("documents").join(t("labels"), "doc_id").select("source", "lang", "quality")
    mean = lambda keep: rows.where(keep).groupBy("source").agg(F.avg("quality").alias("v"))
    own = F.col("lang").isin("en", "de")
    return evaluation.deltas(mean(own), mean(~own), "source", "v")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), ' '), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages""")
def article_paragraphs(t):
    return t("pages").select("page_id", articles.paragraph_text(F.col("html")).alias("text"))


@query(r"""SELECT host, tier, count(*) AS pages FROM (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, CASE WHEN url IS NULL OR url = '' THEN 'unknown' WHEN host LIKE '%.test' OR host LIKE '%.example' OR host LIKE 'example.%' THEN 'test' WHEN host LIKE '%.gov' THEN 'regulator' WHEN host LIKE '%.org' THEN 'industry' ELSE 'other' END AS tier FROM pages) GROUP BY ALL""")
def source_tiers(t):
    host = articles.host(F.col("url"))
    tier = articles.source_tier(F.col("url"), [("test", r"\.test$|\.example$|^example\."), ("regulator", r"\.gov$"), ("industry", r"\.org$")])
    return t("pages").groupBy(host.alias("host"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("pages"))


@query("""SELECT event_id, greatest(1, least(5, round(value * CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.8 ELSE 0.6 END::DOUBLE * CASE WHEN ts > TIMESTAMP '2024-01-29' THEN 1.45 WHEN ts > TIMESTAMP '2024-01-23' THEN 1.2 ELSE 1.0 END::DOUBLE / 10)))::INT AS weight FROM events WHERE value IS NOT NULL""")
def record_weights(t):
    reliability = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "view", 0.8).otherwise(0.6)
    w = cooccurrence.record_weight(F.col("value") * reliability, F.col("ts"), "2024-01-30", 10.0)
    return t("events").where("value IS NOT NULL").select("event_id", w.alias("weight"))


@query("""SELECT l_suppkey, topic, round(least(1.0, sum(w) / count(*) * 0.8 + least(0.2, 0.08 * count(*))), 4) AS score FROM (SELECT l_suppkey, l_returnflag AS topic, 1 - l_discount AS w FROM lineitem) GROUP BY ALL""")
def topic_scores(t):
    rows = t("lineitem").select("l_suppkey", F.col("l_returnflag").alias("topic"), (1 - F.col("l_discount")).alias("w"))
    return mentions.topic_scores(rows, ["l_suppkey", "topic"], "w")


@query("""SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z]+', '', 'g')) || '_' || s_nationkey AS slug, 'Nation ' || upper(n_name) AS display FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def unresolved_entities(t):
    """Suppliers with a positive balance, under a slug, with their nation's name where there is one."""
    s = t("supplier").where("s_acctbal > 0").select("s_suppkey", F.concat_ws("_", F.lower(F.regexp_replace("s_name", "[^A-Za-z]+", "")), "s_nationkey").alias("slug"), F.col("s_nationkey").alias("n_nationkey"))
    return s.join(t("nation"), "n_nationkey", "left").select("s_suppkey", "slug", F.concat(F.lit("Nation "), F.upper("n_name")).alias("display"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority LIKE '1%')""")
def passive_entities(t):
    """Customers that no urgent finished order points to: candidates without a terminal."""
    urgent = t("orders").where((F.col("o_orderstatus") == "F") & F.startswith("o_orderpriority", F.lit("1")))
    return dictionary.without(t("customer").select("c_custkey", "c_name"), urgent.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS display, c_nationkey || ':' || c_mktsegment AS key, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 1 THEN 1.0 ELSE c_acctbal END::DOUBLE AS confidence,
CASE WHEN lower(c_mktsegment) IN ('machinery') THEN 'stop_list' WHEN length(c_mktsegment) < 9 THEN 'too_short' END AS drop_reason FROM customer""")
def record_normalisation(t):
    segment = F.col("c_mktsegment")
    display = F.when(segment == "BUILDING", normalise.display_name(F.col("c_name"), F.lit("currency"))).otherwise(F.col("c_name"))
    return t("customer").select(
        "c_custkey", display.alias("display"), normalise.ticker_keys(segment, F.col("c_nationkey").cast("string"))[0].alias("key"),
        normalise.clamped(F.col("c_acctbal").cast("string"), 0.5).alias("confidence"), normalise.alias_drop_reason(segment, ("machinery",), 9).alias("drop_reason"),
    )


@query("""SELECT l_suppkey, count(*) AS edges, count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'none') AS unknown FROM
(SELECT l_suppkey, CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'F' THEN 'up' WHEN l_returnflag = 'N' THEN 'none' ELSE 'down' END AS direction FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_suppkey""")
def direction_overrides(t):
    edge = F.struct(F.col("l_returnflag").alias("relation"), F.lit("down").alias("direction"))
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    changed = normalise.redirected(F.array(edge), [(F.col("o_orderstatus") == "F", "R", "up"), (F.lit(True), "N", "none")])
    d = j.select("l_suppkey", F.explode(changed).alias("e"))
    return d.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("e.direction") == "up").alias("up"), F.count_if(F.col("e.direction") == "none").alias("unknown"))


@query("""SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' OR l_returnflag = 'N' AND l_linestatus = 'F' THEN 'forbidden_pair' ELSE 'ok' END AS verdict, count(*) AS n FROM lineitem GROUP BY ALL""")
def forbidden_pairs(t):
    codes = resolution.forbidden(F.col("l_returnflag"), F.col("l_linestatus"), [("A", "O"), ("N", "F")])
    return t("lineitem").groupBy("l_returnflag", "l_linestatus", codes.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY ALL""")
def stream_sliding_counts(t):
    """Counts in windows of two days that start every day, from a stream of the events' files, run until it is drained."""
    stream = windows.file_stream(t("events"))
    return windows.run_available(windows.sliding_counts(stream, "2 days", "1 day"), "complete").select("event_type", "start", "n")
