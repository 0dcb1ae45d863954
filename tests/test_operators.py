"""Small fixtures for operators that SQL cannot check, and for edge cases."""

import hashlib
import itertools
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae import catalog
from tesserae.functions import articles, normalise
from tesserae.functions import text as T
from tesserae.operators import context, dictionary, evaluation, events, graph, heuristics, mentions, resolution, vectors
from tesserae.sources import files
from tesserae.streaming import windows

from tests.conftest import SF


def test_overlaps_against_all_subsets(spark):
    r = random.Random(3)
    spans = []
    for doc in range(6):
        for i in range(8):
            start = r.randrange(20)
            spans.append((doc, start, start + r.randint(1, 6), float(r.randint(1, 9))))
    df = spark.createDataFrame(spans, "doc_id long, start long, end long, score double")
    got = {}
    for row in mentions.resolve_overlaps(df).collect():
        got.setdefault(row.doc_id, []).append(row)
    for doc in range(6):
        own = [s for s in spans if s[0] == doc]
        best = 0.0
        for k in range(len(own) + 1):
            for subset in itertools.combinations(own, k):
                ordered = sorted(subset, key=lambda s: s[1])
                if all(a[2] <= b[1] for a, b in itertools.pairwise(ordered)):
                    best = max(best, sum(s[3] for s in subset))
        chosen = sorted(got[doc], key=lambda s: s.start)
        assert all(a.end <= b.start for a, b in itertools.pairwise(chosen))
        assert sum(s.score for s in chosen) == best


def test_offsets_point_back(spark):
    source = "<p>Fish &amp;  chips</p>\n<b>café ﬁn</b>"
    row = spark.createDataFrame([(source,)], "s string").select(T.visible_with_offsets("s").alias("m")).first().m
    assert row.text == "Fish & chips café fin"
    at = row.text.index("&")
    assert source[row.raw_start[at] : row.raw_end[at]] == "&amp;"
    assert len(row.text) == len(row.raw_start) == len(row.raw_end)


def test_lookup_keys(spark):
    df = spark.createDataFrame([("Straße “X”",), (None,), ("",)], "t string").select(T.lookup_key("t").alias("k"))
    assert [r.k for r in df.collect()] == ['strasse "x"', None, ""]


def test_segments_are_bounded_and_whole(spark):
    text = " ".join(f"word{i}" + ("." if i % 9 == 0 else "") for i in range(3000))
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(T.segments("t")).alias("s")).select("s.*").collect()
    assert sum(r.tokens for r in rows) == 3000
    assert all(r.tokens <= 800 and r.end - r.start <= 4000 for r in rows)


def test_expand_rejects_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "r", 0.9), ("b", "a", "r", 0.9), ("b", "c", "r", 0.5)], "src string, dst string, relation string, confidence double")
    rows = graph.expand_paths(edges, spark.createDataFrame([("a",)], "node string"), depth=3).collect()
    assert {(r.node, r.hops, r.confidence) for r in rows} == {("b", 1, 0.81), ("c", 2, 0.375)}


def test_gate_null_is_no_reason(spark):
    df = spark.createDataFrame([(None,), (1,), (20,)], "v int")
    rows = events.gate(df, [("small", F.col("v") < 10)]).collect()
    assert [r.reason for r in rows] == ["pass", "small", "pass"]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_bytes(b"<p>x</p>")
    (tmp_path / "in/b.txt").write_bytes(b"caf\xe9 ok")
    (tmp_path / "in/c.out.json").write_text("{}")
    found = files.text_files(spark, str(tmp_path / "in"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(rows) == {"a.html", "b.txt"}
    assert rows["a.html"].content_type == "text/html"
    assert rows["b.txt"].text == "caf� ok"
    assert [r.status for r in files.limited(found, 1, 10**9).orderBy("path").collect()] == ["taken", "max_files"]
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    files.write_routes(df, [("zero", F.col("v") == 0), ("one", F.col("v") == 1)], "rest", str(tmp_path / "out"))
    counts = {r.route: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("route").count().collect()}
    assert counts == {"zero": 4, "one": 3, "rest": 3}


def test_json_lines_keep_corrupt_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n')
    rows = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert sorted((r.a is None, r.corrupt) for r in rows) == [(False, None), (True, "not json")]


def test_mapped_rejects_with_reason(spark):
    df = spark.createDataFrame([("x", ""), ("y", "2")], "a string, b string")
    rows = files.mapped(df, {"name": "a", "value": "b"}, {}, ["name", "value"]).collect()
    assert [r.reject_reason for r in rows] == ["missing_value", None]


@pytest.mark.parametrize("text,wanted", [("Bank of New York", "BNY"), ("x", None)])
def test_initialism(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(T.initialism(F.col("t")).alias("i")).first().i == wanted


def test_acronym_definitions(spark):
    texts = [
        (1, "The Bank of New York (BNY) said so. BNY rose; BNYX did not. BNY."),
        (2, "A Red Cat (RC) met a Rusty Can (RC)."),  # two meanings: none
        (3, "nothing here (XY)"), (4, None), (5, ""),
    ]
    rows = heuristics.acronym_definitions(spark.createDataFrame(texts, "id long, t string"), "id", F.col("t")).collect()
    assert [tuple(r) for r in rows] == [(1, "BNY", "Bank of New York", 2)]


def test_registered_definitions_are_all_found(spark):
    from tesserae import catalog_resolution as c

    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    assert c.acronym_definitions(t).count() >= 0.8 * t("benchmark").count()


def test_structured_names_and_prefixes(spark):
    df = spark.createDataFrame([(1, "the Grand Oak University and Oak University, Grand Oak University. Paris-based"), (2, None)], "id long, t string")
    rows = heuristics.structured_names(df, "id", F.col("t"), ("University", "Agency")).collect()
    assert {(r.surface, r.start) for r in rows} == {("Grand Oak University", 4), ("Oak University", 29)}
    aliases = spark.createDataFrame([("paris", "city")], "key string, kind string")
    assert [tuple(r) for r in heuristics.hyphen_prefixes(df, "id", F.col("t"), aliases).select("id", "key", "kind").collect()] == [(1, "paris", "city")]


def test_covered_ties_and_repeats(spark):
    spans = [(1, 0, 5, "a"), (1, 0, 5, "a"), (1, 1, 4, "b"), (1, 0, 3, "c"), (1, 3, 6, "d"), (2, 1, 4, "e")]
    rows = heuristics.covered(spark.createDataFrame(spans, "doc long, start long, end long, surface string"), "doc").collect()
    assert sorted({(r.surface, r.covered) for r in rows}) == [("a", False), ("b", True), ("c", True), ("d", False), ("e", False)]


def test_resolution_cascade(spark):
    ix = spark.createDataFrame([("n", "1", 10), ("n", "2", 11), ("n", "2", 12), ("b", "x", 13)], "kind string, key string, id int")
    refs = spark.createDataFrame([("r1", "b", "x"), ("r1", "n", "1"), ("r2", "n", "2"), ("r2", "b", "x"), ("r3", "n", "9")], "ref string, kind string, key string")
    rows = resolution.resolve(refs, "ref", resolution.unambiguous(ix, "id"), "id", ["n", "b"]).collect()
    assert sorted(map(tuple, rows)) == [("r1", 10, "n"), ("r2", 13, "b")]


def test_runs_with_nulls(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")]
    got = resolution.runs(spark.createDataFrame(rows, "k int, o int, v string"), "k", ["o"], "v").orderBy("run").collect()
    assert [(r.v, r.n) for r in got] == [("a", 2), (None, 2), ("a", 1)]


def test_articles(spark):
    long = " ".join(["word"] * 90)
    declared = f'<script type="application/ld+json">{{"articleBody": "{long} end"}}</script><p>x</p>'
    df = spark.createDataFrame([(1, declared), (2, f"<P class=a>{long}</P>\n<p>more</p>"), (3, "<p>short</p>"), (4, None)], "id int, html string")
    got = {r.id: r.t for r in df.select("id", articles.article_text(F.col("html")).alias("t")).collect()}
    assert got == {1: f"{long} end", 2: f"{long} more", 3: None, 4: None}


def test_record_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": {"rows": [{"x": 1},\n {"x": 2}]}}')
    rows = files.json_records(spark, str(tmp_path / "a.json"), "data struct<rows: array<struct<x: int>>>", "data.rows").collect()
    assert [r.x for r in rows] == [1, 2]
    (tmp_path / "b.nt").write_text('<http://e/Q1> <http://p/P31> <http://e/Q2> .\n<http://e/Q1> <http://p/P2> "text" .\n<http://e/Q3> <http://p/P5> <http://e/Q1> .\n')
    assert [tuple(r) for r in files.triples(spark, str(tmp_path / "b.nt"), ["P31"]).collect()] == [("Q1", "P31", "Q2")]
    assert files.triples(spark, str(tmp_path / "b.nt")).count() == 2
    (tmp_path / "c.obo").write_text("format: 1\n\n[Term]\nid: A:1\nname: one\nsynonym: uno\nsynonym: ein\n\n[Term]\nid: A:2\nname: two\n\n[Typedef]\nid: T\nname: no\n")
    got = sorted(tuple(r) for r in files.stanzas(spark, str(tmp_path / "c.obo"), "Term", ["id", "name"], ["synonym"]).where("id like 'A:%'").collect())
    assert got == [("A:1", "one", ["uno", "ein"]), ("A:2", "two", [])]
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("k1.json", "{}")
        z.writestr("k2.json", "[]")
    wanted = spark.createDataFrame([("k2.json",), ("k9.json",)], "name string")
    assert [(r.name, r.text) for r in files.zip_members(spark, str(tmp_path), wanted).collect()] == [("k2.json", "[]")]


def test_headers_nested_records_and_vectors(spark, tmp_path):
    df = spark.createDataFrame([("", "A", "x"), ("b", "B", "y")], "`Act Symbol` string, SYMBOL string, name string")
    got = [tuple(r) for r in files.coalesced(df, {"ticker": ["act symbol", "symbol"], "title": ["name"], "gone": ["nowhere"]}).collect()]
    assert got == [("A", "x", None), ("b", "y", None)]
    nested = spark.createDataFrame([(1, [(5,), (6,)]), (2, [])], "id int, parts array<struct<v: int>>")
    assert [tuple(r) for r in files.flattened(nested, ["id"], "parts").collect()] == [(1, 0, 5), (1, 1, 6)]
    files.write_vectors(spark.range(50).select((49 - F.col("id")).alias("id"), F.array(F.lit(1.0)).alias("vector")), str(tmp_path / "v"))
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "v").glob("part-*"))
    assert spark.read.json(str(tmp_path / "v")).count() == 50


def test_deltas_and_matches(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.25)], "k string, v double")
    b = spark.createDataFrame([("y", 0.5), ("z", 0.5)], "k string, v double")
    assert {r.k: r.delta for r in evaluation.deltas(a, b, "k", "v").collect()} == {"x": 0.5, "y": 0.25, "z": -0.5}
    e = spark.createDataFrame([(1, "p"), (1, "q"), (1, "q")], "g int, i string")
    o = spark.createDataFrame([(1, "q"), (1, "r"), (2, "s")], "g int, i string")
    assert sorted(map(tuple, evaluation.match_counts(e, o, "g", "i").collect())) == [(1, 1, 1, 1), (2, 0, 0, 1)]


def test_normalisation(spark):
    rows = [("U. S. A.", "Ann van der Lee", "2020", "http://x/Q12", "0.7", "us"), ("U.S.A.", "Ann Lee", "31/12/2021", "wd:q3", "7", "42"), ("Mr. X.", None, "20220105", "Q", "-1", "--"), (None, "A B C D E", "soon", None, "n/a", "good one")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    out = df.select(
        normalise.undotted(F.col("a")), normalise.first_last(F.col("b")), normalise.day_of(F.col("c")).cast("string"), normalise.qid(F.col("d")),
        normalise.clamped(F.col("e"), 0.5), normalise.alias_drop_reason(F.col("f"), ("us",)),
    ).collect()
    assert [r[0] for r in out] == ["USA", "USA", "Mr. X.", None]
    assert [r[1] for r in out] == ["Ann Lee", None, None, None]
    assert [r[2] for r in out] == ["2020-01-01", "2021-12-31", "2022-01-05", None]
    assert [r[3] for r in out] == ["Q12", "Q3", None, None]
    assert [r[4] for r in out] == [0.7, 1.0, 0.0, 0.5]
    assert [r[5] for r in out] == ["stop_list", "number", "no_letter_or_digit", None]


def test_stream_deduplication(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 2)]
    spark.createDataFrame(rows, "t string, k int").select(F.col("t").cast("timestamp").alias("ts"), "k").write.parquet(str(tmp_path / "r.parquet"))
    stream = windows.file_stream(spark.read.parquet(str(tmp_path / "r.parquet")))
    assert sorted(r.k for r in windows.run_available(windows.deduplicated(stream, "k"), "append").collect()) == [1, 2]


def test_document_window_counts_against_brute_force(spark):
    split = re.compile(r"[^a-z0-9à-öø-ÿß]+")
    wanted = {n: [0, set()] for n in (1, 2, 3)}
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        w = [x for x in split.split((row.text or "").lower()) if x]
        for n, found in wanted.items():
            windows_ = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
            found[0] += len(windows_)
            found[1].update(windows_)
    got = {r.n: (r.windows, r.surfaces) for r in catalog.queries()["document_window_counts"](spark, SF).collect()}
    assert got == {n: (k, len(s)) for n, (k, s) in wanted.items()}


def test_degree_summary(spark):
    r = random.Random(4)
    for n in (1, 19, 20, 21, 100, 137):
        degrees = sorted(r.randint(1, 40) for _ in range(n))
        got = graph.degree_summary(spark.createDataFrame([(d,) for d in degrees], "degree_total long")).first()
        assert tuple(got) == (n, degrees[-1], pytest.approx(sum(degrees) / n, abs=1e-4), degrees[-(-95 * n // 100) - 1])


def test_customer_expansion_against_brute_force(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    edges = [(f"r{x.n_regionkey}", "contains", f"n{x.n_nationkey}", 0.9) for x in read("nation").collect()]
    for x in read("customer").collect():
        edges += [(f"n{x.c_nationkey}", "serves", f"c{x.c_custkey}", 0.5 + 0.01 * (x.c_custkey % 40)), (f"c{x.c_custkey}", "buys", f"m{x.c_mktsegment}", 0.8)]
    out = {}
    for e in sorted(edges, key=lambda e: (-e[3], e[2], e[1])):
        if len(out.setdefault(e[0], [])) < 64:
            out[e[0]].append(e)
    regions = {f"r{x.r_regionkey}" for x in read("region").collect()}
    paths, level = [], [((e,), e[3]) for r in regions for e in out.get(r, [])]
    while level:
        paths += level
        level = [((*p, e), min(c, e[3])) for p, c in level if len(p) < 3 for e in out.get(p[-1][2], [])]
    best, by_node = {}, {}
    for p, c in paths:
        key = (p[0][0], p[-1][2])
        best[key] = max(best.get(key, (0, 0)), (round(c * (0.9, 0.75, 0.375)[len(p) - 1], 6), -len(p)))
        by_node.setdefault(p[-1][2], []).append((len(p), -c, tuple(e[:3] for e in p)))
    wanted = set()
    for seed in regions:
        reached = sorted((-c, -h, node) for (s, node), (c, h) in best.items() if s == seed)
        wanted |= {(seed, node, h, -c, k + 1) for k, (c, h, node) in enumerate(reached[:25])}
    assert {(x.seed, x.node, x.hops, x.confidence, x["rank"]) for x in catalog.queries()["impact_expand_customers"](spark, SF).collect()} == wanted
    got = {(x.node, x["rank"]): (x.hops, -x.confidence, tuple(map(tuple, x.path))) for x in catalog.queries()["impact_best_paths"](spark, SF).collect()}
    assert got == {(node, k + 1): p for node, found in by_node.items() for k, p in enumerate(sorted(found)[:3])}


def test_path_confidences(spark):
    """Seed confidence, clamped, times the weakest edge, times 1, .9, .75, .375, ... by depth, to 6 places."""
    assert [graph.depth_decay(h) for h in range(5)] == [1.0, 0.9, 0.75, 0.375, 0.1875]
    edges = spark.createDataFrame([(x, y, "r", c) for x, y, c in (("a", "b", 0.8), ("b", "c", 0.7), ("c", "d", 0.9))], "src string, dst string, relation string, confidence double")
    seeds = spark.createDataFrame([("a", 0.5), ("b", 7.0), ("c", None)], "node string, confidence double")
    rows = {(r.seed, r.node): r.confidence for r in graph.expand_paths(edges, seeds, depth=3).collect()}
    assert rows == {("a", "b"): 0.36, ("a", "c"): 0.2625, ("a", "d"): 0.13125, ("b", "c"): 0.63, ("b", "d"): 0.525, ("c", "d"): 0.81}


def test_health_percentile_interpolates(spark):
    df = spark.createDataFrame([("k", float(i), i, i) for i in range(1, 21)], "key string, value double, ts int, event_id int")
    r = evaluation.health(df, "key", "ts", "value", 20).first()
    assert (r.n, r.mean, r.p95) == (20, 10.5, 19.05)


def test_string_ties(spark):
    df = spark.createDataFrame([(1, "x", "wikidata:Q2", 1.0), (1, "x", "wikidata:Q1", 1.0), (1, "x", "wikidata:Q0", 0.5)], "doc int, surface string, ref string, score double")
    assert mentions.dedupe(df, ["doc", "surface"], "score", ["ref"]).first().ref == "wikidata:Q1"
    assert {r.chosen for r in mentions.consistent_surfaces(df, "doc", "surface", "ref", "score").collect()} == {"wikidata:Q1"}


def test_words_of_all_scripts(spark):
    r = spark.createDataFrame([("Łódź Αθήνα 東京 e-mail don't Q1",)], "t string").select(T.words(F.col("t")).alias("w"), T.token_count(F.col("t")).alias("n")).first()
    assert r.w == ["łódź", "αθήνα", "東京", "e", "mail", "don", "t", "q1"] and r.n == 7


def test_tagging_paths_agree(spark, monkeypatch):
    """First words compared as the text is read, or by a join, against all windows; offsets point into the raw text."""
    r = random.Random(4)
    words = ["a", "b", "c", "Dé"]
    docs = spark.createDataFrame([(i, r.choice(("", "-- ")) + " ,".join(r.choices(words, k=r.randint(0, 30)))) for i in range(40)], "doc_id long, text string")
    surfaces = {" ".join(r.choices([w.lower() for w in words], k=r.randint(1, 4))) for _ in range(25)} | {" ".join(["a"] * 9)}
    aliases = spark.createDataFrame([(s, i) for i, s in enumerate(sorted(surfaces))], "surface string, ref int")
    wanted = set()
    for d in docs.collect():
        w = re.findall(r"\w+", d.text.lower())
        wanted |= {(d.doc_id, i, n, " ".join(w[i : i + n])) for n in range(1, 9) for i in range(len(w) - n + 1) if " ".join(w[i : i + n]) in surfaces}
    text = {d.doc_id: d.text for d in docs.collect()}
    for few in (5000, 0):
        monkeypatch.setattr(dictionary, "FEW_STARTS", few)
        found = dictionary.tag_exact(docs, aliases)
        assert {(x.doc_id, x.start, x.n, x.surface) for x in found.collect()} == wanted
        for x in dictionary.with_offsets(found, docs).collect():
            assert re.findall(r"\w+", text[x.doc_id][x.raw_start : x.raw_end].lower()) == x.surface.split()
        longest = {(x.doc_id, x.start, x.n) for x in dictionary.leftmost_longest(found).collect()}
        spans = {(d, s, n) for d, s, n, _ in wanted}
        assert longest == {(d, s, n) for d, s, n in spans if not any(e == d and t <= s and t + m >= s + n and m > n for e, t, m in spans)}
    assert dictionary.tag_exact(docs, aliases.limit(0)).count() == 0


def test_cosine_blocks_are_exact(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 7 = 0")
    whole = sorted(map(tuple, vectors.top_cosine(df, q, 5).select("query_id", "rank", "vec_id", "cosine").collect()))
    for row_block, query_block in ((10, 3), (1000, 2), (7, 1000)):
        assert sorted(map(tuple, vectors.top_cosine(df, q, 5, row_block=row_block, query_block=query_block).select("query_id", "rank", "vec_id", "cosine").collect())) == whole
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    of = dict(rows)
    for i, _, j, c in whole:
        assert abs(c - round(sum(a * b for a, b in zip(of[i], of[j])) / norm(of[i]) / norm(of[j]), 6)) < 2e-6
    assert len(whole) == 5 * 9 and vectors.top_cosine(df, df.limit(0), 5).count() == 0


def test_signed_buckets(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (2, "a", -1.0)], "id long, feature string, weight double")
    got = {}
    for r in vectors.signed_feature_hash(df, "id", 16).collect():
        got.setdefault(r.id, {})[r.bucket] = r.value
    sums = {}
    for f, w in (("a", 2.0), ("b", 1.0)):
        d = hashlib.blake2b(f.encode(), digest_size=16).digest()
        at = int.from_bytes(d[:8], "big") % 16
        sums[at] = sums.get(at, 0.0) + (w if d[8] % 2 == 0 else -w)
    size = sum(v * v for v in sums.values()) ** 0.5
    assert got == {1: {k: round(v / size, 6) for k, v in sums.items()}, 2: {0: 0.0}}


def test_six_places_ties_go_up_whatever_the_noise(spark):
    # the first three are one tie, a few ulps apart
    rows = [(0.5122125,), (0.51221249999999993,), (0.51221250000000011,), (0.51221249,), (-0.0000005,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(context.six_places(F.col("x"))).collect()]
    assert got == [0.512213, 0.512213, 0.512213, 0.512212, -0.000001, None]
