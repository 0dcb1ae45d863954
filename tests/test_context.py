"""Graph context over tables with many distinct pairs, and by brute force over odd seeds and links."""

import itertools
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae import catalog
from tesserae.operators import context, linked, resolution

QUERIES = ("context_pair_supports", "context_seed_decisions", "context_related_entities", "context_refined_scores")
LINES = 12_000


@pytest.fixture(scope="module")
def many_pairs(tmp_path_factory):
    """2,000 orders of six lines over 300 suppliers, most of which share a few parts."""
    out = tmp_path_factory.mktemp("many_pairs")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT (i // 6)::BIGINT AS l_orderkey, (hash(i) % 300)::BIGINT AS l_suppkey, (hash(i + {LINES}) % 400)::BIGINT AS l_partkey FROM range({LINES}) t(i)")
    con.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey, (i % 25)::INT AS s_nationkey FROM range(300) t(i)")
    con.execute("CREATE TABLE nation AS SELECT i::INT AS n_nationkey, (i % 5)::INT AS n_regionkey FROM range(25) t(i)")
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"COPY {t} TO '{out}/{t}.parquet' (FORMAT parquet)")
    return str(out), con


@pytest.mark.parametrize("name", QUERIES)
def test_no_row_is_shuffled_for_a_pair_and_a_link(spark, many_pairs, name):
    sf, con = many_pairs
    sc = spark.sparkContext
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    sc.setJobGroup(name, name)
    try:
        df = catalog.queries()[name](spark, sf)
        got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    finally:
        sc.setJobGroup("", "")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(name) for s in sc.statusTracker().getJobInfo(j).stageIds}
    shuffled = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    wanted = con.execute(f"SELECT {', '.join(f'"{c}"' for c in sorted(df.columns))} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(got) == sorted(wanted)
    assert 0 < shuffled < 12 * LINES


@pytest.fixture(scope="module")
def odd():
    """Seeds: one to 40 a document, rows twice with other scores, ids without links. Links: to seeds, to itself, to a node that
    is an ancestor too, without a degree, the same twice; null ids."""
    r = random.Random(5)
    ids = [f"e{i}" for i in range(45)]
    seeds = [(d, q, r.randrange(100) / 100, r.randrange(100) / 100) for d in range(60) for q in r.sample(ids, 40 if d % 20 == 7 else r.randrange(1, 7))]
    seeds += [(d, q, r.randrange(100) / 100, 0.5) for d, q, *_ in r.sample(seeds, 40)] + [(None, "e1", 0.1, 0.1), (3, None, 0.1, 0.1), (3, "stranger", 0.9, 0.9)]
    near = [(q, n, r.randrange(1, 21) / 20) for q in ids[:-3] for n in r.sample(ids + [f"n{i}" for i in range(30)], 8)] + [("e1", None, 0.5)]
    near += [(q, n, w / 2) for q, n, w in near[:50]] + [("e1", "e1", 1.0), ("e2", "top", 0.4), ("e3", "top", 0.7)]
    up = [(q, a) for q in ids[:-5] for a in ("top", f"a{r.randrange(4)}")] * 2 + [("e4", None)]
    degrees = {n: r.choice([1, 4, 5, 16, 17, 48, 49, 64, 65, 128, 129, 256, 257]) for n in [*ids, "top", "a1", "a2", "a3", *(f"n{i}" for i in range(20))]}
    return seeds, near, up, degrees


def brute(odd):
    seeds, near, up, degrees = odd
    spec = lambda n: next((v for m, v in ((4, 1.0), (16, 0.82), (64, 0.58), (256, 0.32)) if degrees.get(n, 0) <= m), 0.12)
    weight = {}
    for q, n, w in near:
        weight.setdefault(q, {}).update({n: max(w, weight.get(q, {}).get(n, 0))})
    above = {q: {a for p, a in up if p == q and a} for q, _ in up}
    docs = {}
    for d, q, local, base in seeds:
        if d is not None and q is not None:
            old = docs.setdefault(d, {}).get(q, (0, 0))
            docs[d][q] = max(local, old[0]), max(base, old[1])
    docs = {d: dict(sorted(x.items(), key=lambda i: (-i[1][0], i[0]))[:24]) for d, x in docs.items()}

    def score(a, b):
        wa, wb = weight.get(a, {}), weight.get(b, {})
        direct = 0.75 * max(wa.get(b, 0), wb.get(a, 0))
        shared = sum(min(wa[n], wb[n]) * spec(n) for n in wa.keys() & wb.keys() if n and n not in (a, b))
        return min(1.0, direct + min(shared, 0.75) + min(sum(0.3 * spec(n) for n in above.get(a, set()) & above.get(b, set())), 0.4))

    return docs, weight, above, spec, {p: score(*p) for x in docs.values() for p in itertools.combinations(sorted(x), 2)}


@pytest.fixture(scope="module")
def tables(spark, odd):
    seeds, near, up, degrees = odd
    found = linked.links(
        spark.createDataFrame(near, "qid string, neighbour string, weight double"), spark.createDataFrame(up, "qid string, ancestor string"),
        spark.createDataFrame(list(degrees.items()), "node string, degree_total long"),
    )
    return spark.createDataFrame(seeds, "doc long, qid string, local double, baseline double"), *found


def test_pair_supports_of_odd_seeds(tables, odd):
    got = {(r.left, r.right): r.score for r in context.pair_supports(*tables[:2]).collect()}
    wanted = brute(odd)[-1]
    assert got.keys() == wanted.keys()
    assert all(abs(got[p] - wanted[p]) < 1.1e-6 for p in wanted)


def test_decisions_of_odd_seeds(tables, odd):
    docs, *_, score = brute(odd)
    got = {(r.doc, r.qid): r for r in context.seed_decisions(*tables[:2]).collect()}
    assert got.keys() == {(d, q) for d, x in docs.items() for q in x}
    for (d, q), r in got.items():
        peers = [round(score[tuple(sorted((q, p)))], 6) for p in docs[d] if p != q]
        assert (r.seeds, r.supporting, r.baseline) == (len(docs[d]), sum(s >= 0.12 for s in peers), docs[d][q][1])
        assert abs(r.mean_peer_support - sum(peers) / max(len(peers), 1)) < 2e-6


def test_related_entities_of_odd_seeds(tables, odd):
    docs, weight, above, spec, _ = brute(odd)
    degrees = odd[3]
    pen = lambda n: next((v for m, v in ((16, 0.0), (48, 0.04), (128, 0.08), (256, 0.12)) if degrees.get(n, 0) <= m), 0.18)
    strong = context.seed_decisions(*tables[:2]).withColumn("strong", F.lit(True))
    got = {(r.doc, r.qid): (r.seeds, r.score, r["rank"]) for r in context.related_entities(strong, tables[2]).collect()}
    wanted = {}
    for d, x in docs.items():
        ways = {}
        for q in x:
            for n, w in weight.get(q, {}).items():
                ways.setdefault(n, []).append((q, w, 1))
            for n in above.get(q, ()):
                ways.setdefault(n, []).append((q, 0.3, 2))
        best = []
        for n, way in ways.items():
            k, kinds = len({q for q, *_ in way}), {s for *_, s in way}
            if n and n not in x and k >= 2:
                bonus = min(0.36, (k - 1) * 0.18) + (0.08 if 1 in kinds else 0.04) + (0.06 if len(kinds) == 2 else 0)
                s = (sum(w for _, w, _ in way) + bonus) * spec(n) - pen(n) - ((0.06 if k <= 2 else 0.03) if kinds == {2} else 0)
                best.append((-round(max(0.0, min(1.0, s)), 6), n, k))
        wanted |= {(d, n): (k, -s, i) for i, (s, n, k) in enumerate(sorted(b for b in best if b[0] < 0)[:5], 1)}
    assert got == wanted


def test_documents_cut_by_batches_are_whole(monkeypatch):
    monkeypatch.setattr(linked, "ROWS", 7)
    r = random.Random(2)
    rows = sorted((d, f"q{r.randrange(60):02}", r.random(), 0.5) for d in range(12) for _ in range(300 if d == 5 else 4))
    t = pa.table(dict(zip(("doc", "qid", "local", "baseline"), map(list, zip(*rows, strict=True)), strict=True)))
    parts = list(linked.whole_documents(iter(t.to_batches(max_chunksize=3)), 24))
    got = {}
    for i, p in enumerate(parts):
        for x in p.to_pylist():
            assert got.setdefault((x["doc"], x["qid"]), (i, x["local"])) == (i, x["local"])
    best = {}
    for d, q, v, _ in rows:
        best.setdefault(d, {})[q] = max(v, best[d].get(q, 0)) if d in best else v
    wanted = {(d, q): v for d, x in best.items() for q, v in sorted(x.items(), key=lambda i: (-i[1], i[0]))[:24]}
    assert {k: v for k, (_, v) in got.items()} == wanted
    assert all(len({i for (e, _), (i, _) in got.items() if e == d}) == 1 for d in best)


def test_rounded_is_sparks_round_and_steps_are_its_degrees(spark):
    import numpy as np

    x = [0.5122125, 0.51221249999999993, 0.0000005, 1.0000015, 0.1, 0.0, 2.6750005, 0.12, 0.3333333333]
    assert linked.rounded(np.array(x)).tolist() == [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    d = F.col("d")
    for r in spark.createDataFrame([(i,) for i in range(300)], "d long").select(linked.degree_step(d), resolution.degree_specificity(d), resolution.degree_penalty(d)).collect():
        assert (linked.SPECIFIC[r[0]], linked.PENALTY[r[0]]) == (r[1], r[2])
