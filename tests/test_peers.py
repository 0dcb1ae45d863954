"""Decisions on all seeds of documents with all their links, by SQL and by brute force over odd seeds and links."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import catalog
from tesserae.operators import context, linked, peers


def test_decisions_take_every_part_and_every_seed(spark, tmp_path):
    """Suppliers of more than 24 parts, and an order of 40 suppliers."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT CASE WHEN i < 40 THEN 0 ELSE 1 + i // 5 END AS l_orderkey, CASE WHEN i < 40 THEN i ELSE (hash(i) % 40)::BIGINT END AS l_suppkey,
        (hash(i + 9000) % 120)::BIGINT AS l_partkey FROM range(3000) t(i)""")
    con.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey, (i % 25)::INT AS s_nationkey FROM range(40) t(i)")
    con.execute("CREATE TABLE nation AS SELECT i::INT AS n_nationkey, (i % 5)::INT AS n_regionkey FROM range(25) t(i)")
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    assert con.execute("SELECT min(n) FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey)").fetchone()[0] > 24
    sql = catalog.oracle_sql()["context_seed_decisions"]
    assert "<= 24" not in sql and "<= 24" in catalog.oracle_sql()["context_refined_scores"]
    df = catalog.queries()["context_seed_decisions"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({sql})").fetchall())


@pytest.mark.parametrize("dealt", [0, 6, 300])
def test_supports_of_odd_seeds(spark, monkeypatch, dealt):
    """One to 40 seeds a document, rows twice, ids without links, links to seeds and to itself, a node that is an ancestor too;
    nodes' pairs made from their links, or from documents."""
    monkeypatch.setattr(peers, "DEALT", dealt)
    r = random.Random(8)
    ids = [f"e{i}" for i in range(45)]
    seeds = [(d, q, r.random(), r.random()) for d in range(30) for q in r.sample(ids, 40 if d == 7 else r.randrange(1, 7))]
    seeds += r.sample(seeds, 20) + [(None, "e1", 0.1, 0.1), (3, None, 0.1, 0.1), (3, "stranger", 0.9, 0.9), (3, "nobody", 0.9, 0.9)]
    near = [(q, n, r.randrange(1, 21) / 20) for q in ids[:-3] for n in r.sample(ids + [f"n{i}" for i in range(30)], 8)]
    near += [(q, n, w / 2) for q, n, w in near[:50]] + [("e1", None, 0.5), (None, "e1", 0.5), ("e1", "e1", 1.0), ("e2", "top", 0.4), ("e3", "top", 0.7)]
    up = [(q, a) for q in ids[:-5] for a in ("top", f"a{r.randrange(4)}")] * 2 + [("e4", None)]
    degrees = {n: r.choice([1, 4, 5, 16, 17, 64, 65, 256, 257]) for n in [*ids, "top", *(f"a{i}" for i in range(4)), *(f"n{i}" for i in range(30))]}
    spec = lambda n: next((v for m, v in ((4, 1.0), (16, 0.82), (64, 0.58), (256, 0.32)) if degrees[n] <= m), 0.12)
    weight, above, docs = {}, {}, {}
    for q, n, w in near:
        if q and n:
            weight.setdefault(q, {})[n] = max(w, weight.get(q, {}).get(n, 0))
    for q, a in up:
        if a:
            above.setdefault(q, set()).add(a)
    for d, q, *_ in seeds:
        if d is not None and q:
            docs.setdefault(d, set()).add(q)

    def score(a, b):
        wa, wb = weight.get(a, {}), weight.get(b, {})
        shared = sum(min(wa[n], wb[n]) * spec(n) for n in wa.keys() & wb.keys() if n not in (a, b))
        return round(min(1.0, 0.75 * max(wa.get(b, 0), wb.get(a, 0)) + min(shared, 0.75) + min(sum(0.3 * spec(n) for n in above.get(a, set()) & above.get(b, set())), 0.4)), 6)

    scores = {(d, *p): score(*p) for d, x in docs.items() for p in itertools.permutations(x, 2)}
    tables = [(seeds, "doc long, qid string, local double, baseline double"), ([(q,) for q in {s[1] for s in seeds} if q], "qid string"), (near, "qid string, neighbour string, weight double"),
              (up, "qid string, ancestor string"), (list(degrees.items()), "node string, degree_total long")]
    got = {(x.doc, x.qid): x for x in peers.supports(*(spark.createDataFrame(*t) for t in tables)).collect()}
    assert got.keys() == {(d, q) for d, x in docs.items() for q in x}
    for (d, q), x in got.items():
        own = [scores[d, q, p] for p in docs[d] if p != q]
        assert (x.seeds, x.supporting) == (len(docs[d]), sum(s >= 0.12 for s in own))
        assert abs(x.sum - sum(own)) < 1.1e-6 * len(own) + 1e-9
    assert len(context.whole_decisions(*(spark.createDataFrame(*t) for t in tables)).where("action IS NULL").collect()) == 0


def test_refined_scores_make_a_decision_once(spark):
    """No condition of the decision stands in the plan, where the filter would make its sums again."""
    plan = catalog.queries()["context_refined_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "decimal(20,12)" not in plan


def test_links_travel_as_bytes(spark):
    near, up = spark.createDataFrame([("a", "b", 0.5)], "qid string, neighbour string, weight double"), spark.createDataFrame([("a", "c")], "qid string, ancestor string")
    found = linked.links(near, up, spark.createDataFrame([("b", 5)], "node string, degree_total long"))[0]
    assert {found.schema[c].dataType.simpleString() for c in ("nodes", "steps", "weights")} == {"binary"}
    rows = {r.qid: (np.frombuffer(r.nodes, "int32").tolist(), np.frombuffer(r.steps, "int8").tolist(), np.frombuffer(r.weights).tolist()) for r in found.collect() if r.nodes}
    assert rows == {"a": ([1, 2], [1, linked.UP], [0.5, 0.3])}


def test_six_places_as_spark_rounds(spark):
    x = [0.1234565, 0.12345649999999, 0.1234564999999999, -0.06, 0.0, 0.25 / 3, 1 / 3, 0.0000005, 0.9999995]
    assert linked.six_places(np.array(x)).tolist() == [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(context.six_places(F.col("x"))).collect()]
