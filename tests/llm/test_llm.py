"""The training-text operators against brute force, exact round trips and held-out labels, and on odd tables."""

import collections
import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import (
    bpe_automaton,
    common,
    exact_dedup,
    golay,
    html_extraction,
    html_training,
    language_id,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    simhash,
    token_counts,
    toxicity,
)

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "a", "A", "é É 日本語 😀", "x" * 3000, "word " * 6000, "  two  spaces ", "a<|endoftext|>b", "123 456", "— …",
    "The cat sat on the mat.\nThe cat sat on the mat.\n\tend", "one two three four five six", "one two three four five six", "\r\n\x0b\x0c\x1c x",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, null and repeated ids and rows, and extra columns with clashing names."""
    rows = [(i, t, "en" if i % 3 else None, None, i) for i, t in enumerate(ODD)] + [(None, "null id", None, "s", 1), (3, "\n\n", None, None, 3)]
    schema = "doc_id long, text string, lang string, source string, score long"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("fp", "digest", "kept", "group_size", "held_out", "key", "emitted")})
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    return df, labels


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_odd_tables(spark, odd):
    df, labels = odd
    empty, n = df.limit(0), len(ODD) + 2
    for make in (
        lambda d: quality_classifier.score(d, labels), lambda d: language_id.identify(d), lambda d: token_counts.count_tokens(d, PIECES),
        lambda d: queries.bpe.digests(d, BYTE_BPE), lambda d: simhash.near_groups(d), lambda d: exact_dedup.duplicate_groups(d),
        lambda d: quality_rules.quality(d), lambda d: toxicity.score(d, labels),
    ):
        assert make(df).count() == n
        assert make(empty).count() == 0
    assert packing.pack(df, BYTE_BPE).select("doc_id").distinct().count() == len(ODD) + 1
    assert packing.pack(empty, BYTE_BPE).count() == 0
    for keep in (exact_dedup.keep_one, simhash.keep_one, quality_rules.clean, lambda d: quality_classifier.keep_good(d, labels)):
        out = keep(df)
        assert out.columns == df.columns
        out.count()
        assert keep(empty).count() == 0


def test_odd_rows_by_value(spark, odd):
    """Rows by value: equal texts get equal results, null counts as empty, held_out is null for a null id."""
    df, labels = odd
    text_of = {r.doc_id: r.text or "" for r in df.where("doc_id is not null").collect()}
    for rows, n, k in ((quality_classifier.score(df, labels).collect(), 4, 2), (toxicity.score(df, labels).collect(), 5, 0)):
        by_text = collections.defaultdict(set)
        for r in rows:
            assert 0 <= r.score <= 1 and r.held_out == (None if r.doc_id is None else held(r.doc_id, n, k))
            by_text[text_of.get(r.doc_id)].add(r.score)
        assert all(len(v) == 1 for v in by_text.values())
    found = {r.doc_id: r for r in language_id.identify(df).collect()}
    for i, t in text_of.items():
        assert (found[i].lang_pred == "und") == (not any(map(str.isalpha, t)))
        assert found[i].held_out == held(i, 4, 2) and 0 <= found[i].score <= 1
    pieces = packing.pack(df.where("doc_id is not null").dropDuplicates(["doc_id"]), BYTE_BPE).collect()
    check_packing(pieces, text_of)
    same = collections.defaultdict(set)
    for r in simhash.near_groups(df).collect():
        same[brute_fingerprint(text_of.get(r.doc_id, "null id"))].add(r.fp)
    assert all(len(v) == 1 for v in same.values())
    rows = [r for r in exact_dedup.duplicate_groups(df).collect()]
    folded = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = collections.defaultdict(list)
    for r in rows:
        t = folded(text_of.get(r.doc_id, "null id"))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        groups[t].append(r)
    for own in groups.values():
        largest = max((r.doc_id for r in own if r.doc_id is not None), default=None)
        assert sum(r.kept for r in own) == 1
        assert all(r.keep_id == largest and r.group_size == len(own) for r in own)


def test_ids_with_two_texts(spark):
    """Rows that share an id but not a text are rows of their own."""
    one, two = " ".join(f"first{i}" for i in range(40)), " ".join(f"second{i}" for i in range(40))
    df = spark.createDataFrame([(5, one), (5, two), (6, one), (6, one), (7, two)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == [(5, one), (5, two)]
    assert sorted(map(tuple, exact_dedup.keep_one(df).collect())) == [(6, one), (7, two)]


def test_odd_pages(spark):
    body = "<article><p>One paragraph of plain words stands here.</p></article>"
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", body, 3), (3, "u", body, 3), (None, "v", body, 4), (4, "w", "\u00a0\n", 5), (5, "x", "<p>" * 4 + "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16") + "</p>", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long").withColumns({"n_chars": F.lit(1), "marginal": F.lit(2)})
    found = html_extraction.extract(df)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in found.collect() if r.page_id != 5)
    words = "One paragraph of plain words stands here."
    assert got == sorted([("1", "u", "", 0), ("2", "None", "", 0), ("3", "u", words, len(words)), ("3", "u", words, len(words)), ("None", "v", words, len(words)), ("4", "w", "", 0)])
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_no_labels_at_all(spark, odd):
    df, labels = odd
    assert {r.score for r in quality_classifier.score(df, labels.limit(0)).collect()} == {0.5}
    und = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in und} == {"und"}


def accuracy(rows, truth):
    pairs = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_quality_classifier_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    rows = queries.op1_quality_classifier(spark, SF1).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and r.predicted == (r.score >= 0.7) for r in rows)
    assert accuracy(rows, truth) > 0.95


def test_toxicity_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    assert accuracy(queries.op10_toxicity(spark, SF1).collect(), truth) > 0.85


def test_attention_gradient():
    rng = np.random.default_rng(1)
    rows = [(" ".join("abc"[k] * 3 for k in rng.integers(3, size=250)) + (" ### $$$" * 30 if y == 0 else ""), y) for y in (0, 1) * 20]
    model = quality_classifier.fit(rows, quality_classifier.Settings(epochs=20))
    p = quality_classifier.score_texts(pa.array([t for t, _ in rows]), model)
    assert ((p >= 0.5) == [y for _, y in rows]).all()


def test_attention_by_loops():
    """The classifier's forward pass, passage by passage, and the mean vectors of words, word by word."""
    rng = np.random.default_rng(3)
    s = quality_classifier.Settings()
    n = 5
    x, owner = rng.normal(size=(n, quality_classifier.N_FEATURES + s.lexical)), np.array([0, 0, 0, 1, 1])
    p = {"We": rng.normal(size=(x.shape[1], s.hidden)), "be": rng.normal(size=s.hidden), "V": rng.normal(size=(s.hidden, s.attention)), "U": rng.normal(size=(s.hidden, s.attention)), "w": rng.normal(size=s.attention), "c": rng.normal(size=s.hidden), "b": np.array(0.3)}
    got = quality_classifier.attend(x, owner, 2, p)[-1]
    for bag in (0, 1):
        hs, weights = [], []
        for i in np.flatnonzero(owner == bag):
            h = np.tanh([sum(x[i, f] * p["We"][f, k] for f in range(x.shape[1])) + p["be"][k] for k in range(s.hidden)])
            gate = [np.tanh(h @ p["V"][:, a]) / (1 + np.exp(-(h @ p["U"][:, a]))) for a in range(s.attention)]
            hs.append(h)
            weights.append(np.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        z = sum(w * h for w, h in zip(weights, hs, strict=True)) / sum(weights)
        assert np.isclose(got[bag], 1 / (1 + np.exp(-(z @ p["c"] + p["b"]))))
    counts, vectors = np.array([3, 0, 1, 7, 0]), rng.normal(size=(16, 4))
    word = rng.integers(0, 16, counts.sum())
    at = np.concatenate([[0], np.cumsum(counts)])
    wanted = [vectors[word[a:b]].mean(0) if b > a else np.zeros(4) for a, b in itertools.pairwise(at)]
    for step in (1, 3, 100):
        assert np.allclose(quality_classifier.mean_vectors(word, counts, vectors, step), wanted)


def test_ftrl_by_loops():
    """Weights after a few examples equal those of per-coordinate updates written out one by one."""
    s = toxicity.Settings(bits=10, l1=0.2, epochs=2)
    rows = [("bad words here", 1), ("good plain words here", 0), ("bad bad thing", 1), ("a plain thing", 0), ("", 0)]
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else s.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for text, y in rows:
            x = [*sorted({int(b) for b in toxicity.features(pa.array([text]), s.bits)[1]}), "bias"]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in x:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * w[i]
                n[i] += g * g
    bias, buckets, weights = toxicity.fit(rows, s)
    assert np.isclose(bias, weight("bias"))
    wanted = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert set(buckets) == set(wanted) and all(np.isclose(wanted[int(b)], w) for b, w in zip(buckets, weights, strict=True))
    texts = ["bad words here", "nothing known", ""]
    p = toxicity.score_texts(pa.array(texts), (bias, buckets, weights), s.bits)
    for t, q in zip(texts, p, strict=True):
        own = {int(b) for b in toxicity.features(pa.array([t]), s.bits)[1]}
        assert np.isclose(q, 1 / (1 + np.exp(-(bias + sum(w for i, w in wanted.items() if i in own)))))


def test_fitting_sample_is_whole_and_bounded(spark):
    texts = [(i, "x" * (100 if i % 7 else 5000)) for i in range(1, 60)] + [(3, "y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    got = common.labelled_sample(docs, labels, "quality", 4, 2, 30, 9000)
    assert len(got) <= 30 and sum(len(t) for t, _ in got) <= 9000 and {len(t) for t, _ in got} <= {1, 100, 5000}
    assert got == common.labelled_sample(docs.repartition(7), labels, "quality", 4, 2, 30, 9000)
    small = common.labelled_sample(docs, labels, "quality", 4, 2, 1000, 10**9)
    assert len(small) == sum(not held(i, 4, 2) for i in range(1, 60))


def check_packing(pieces, texts, capacity=1024):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_bin[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own)))
        at = 0
        for k, p in enumerate(own):
            assert p.start == at and p.length <= capacity and (k == 0 or p.length == capacity)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids) and (len(own) == 1 or len(own) == -(-len(ids) // capacity))
    for own in by_bin.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    total = sum(p.length for p in pieces)
    return len(by_bin) / -(-total // capacity)


def test_packing_is_whole_and_dense(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    assert check_packing(queries.op2_best_fit_packing(spark, SF1).collect(), dict(rows_of(docs))) < 1.12


def test_packing_tree(spark, docs):
    pieces = packing.pack(docs.repartition(20), BYTE_BPE, fan_in=2).collect()
    assert check_packing(pieces, dict(rows_of(docs))) < 1.2


def test_packing_carry_and_held(spark):
    """What a group keeps back of its underfull bins, and packing in the middle of a partition, cost no sequence here."""
    docs = spark.read.parquet(f"{SF1}/documents.parquet").repartition(8)
    texts = dict(rows_of(docs))
    counts = []
    for parameters in ({}, {"carry": 1 << 40}, {"carry": 16}, {"held": 20}):
        pieces = packing.pack(docs, BYTE_BPE, fan_in=2, **parameters).collect()
        check_packing(pieces, texts)
        counts.append(len({p.sequence_id for p in pieces}))
    assert counts[0] == counts[1] and counts[2] <= counts[1] + 1 and counts[3] <= 1.02 * counts[1]


def test_carry_loses_no_sequence():
    """Two groups merged with ``carry`` and without it: the emptiest bins are those that can take others' bins."""
    rng = random.Random(8)
    for _ in range(20):
        sizes = [[rng.choice((rng.randint(1, 1023), rng.randint(400, 700))) for _ in range(400)] for _ in range(4)]
        counts = []
        for carry in (64, 1 << 40):
            up, emitted = [], 0
            for own in sizes:
                bins = packing.best_fit([(n, [n]) for n in own], 1024)
                now = packing.judged(bins, 1024, 8, carry, False)
                emitted += sum(now)
                up += [(b[0], b[1]) for b, e in zip(bins, now, strict=True) if not e]
            counts.append(emitted + len(packing.best_fit(up, 1024)))
        assert counts[0] <= counts[1] + 1


def test_packing_long_white_space(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(4)
    encode = packing.encoder(BYTE_BPE)
    long = [" " * 2_000_000, "\n" * 2_000_000, " \n\t" * 300_000 + "x", "a" * 300_000, "word " * 60_000, "".join(rng.choice("ab \n.é日") for _ in range(250_000))]
    for t in long:
        assert list(encode(t)) == library.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long[:3])], "doc_id long, text string")
    check_packing(packing.pack(df, BYTE_BPE).collect(), dict(enumerate(long[:3])))


def test_best_fit_is_best_fit():
    bins = packing.best_fit([(6, "a"), (5, "b"), (4, "c"), (3, "d"), (2, "e")], 10)
    assert sorted(b[0] for b in bins) == [10, 10]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_html_held_out_pages():
    model = html_extraction.trained()
    pages = html_training.training_pages(150, seed=77)
    exact = sum(html_extraction.blocks(source, model) == wanted for source, wanted in pages)
    assert exact / len(pages) > 0.9


def test_html_real_pages(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").join(queries.op3_html_extraction(spark, SF).select("page_id", "text", "n_chars"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("<p>|</p>|</?h1>", article)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_html_formulas_and_fallback():
    model = html_extraction.trained()
    inside = [
        ("<p>The area is <math><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow></math>, as <svg viewBox='0 0 9 9'><path d='M0'/><text>shown</text><text>here</text></svg> above.</p>", "The area is a = 2, as shown here above."),
        ("<noscript><p>This paragraph stands for readers without scripts.</p></noscript>", "This paragraph stands for readers without scripts."),
        ("<p>It plays <video src=x><source src=y>a film of the river</video> and <object data=z>a map</object> of it.</p>", "It plays a film of the river and a map of it."),
        ("<p>We draw <canvas>a chart of prices</canvas> and <iframe src=u>a table of wages</iframe> every year.</p>", "We draw a chart of prices and a table of wages every year."),
        ("<p>Here <button>press</button> the last sentence ends.</p>", "Here\nthe last sentence ends."),
        ("<p>Scripts <script>var a</script>and <style>b{}</style>styles are no text at all.</p>", "Scripts and styles are no text at all."),
    ]
    page = "<html><head><title>T</title><noscript>x</noscript></head><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>A title of some words</h1>{}</article></body></html>"
    for markup, wanted in inside:
        got = html_extraction.blocks(page.format(f"<p>First come some plain words of the article.</p>{markup}"), model)
        assert got == ["A title of some words", "First come some plain words of the article.", *wanted.split("\n")]
    assert [x.text for x in html_extraction.parse("<div>One<xmp>a <b> &amp; c</XMP>two</div>") if x.text] == ["One", "a <b> &amp; c", "two"]


def test_tree_marginals_by_enumeration():
    nodes = html_extraction.parse("<div><p>a b</p><ul><li>c<li>d</ul></div>")
    rng = random.Random(2)
    score = [rng.uniform(-2, 2) for _ in nodes]
    pairs = [tuple(rng.uniform(-2, 2) for _ in range(4)) for _ in nodes]
    marginal = html_extraction.content_marginals(nodes, score, pairs)
    weight = np.zeros(len(nodes))
    total = 0.0
    for states in itertools.product((0, 1), repeat=len(nodes)):
        w = np.exp(sum(s * x for s, x in zip(score, states)) + sum(pairs[i][2 * states[nodes[i].parent] + states[i]] for i in range(1, len(nodes))))
        total += w
        weight += w * np.array(states)
    assert np.allclose(weight / total, marginal)


@pytest.mark.parametrize("family", ["newspaper", "divisions", "manual", "sections"])
def test_html_families_held_out(family):
    """A model that never saw a family of layouts, on pages of that family."""
    model = html_extraction.trained(families=tuple(f for f in html_training.FAMILIES if f != family))
    total = 0.0
    pages = html_training.training_pages(60, 91, (family,))
    for source, wanted in pages:
        a, b = (collections.Counter(" ".join(x).split()) for x in (html_extraction.blocks(source, model), wanted))
        total += 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))
    assert total / len(pages) > 0.95


def test_html_kinds_of_content():
    model = html_extraction.trained()
    page = "<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav>{}<footer>© 2024 A site</footer></body></html>"
    long = "A long paragraph goes on with many plain words and ends at last. " * 4
    inside = [
        ("<article><p>Use <b>bold</b> and <code>call()</code> in it.</p><ul><li><a href=/x>One link here</a></li></ul></article>", ["Use bold and call() in it.", "One link here"]),
        (f"<h1>T</h1><p>{long}</p><figure><img src=x><figcaption>A caption.</figcaption></figure>", ["T", long.strip(), "A caption."]),
        ("<article><h1>Title</h1><p>First words of it all.</p><table><tr><th>Name<th>Age<tr><td>Ann<td>30</table><p>Last words.</p></article>", ["Title", "First words of it all.", "Name", "Age", "Ann", "30", "Last words."]),
        ("<article><h1>Title</h1><p><a href=/q>This whole paragraph is one link.</a></p><ul><li><a href=/1>First linked item</a><li><a href=/2>Second one</a></ul></article>", ["Title", "This whole paragraph is one link.", "First linked item", "Second one"]),
        ("<article><h1>Title</h1><dl><dt>Term</dt><dd>What it means in words.</dd></dl><p class='comment'>A paragraph with a name.</p><p>End of it.</p></article>", ["Title", "Term", "What it means in words.", "A paragraph with a name.", "End of it."]),
        ("<article><h1>Title</h1><p>Some words of the article.</p></article><div id=comments><p>I liked this article a lot, thank you.</p></div>", ["Title", "Some words of the article."]),
    ]
    for markup, wanted in inside:
        assert html_extraction.blocks(page.format(markup), model) == wanted


def test_html_broken_pages_are_linear():
    model = html_extraction.trained()
    n = 200_000
    pages = [
        '<a x="' * (n // 6), "<a x='>" * (n // 7), "<b></i>" * (n // 7), "<b>" * (n // 3) + "</i>" * (n // 4), "<div>" * (n // 5) + "x" + "</p></ul>" * (n // 9),
        "<p><td>" + "<h1>" * (n // 4) + "<h2>" * (n // 4), "<aaaa" * (n // 5), "<!" * (n // 2), "<div " + "a" * n + ">x", "<div " + "a=b " * (n // 4) + ">x",
        "&#" + "9" * n + ";x", "<!--" * (n // 4), "<li><ul>" * (n // 8) + "<li>" * (n // 4), "<script>" * (n // 8), "<xmp>" * (n // 5), "<" * n,
    ]
    for source in pages:
        start = time.process_time()
        html_extraction.blocks(source, model)
        assert time.process_time() - start < 15, source[:20]
    assert html_extraction.parse("<p title='a > b' x=\"c\">In</p><i y=it's>out</i>")[-1].text == "out"


def test_html_odd():
    model = html_extraction.trained()
    for source in ("", "<", "<p", "plain text only", "<div>" * 3000 + "deep" + "</div>" * 3000, "<!-- x", "<script>var a", "&amp;&#x41;&bad;"):
        html_extraction.blocks(source, model)
    assert html_extraction.blocks("<article><p>A &lt;b&gt;\n x</p><p>Second one here.</article>", model) == ["A <b> x", "Second one here."]


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    rows = [r for r in queries.op4_language_id(spark, SF1).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97


def test_language_of_short_texts():
    rng = random.Random(2)
    of = {"x": "bak dorim eshte falu garno hopik jelva", "y": "the water under seven bridges flows north", "z": "quiz vox lynx jump waltz fjord nymph"}
    text = lambda y, n: " ".join(rng.choices(of[y].split(), k=n))
    rows = [(text("x", 12), "x") for _ in range(40)] + [(text("y", 60), "y") for _ in range(10)] + [(text("z", 1 + i % 5), "z") for i in range(9)]
    model = language_id.fit([*rows, ("12 34", "x")], language_id.Settings(steps=30, batch=32))
    names, score = language_id.label_texts(pa.array([t for t, _ in rows]), model, language_id.Settings().bits)
    assert names == [y for _, y in rows] and min(score) > 0.6
    sizes = [1, 7, 15, 16, 17, 23, 24, 25, 60]
    word_text = np.repeat(np.arange(len(sizes)) * 2, sizes)  # texts without a word have numbers too
    firsts, lengths = language_id.training_windows(word_text, 16)
    covered = [i for a, n in zip(firsts, lengths, strict=True) for i in range(a, a + n)]
    assert set(covered) == set(range(len(word_text)))
    assert (word_text[firsts] == word_text[firsts + lengths - 1]).all()
    assert [sorted(set(lengths[word_text[firsts] == 2 * i])) for i in range(len(sizes))] == [[min(n, 16)] for n in sizes]


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    n, size = 6, 3
    emit, transition, begin = rng.normal(size=(n, size)), rng.normal(size=(size, size)), rng.normal(size=size)
    starts = np.array([1, 0, 0, 1, 0, 0], bool)
    wanted = np.zeros((n, size))
    for seq in itertools.product(range(size), repeat=n):
        s = sum(emit[i, y] for i, y in enumerate(seq)) + sum(begin[seq[i]] if starts[i] else transition[seq[i - 1], seq[i]] for i in range(n))
        for i, y in enumerate(seq):
            wanted[i, y] += np.exp(s)
    wanted /= wanted.sum(1, keepdims=True)
    for block in (1, 2, 4, 64):
        assert np.allclose(language_id.marginals(emit, starts, transition, begin, block), wanted)


def test_language_parts_are_one_chain(monkeypatch):
    rng = random.Random(6)
    words = {"x": "bak dorim eshte falu garno", "y": "the water under seven bridges", "z": "quiz vox lynx jump waltz"}
    rows = [(" ".join(rng.choices(words[y].split(), k=30)), y) for y in "xyz" * 10]
    model = language_id.fit(rows, language_id.Settings(steps=20, batch=32))
    bits = language_id.Settings().bits
    long = " ".join(t for t, _ in rows) + " " + "q" * 5000 + " 12 日本語" * 50
    whole = [language_id.label_texts(pa.array(x), model, bits) for x in ([long], [t for t, _ in rows] + ["", "1"])]
    monkeypatch.setattr(language_id, "CELLS", 9 * 2)  # a few blocks a part
    for part_bytes in (300, 1 << 20):
        monkeypatch.setattr(language_id, "PART_BYTES", part_bytes)
        parts = [language_id.label_texts(pa.array(x), model, bits) for x in ([long], [t for t, _ in rows] + ["", "1"])]
        for (a, p), (b, q) in zip(whole, parts, strict=True):
            assert a == b and np.allclose(p, q)


def test_language_many(spark):
    """Every language of the training rows can be predicted, however many there are."""
    rng = random.Random(3)
    rows = []
    for k in range(230):
        stem = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
        rows += [(k * 10 + j, " ".join(f"{stem}{rng.choice('aeiou')}{rng.choice('lmnr')}" for _ in range(25)), f"l{k:03}") for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = language_id.Settings(rows=1000, steps=12, batch=64)
    sample = language_id.training_rows(docs, s, 4, 2)
    assert {y for _, y in sample} == {y for _, _, y in rows}
    model = language_id.fit(sample, s)
    assert len(model["names"]) == 230


LONG_TEXT = """
import resource, sys, numpy as np, pyarrow as pa
from tesserae.llm import language_id
rng = np.random.default_rng(0)
size = 4
model = {"names": list("abcd"), "weights": rng.normal(size=(1 << 16, size)).astype(np.float32), "transition": rng.normal(size=(size, size)), "begin": np.zeros(size)}
language_id.label_texts(pa.array(["warm up"]), model, 16)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = {"words": "some words stand here " * 910_000, "run": "a" * 20_000_000}[sys.argv[1]]
language_id.label_texts(pa.array([text]), model, 16)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("kind", ["words", "run"])
def test_language_of_20_megabytes(kind):
    found = subprocess.run([sys.executable, "-c", LONG_TEXT, kind], capture_output=True, text=True, check=True, cwd=os.path.dirname(corpus_pipeline.__file__))
    assert int(found.stdout.split()[-1]) < 500


def test_token_counts_against_library(spark, docs, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, odd[0]):
        for segment in (100, 50_000):
            got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, PIECES, segment_chars=segment, batch_bytes=5000).collect())
            wanted = []
            for _, t in rows_of(df):
                n = len(library.encode(t))
                wanted.append((len(t.encode()), n, n > 4096))
            assert got == sorted(wanted)


def test_bpe_against_library(spark, docs):
    from tokenizers import Tokenizer

    library, machine = Tokenizer.from_file(BYTE_BPE), bpe_automaton.automaton(BYTE_BPE)
    rng = random.Random(5)
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice("ab \n\té'sß0日") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    texts += ["aaaa" * k for k in range(1, 30)] + [" " * k + "x" for k in range(12)]
    for t in texts:
        assert machine.encode(t) == library.encode(t, add_special_tokens=False).ids, t[:80]
    got = {r.doc_id: r for r in queries.op6_bpe(spark, SF).collect()}
    for i, t in rows_of(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_round_trip(spark, docs):
    back = queries.bpe.decode(queries.bpe.encode(docs, BYTE_BPE), BYTE_BPE)
    assert dict(rows_of(back)) == dict(rows_of(docs))


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, fp):
    ids = list(range(len(rows)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 4:
            a, b = root(i), root(j)
            ids[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(rows)}


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    rows = rows_of(docs)
    fp = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(rows, fp)
    got = {r.doc_id: r for r in queries.op7_simhash(spark, SF1).collect()}
    for (doc, _), f in zip(rows, fp):
        assert got[doc].fingerprint == f"{f:016x}"
        assert got[doc].component_id == groups[doc]


def test_links_of_dense_and_hot_groups(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:6]:
        for _ in range(60):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    rows = [(i, None) for i in range(len(fps))]
    wanted = brute_groups(rows, fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    number = {int(np.uint64(f).astype(np.int64)): i for i, f in enumerate(fps)}
    for block in (20_000, 80):  # the second deals long runs out in blocks
        links = [(number[r.a], number[r.b]) for r in simhash.edges(df, block=block).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in links)
        parent = list(range(len(fps)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        assert {i: root(i) for i in range(len(fps))} == wanted


def test_golay_keys():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 23, 500)
    for flips in range(3):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(23, flips, replace=False):
                y[i] ^= 1 << int(b)
        (a, na), (b, nb) = golay.nearby(x), golay.nearby(y)
        assert all(set(a[i, : na[i]]) & set(b[i, : nb[i]]) for i in range(len(x)))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF1}/documents.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF1).select(*names).collect())) == sorted(found.fetchall())


def test_digest_index_persists(spark, tmp_path):
    def load(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    path = f"file://{tmp_path}/index"
    first = exact_dedup.duplicate_groups(load([(1, "a"), (2, "A"), (3, "b")]), exact_dedup.DigestIndex(spark, path, 4))
    assert {(r.doc_id, r.kept) for r in first.collect()} == {(1, False), (2, True), (3, True)}
    later = exact_dedup.duplicate_groups(load([(9, "a"), (10, "c"), (10, "c")]), exact_dedup.DigestIndex(spark, path, 4)).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in later) == [(9, 2, False), (10, 10, False), (10, 10, True)]


def digests(spark, rows, path, batch, **parameters):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, path, 4, **parameters)
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(docs, index, batch).collect())


def test_digest_index_batches(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    two = [(9, "a"), (10, "c"), (10, "c"), (11, "B")]
    assert digests(spark, [(1, "a"), (2, "A"), (3, "b")], path, "1") == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    again = [digests(spark, two, path, "2") for _ in range(3)]
    assert again[0] == again[1] == again[2] == [(9, 2, 3, False), (10, 10, 2, False), (10, 10, 2, True), (11, 3, 2, False)]
    # every append from here on is followed by a rewrite
    assert digests(spark, [(20, "a"), (21, "z")], path, "3", max_files=0) == [(20, 2, 4, False), (21, 21, 1, True)]
    assert digests(spark, [(30, "A"), (31, "Z")], path, "4", max_files=0) == [(30, 2, 5, False), (31, 21, 2, False)]
    assert digests(spark, [(20, "a"), (21, "z")], path, "3") == [(20, 2, 5, False), (21, 21, 2, True)]
    index = exact_dedup.DigestIndex(spark, path, 4, bucket_rows=1)
    index.compact()
    assert index._version()[1] > 4 and len(index._listed(path)) > 1
    index.vacuum()
    assert len(index._listed(path)) == 1
    assert index.open().groupBy("batch").count().count() == 4
    index.close()
    assert digests(spark, [], path, "5") == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_large_index_small_batch(spark, tmp_path):
    """The index is read in its buckets, unshuffled and unsorted, and nothing of its size is broadcast."""
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 4)
    old = spark.range(20_001).selectExpr("id doc_id", "concat('t', least(id, 20000 - 1)) text")
    exact_dedup.duplicate_groups(old, index, "old").count()
    new = spark.createDataFrame([(1, "t1"), (2, "t19999"), (3, "new")], "doc_id long, text string")
    found = exact_dedup.duplicate_groups(new, index, "new")
    assert sorted((r.doc_id, r.group_size, r.kept) for r in found.collect()) == [(1, 2, False), (2, 3, False), (3, 1, True)]
    index.compact()  # one file a bucket again
    groups = new.select(F.unhex(F.sha2("text", 256)).alias("digest"))
    joined = exact_dedup.new_groups(groups, index.open(), "new")
    assert joined.count() == 1
    plan = joined._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") : plan.index("Initial Plan") if "Initial Plan" in plan else None]
    assert "LeftAnti" in side and "Bucketed: true" in side
    assert side.count("Exchange") == 1 and len(re.findall(r"\bSort \[", side)) == 1
    index.close()


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = list(zip(w, w[1:], w[2:]))
    count = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_rules_against_brute_force(spark, docs, odd):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df in (docs, odd[0]):
        got = sorted(tuple(r[c] for c in columns) for r in quality_rules.quality(df).collect())
        assert got == sorted(brute_measures(t) for _, t in rows_of(df))


def test_quality_rules_lines():
    rules = quality_rules.Rules()
    good = " ".join(["Plain words stand here and say something new each time."] + [f"w{i}" for i in range(60)]) + "."
    menu = "Home | About | News | Shop | Help"
    measures, lines = quality_rules.judge(f"{menu}\n{good}\nWe use cookies to help.", rules)
    assert measures["kept"] and lines == [good.encode()]
    measures, _ = quality_rules.judge("\n".join([menu] * 3 + [" | ".join(f"x{i}" for i in range(80))]), rules)
    assert not measures["kept"]


def test_quality_rules_menus():
    rules = quality_rules.Rules()
    fails = lambda line: quality_rules.line_rule(line.encode(), line.encode().split(), False, rules)
    for line in ("Home · About · News · Shop", "Home About News Shop Help Contact Login", "Home / Products / Red shoes / Size 9", "» Read on » Next page » Top", "home news contact"):
        assert fails(line) == "navigation"
    for line in ("He went home about noon to help us.", "and / or both of the many things that are here", "Home is where the news of the day is read", "1 / 2 / 3 done."):
        assert fails(line) is None


def test_quality_rules_loud_lines():
    rules = quality_rules.Rules()
    fails = lambda line: quality_rules.line_rule(line.encode(), line.encode().split(), False, rules)
    for line in ("1. BUY CHEAP PILLS TODAY NOW 99", "- BIG SALE HERE TODAY -", "КУПИТЕ НАШИ ТАБЛЕТКИ СЕГОДНЯ", "99 ΑΓΟΡΑΣΤΕ ΤΩΡΑ ΦΘΗΝΑ ΧΑΠΙΑ 1", "so CHEAP ÀÉ ÑÜ here!!"):
        assert fails(line) == "shouting"
    for line in ("BUY three plain words NOW.", "A B C D E.", "Я И В К О.", "Bé Aß Cé Dé and so on.", "1 2 3 4 5."):
        assert fails(line) is None
    rng = random.Random(5)
    pool = ["BUY", "now", "A", "Я", "ДА", "нет", "É", "ÉT", "Aé", "wow!!", "НО!!", "!!", "1.", "99", "-", "ΑΒ", "日本", "ǅX", "XY\xa0Z"]
    for _ in range(5000):
        words = rng.choices(pool, k=rng.randint(3, 9))
        loud = sum(w.endswith("!!") or (len(w) > 1 and w.isupper()) for w in words)
        assert (fails(" ".join(words)) == "shouting") == (loud > 0.6 * len(words))


def test_quality_rules_notices_and_links():
    rules = quality_rules.Rules()
    fails = lambda line: quality_rules.line_rule(line.encode(), line.encode().split(), False, rules)
    placeholder = (
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, "
        "quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse "
        "cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
    )
    notice = (
        "We use cookies on this site to remember your choices and to count how many people read each of our pages every day. Our privacy policy says in full "
        "which partners receive these data and how long they are stored by them. You may accept all cookies or choose which of them you would like to allow."
    )
    plain = " ".join(f"Here is sentence {i} of a long paragraph about rivers and bridges." for i in range(8))
    assert len(placeholder.split()) > 40 < len(notice.split())
    assert [fails(x) for x in (placeholder, notice, placeholder.upper().lower(), f"{plain} Read the privacy policy there.", plain)] == ["boilerplate"] * 3 + [None] * 2
    assert not quality_rules.judge(placeholder, rules)[0]["kept"]
    for line in ("Home https://a.example/ https://a.example/news (www.b.example)", "[Home](/) [About us](/about) [Latest news today](/news)", "HTTPS://A.EXAMPLE/ WWW.b.example/x"):
        assert fails(line) == "navigation"
    for line in ("See https://a.example/ for more about it", "The files are at https://a.example/ and here.", "https://a.example/ www.b.example are mirrors."):
        assert fails(line) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "exact dedup", "near dedup", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = stages["quality classifier"](spark, docs, SF)
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.7}
    clean = stages["quality rules"](spark, good, SF)
    verdicts = {i: quality_rules.judge(t, quality_rules.Rules()) for i, t in rows_of(good)}
    assert dict(rows_of(clean)) == {i: b"\n".join(lines).decode() for i, (m, lines) in verdicts.items() if m["kept"]}
    once = stages["exact dedup"](spark, clean, SF)
    last = {}
    for i, t in rows_of(clean):
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        last[key] = max(last.get(key, -1), i)
    assert sorted(i for i, _ in rows_of(once)) == sorted(last.values())
    apart = stages["near dedup"](spark, once, SF)
    rows = rows_of(once)
    groups = brute_groups(rows, [brute_fingerprint(t) for _, t in rows])
    assert sorted(i for i, _ in rows_of(apart)) == sorted(set(groups.values()))
    assert good.columns == clean.columns == once.columns == apart.columns == docs.columns
    check_packing(stages["packing"](spark, apart, SF).collect(), dict(rows_of(apart)))
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"](spark, apart, SF).count()
