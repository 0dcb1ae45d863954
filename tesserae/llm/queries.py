"""The operators' registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import (
    bpe,
    exact_dedup,
    html_extraction,
    language_id,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    token_counts,
    toxicity,
)
from tesserae.llm.common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def digest_index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents`` in two batches through one index: those with even ids, then those with odd ones."""
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, scratch(spark, "digest-index"))
    found = [
        exact_dedup.duplicate_groups(docs.where(rows), index, f"batch {k}").withColumn("batch", F.lit(k))
        for k, rows in ((1, "doc_id % 2 = 0"), (2, "doc_id % 2 <> 0"))
    ]
    return found[0].unionByName(found[1])


def rule_base_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of op9 that SQL can say, of every whole text."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return quality_rules.quality(table(spark, sf_dir, "documents")).select(*columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_best_fit_packing, op3_html_extraction, op4_language_id, op5_token_counts,
        op6_bpe, op7_simhash, op8_exact_dedup, op9_quality_rules, op10_toxicity, digest_index_batches, rule_base_measures,
    )
}

ORACLE_SQL = {
    "op8_exact_dedup": f"""
        WITH folded AS (
            SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}') AS t FROM documents
        )
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM folded WINDOW same AS (PARTITION BY t)
    """,
    "digest_index_batches": f"""
        WITH folded AS (
            SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}') AS t, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS batch
            FROM documents
        ), groups AS (
            SELECT t, max(doc_id) FILTER (batch = 1) AS first_id, max(doc_id) FILTER (batch = 2) AS second_id, count(*) FILTER (batch = 1) AS first_rows, count(*) AS all_rows
            FROM folded GROUP BY t
        )
        SELECT doc_id, CASE WHEN batch = 1 THEN first_id ELSE coalesce(first_id, second_id) END AS keep_id,
               CASE WHEN batch = 1 THEN first_rows ELSE all_rows END AS group_size,
               CASE WHEN batch = 1 THEN doc_id = first_id ELSE first_id IS NULL AND doc_id = second_id END AS kept, sha256(t) AS text_sha256, batch
        FROM folded JOIN groups USING (t)
    """,
    "rule_base_measures": r"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        split AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
        windows AS (
            SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'a': w[i], 'b': w[i + 1], 'c': w[i + 2]})) AS x FROM split WHERE len(w) >= 3
        ),
        twice AS (SELECT doc_id, x.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x.a, x.b, x.c) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts),
        repeats AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        measured AS (
            SELECT s.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(r.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
            FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id LEFT JOIN repeats r ON r.doc_id = s.doc_id
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
    """,
}
