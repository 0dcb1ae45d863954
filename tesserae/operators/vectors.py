"""Vectors: cosine neighbours of a stated query set, agreement measures, and hashed feature vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def top_cosine(vectors: DataFrame, queries: DataFrame, k: int, places: int = 6, row_block: int = 20_000, query_block: int = 4_000) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest of each query of a stated set, exactly.

    Rows and queries are dealt by hash into blocks of at most about ``row_block`` and ``query_block`` rows; every two
    blocks meet once, in a task of their own, that multiplies them as matrices and keeps the best k of each query. Only
    these are merged. Nothing is broadcast, and a task's memory is two blocks and one strip of products.
    """
    n_rows, n_queries = vectors.count(), queries.count()
    rows, asked = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), part(rows).alias("r"), each(asked).alias("q"))
    q = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), part(asked).alias("q"), each(rows).alias("r"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        ids, own = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        unit = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (np.array(t["e"].to_pylist(), float) for t in (left, right))]
        ids, a = ids[order], unit[0][order]
        out = []
        for at in range(0, len(own), 256):
            c = np.round(unit[1][at : at + 256] @ a.T, places)
            c[own[at : at + 256, None] == ids[None, :]] = -np.inf
            top = np.argsort(-c, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to the least
            value = np.take_along_axis(c, top, 1)
            i, j = np.nonzero(np.isfinite(value))
            out.append((own[at + i], ids[top[i, j]], value[i, j]))
        query_id, vec_id, cosine = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": query_id, "vec_id": vec_id, "cosine": cosine})

    scored = v.groupBy("r", "q").cogroup(q.groupBy("r", "q")).applyInArrow(best, "query_id long, vec_id long, cosine double")
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def seed_support(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, support, mean_cosine): how many neighbours share the query's label."""
    q = neighbours.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(labels, "vec_id")
    return q.groupBy("query_id").agg(F.sum((F.col("ql") == F.col("label")).cast("long")).alias("support"), F.round(F.avg("cosine"), 4).alias("mean_cosine"))


def reciprocal_rank(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(queries, mrr): mean reciprocal rank of the first neighbour with the query's label (0 where none has it)."""
    q = neighbours.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(labels, "vec_id")
    first = q.groupBy("query_id").agg(F.min(F.when(F.col("ql") == F.col("label"), F.col("rank"))).alias("first"))
    return first.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def related(neighbours: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(label, vec_id, seeds, best): vectors related to the queries of a label, by how many of them they are near to."""
    q = neighbours.join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    g = q.groupBy("label", "vec_id").agg(F.count(F.lit(1)).alias("seeds"), F.max("cosine").alias("best"))
    w = W.partitionBy("label").orderBy(F.desc("seeds"), F.desc("best"), "vec_id")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def feature_hash(features: DataFrame, id_col: str, dims: int = 384) -> DataFrame:
    """(id, bucket, value): hashed features (id, feature, weight) with unit length; the bucket is from the feature's md5."""
    bucket = (F.conv(F.substring(F.md5("feature"), 1, 8), 16, 10).cast("long") % dims).alias("bucket")
    summed = features.select(id_col, bucket, "weight").groupBy(id_col, "bucket").agg(F.sum("weight").alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(id_col)))
    return summed.select(id_col, "bucket", F.round(F.col("value") / norm, 6).alias("value"))


def signed_feature_hash(features: DataFrame, id_col: str, dims: int = 384) -> DataFrame:
    """(id, bucket, value): as ``feature_hash``, by BLAKE2b: the first 8 of its 16 bytes modulo ``dims`` are the bucket, an odd
    ninth byte makes the weight negative. Sums of zero are left out; an id without another one has (0, 0.0)."""

    @F.pandas_udf("bucket int, sign double")
    def hashed(names):
        digests = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in names]
        return pd.DataFrame({"bucket": [int.from_bytes(d[:8], "big") % dims for d in digests], "sign": [-1.0 if d[8] % 2 else 1.0 for d in digests]})

    known = features.where("feature is not null").select("feature").distinct().select("feature", hashed("feature").alias("h"))
    rows = features.join(known, "feature").select(id_col, F.col("h.bucket").alias("bucket"), (F.col("h.sign") * F.col("weight")).alias("weight"))
    summed = rows.groupBy(id_col, "bucket").agg(F.sum("weight").alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(id_col)))
    own = F.when(norm > 0, F.col("value") / norm).otherwise(0.0)
    found = summed.select(id_col, "bucket", F.round(own, 6).alias("value")).where("value <> 0")
    none = features.select(id_col).distinct().join(found.select(id_col).distinct(), id_col, "left_anti")
    return found.unionByName(none.select(id_col, F.lit(0).alias("bucket"), F.lit(0.0).alias("value")))


def coherence(neighbours: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(label, seeds, coherence): the mean share of a seed's k neighbours that have its label, over the label's seeds."""
    s = seed_support(neighbours, labels).join(labels.withColumnRenamed("vec_id", "query_id"), "query_id")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg(F.col("support") / k), 4).alias("coherence"))
