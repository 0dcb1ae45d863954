"""Exact duplicates by a persistent digest index, bucketed and sorted by digest.

``DigestIndex`` is a Parquet table in shared storage with one row a digest and batch: (digest, keep_id, n_rows, stayed, batch; stayed: the
batch was the first with that digest), bucketed and sorted by digest. New data is reduced to one row a digest before anything is shuffled. A sort-merge
anti-join on the buckets finds the digests that the index does not hold yet; the batch's digests are appended. The index
side of the join is read in place: no exchange, and no sort where a bucket is one file. An index with more than
``max_files`` files a bucket, or more than ``bucket_rows`` rows a bucket, is rewritten first, as one file for each of as
many buckets as it needs. Texts are equal when identical after lower-casing A-Z only.

A batch has an id, which the caller gives where a batch may be run again: rows of one's own batch do not count as known,
and digests that it has already appended are not appended twice, so a second run gives the rows of the first. Known
digests keep the row that stayed when they were first seen; their group sizes are those of all batches together.

Defined cases: null text counts as empty; of equal texts the row with the largest doc_id stays (a null id is the
smallest, and of rows that repeat both id and text one is kept); extra columns are left out; an empty batch appends
nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import join_groups, scratch, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null as empty."""
    t = F.coalesce(text, F.lit(""))
    # lower() on pure ASCII is the same and faster
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


class DigestIndex:
    """Digests seen so far, below ``path``; it outlives the session, another one opens it again.

    Every rewrite is a folder of its own, v<number>-b<buckets>; the one with the largest number that is complete counts.
    One writer at a time: appends of two sessions at once need a lock outside.
    """

    COLUMNS = ("digest", "keep_id", "n_rows", "stayed", "batch")
    SCHEMA = "digest BINARY, keep_id BIGINT, n_rows BIGINT, stayed BOOLEAN, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, bucket_rows: int = 4_000_000, max_files: int = 8) -> None:
        self.spark, self.path, self.first_buckets = spark, path.rstrip("/"), buckets
        self.bucket_rows, self.max_files = bucket_rows, max_files
        self.tables: list[str] = []
        # else the order of the files is not used by joins
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _listed(self, path: str) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _version(self) -> tuple[int, int]:
        """Number and buckets of the current folder; (0, ...) before the first append."""
        found = [tuple(int(x[1:]) for x in name.split("-")) for name in self._listed(self.path) if name.startswith("v")]
        done = [v for v in found if "_SUCCESS" in self._listed(self._folder(*v))]
        return max(done, default=(0, self.first_buckets))

    def _folder(self, version: int, buckets: int) -> str:
        return f"{self.path}/v{version}-b{buckets}"

    def open(self) -> DataFrame:
        """The index as a table (empty where nothing was appended yet)."""
        version, buckets = self._version()
        if not version:
            return self.spark.range(0).selectExpr(*(f"cast(null as {c.split()[1]}) {c.split()[0]}" for c in self.SCHEMA.split(", ")))
        name = f"digest_index_{uuid.uuid4().hex}"
        self.tables.append(name)
        self.spark.sql(
            f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self._folder(version, buckets)}'"
        )
        return self.spark.table(name)

    def _write(self, rows: DataFrame, version: int, buckets: int) -> None:
        name = f"digest_index_{uuid.uuid4().hex}"
        self.tables.append(name)
        rows = rows.select(*self.COLUMNS).repartition(buckets, "digest").sortWithinPartitions("digest")
        rows.write.format("parquet").bucketBy(buckets, "digest").sortBy("digest").option("path", self._folder(version, buckets)).mode("overwrite").saveAsTable(name)

    def append(self, groups: DataFrame) -> None:
        """Append rows (digest, keep_id, n_rows, stayed, batch) that are stored apart from the index."""
        version, buckets = self._version()
        if not version:
            n = groups.count()
            self._write(groups, 1, max(self.first_buckets, -(-n // self.bucket_rows)))
            return
        name = self.open_name()
        groups.select(*self.COLUMNS).repartition(buckets, "digest").sortWithinPartitions("digest").write.insertInto(name)
        files = sum(f.endswith(".parquet") for f in self._listed(self._folder(version, buckets)))
        if files > self.max_files * buckets:
            self.compact()

    def open_name(self) -> str:
        self.open()
        return self.tables[-1]

    def compact(self) -> None:
        """Rewrite the index as one file a bucket. The folder read until now stays for those who read it; see ``vacuum``."""
        version, buckets = self._version()
        if version:
            # read as plain files: over a bucketed table the deal by bucket would be left out as needless
            rows = self.spark.read.schema(self.SCHEMA).parquet(self._folder(version, buckets))
            self._write(rows, version + 1, max(self.first_buckets, buckets, -(-rows.count() // self.bucket_rows)))

    def vacuum(self) -> None:
        """Remove the folders that a rewrite has replaced."""
        current = self._version()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in self._listed(self.path):
            if name.startswith("v") and tuple(int(x[1:]) for x in name.split("-")) < current:
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                at.getFileSystem(conf).delete(at, True)

    def close(self) -> None:
        """Forget the session's names for the tables; the files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the folded whole text, as 32 bytes, with a number for each row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(folded(F.col("text")), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def new_groups(groups: DataFrame, index: DataFrame, batch: str) -> DataFrame:
    """The groups whose digest no other batch has brought first: the sort-merge anti-join."""
    others = index.where((F.col("batch") != batch) & F.col("stayed")).select("digest")
    return groups.hint("merge").join(others, "digest", "left_anti")


def known_groups(groups: DataFrame, index: DataFrame, batch: str) -> DataFrame:
    """(digest, known_id, known, known_rows) of the batch's digests in other batches: what stayed, whether, all their rows."""
    others = index.where(F.col("batch") != batch).select("digest", "keep_id", "n_rows", "stayed")
    hit = others.join(groups.select("digest"), "digest")
    return hit.groupBy("digest").agg(
        F.max(F.when(F.col("stayed"), F.col("keep_id"))).alias("known_id"), F.max("stayed").alias("known"), F.sum("n_rows").alias("known_rows")
    )


def duplicate_groups(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; the batch's digests are added to the index.

    A text that another batch brought before keeps none of the new rows: its keep_id is the row that stayed then.
    """
    spark = docs.sparkSession
    rows = stored(digest_rows(docs), "digests")
    own = index is None
    index = index or DigestIndex(spark, scratch(spark, "digest-index"))
    batch = batch or uuid.uuid4().hex
    best = F.max(F.struct("doc_id", "row_no"))
    groups = (
        rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n_rows"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_no").alias("keep_row"), "n_rows")
    )
    seen = index.open()
    groups = stored(groups, "groups")
    fresh = new_groups(groups, seen, batch)
    if own:
        found = fresh.select("*", F.lit(0).cast("long").alias("known_rows"), F.lit(True).alias("stayed"))
    else:
        known = stored(known_groups(groups, seen, batch), "known")
        fresh = fresh.join(known.select("digest", "known_rows"), "digest", "left").select("*", F.lit(True).alias("stayed"))
        late = groups.drop("keep_id", "keep_row").join(known.where("known"), "digest")
        late = late.select("digest", F.col("known_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "n_rows", "known_rows", F.lit(False).alias("stayed"))
        found = fresh.unionByName(late).fillna(0, "known_rows")
    found = stored(found, "found")
    added = found.select("digest", "keep_id", "n_rows", "stayed", F.lit(batch).alias("batch"))
    if not own:
        again = seen.where(F.col("batch") == batch).select("digest")  # of an earlier run of this batch
        added = stored(added.hint("merge").join(again, "digest", "left_anti"), "added")
    index.append(added)
    index.close()
    groups = found.select("digest", "keep_id", "keep_row", "n_rows", (F.col("n_rows") + F.col("known_rows")).alias("group_size"))
    # a group is hot by its rows in this batch, whatever the index has seen of it
    out = join_groups(rows, groups, "digest", "n_rows", rows.count())
    kept = F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents with one row of every text (none of texts that the index knew before), all columns as they were."""
    found = duplicate_groups(docs, index, batch).where("kept")
    kept = stored(found.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")), "kept")
    key = [F.col("doc_id").cast("long").alias("__id"), F.sha2(folded(F.col("text")), 256).alias("__sha")]
    marked = docs.select("*", *key)
    both = marked["__id"].eqNullSafe(kept["__id"]) & (marked["__sha"] == kept["__sha"])
    # the same plan at any size: texts are dealt by id once and not sorted, ids are hashed
    out = marked.join(kept.hint("shuffle_hash"), both, "left_semi")
    again = docs.select(*key).groupBy("__id", "__sha").count().where("count > 1").join(kept, ["__sha"], "left_semi")
    if not again.isEmpty():  # rows that repeat both id and text: one of each
        out = out.dropDuplicates(["__id", "__sha"])
    return out.drop("__id", "__sha")
