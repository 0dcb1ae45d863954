"""Pieces shared by the operators: scratch storage, byte-bounded Arrow slices, vectorised words, hot-key joins."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one vectorised step works on; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``, below one folder an application, to be removed whole
    when its results were read. Only a local master, as in tests, may leave the setting out; a cluster must name a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/tesserae/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read again: lineage is cut and later reads survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and about 8 MB in this session, so that Python workers hold few long texts."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, typed, to be sent to Python in small batches."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null for a null id)."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


def whole_texts(found: DataFrame, keys: list[str], rows: int, chars: int, part: str | None = None) -> list[tuple]:
    """(keys..., text) of a sample of whole texts: by a hash of the first key, until ``rows`` texts or ``chars`` characters
    of each value of the column ``part`` (of all) are held.

    ``found`` (keys, text) has one row a key and is bounded by its maker. Sizes are read first. A text that no longer
    fits is passed over, never cut; where none fits the shortest is taken. The order does not depend on partitions.
    """
    found = stored(found.select(*keys, F.coalesce("text", F.lit("")).alias("text")), "sample")
    sized = found.select(*keys, F.length("text").alias("n")).toArrow()
    sizes = sized["n"].to_pylist()
    key = list(zip(*(sized[k].to_pylist() for k in keys), strict=True))
    group = sized[part].to_pylist() if part else [None] * len(sizes)
    order = lambda k: (zlib.crc32(str(k[0]).encode()), *k)
    taken: set[int] = set()
    held: dict = {}
    for i in sorted(range(len(sizes)), key=lambda i: order(key[i])):
        n_rows, n_chars = held.get(group[i], (0, 0))
        if n_rows < rows and n_chars + sizes[i] <= chars:
            taken.add(i)
            held[group[i]] = (n_rows + 1, n_chars + sizes[i])
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], order(key[i]))):
        if group[i] not in held:
            taken.add(i)
            held[group[i]] = (1, sizes[i])
    if len(taken) < len(sizes):
        found = found.join(found.sparkSession.createDataFrame(sized.select(keys).take(sorted(taken))), keys)
    texts = found.select(*keys, "text").toArrow()
    return sorted(zip(*(texts[c].to_pylist() for c in texts.column_names), strict=True), key=lambda r: order(r[:-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, buckets: int, held: int, rows: int, chars: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled training texts as (text, label), ``chars`` characters in all, the same ones in any run.

    Rows whose crc32 remainder is ``held`` are never read as labels. The ids are chosen first by hash order, so the
    list that is broadcast has at most ``rows`` rows whatever the size of the corpus. Texts are fitted on whole. A
    repeated label row counts once (the largest label), of rows that repeat an id the largest text; null ids and labels
    are left out.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder("doc_id", buckets) != held))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    found = whole_texts(picked, ["doc_id", "y"], rows, chars)
    return [(text, y) for _, y, text in sorted(found)]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Record batches cut into runs of about ``limit`` bytes of text, each with its texts (null as empty)."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(at, end - at), column.slice(at, end - at)
            at = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each value starts (one more at the end)."""
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of many texts at once: maximal runs of the bytes that ``table`` marks, never across two texts.

    start, end: byte positions; text: number of the word's text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        inside = table[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] |= inside[edges]
        ends[edges - 1] |= inside[edges - 1]
        self.data, self.offsets, self.inside = data, offsets, inside
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, fold: np.ndarray) -> np.ndarray:
        """A 64-bit tabulation hash of each word, after mapping its bytes with ``fold``."""
        if not len(self):
            return np.zeros(0, np.uint64)
        at = np.flatnonzero(self.inside)
        sizes = self.end - self.start
        first = np.cumsum(sizes) - sizes
        place = at - np.repeat(self.start, sizes)
        values = TABULATION[place & 31, fold[self.data[at]]] * (2 * (place >> 5).astype(np.uint64) + np.uint64(1))
        return mixed(np.add.reduceat(values, first))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Per word, the sum of a per-byte quantity."""
        if not len(self):
            return np.zeros(0)
        total = np.concatenate([[0], np.cumsum(weights)])
        return total[self.end] - total[self.start]


def mixed(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def byte_table(rule: Callable[[int], bool]) -> np.ndarray:
    return np.array([rule(b) for b in range(256)])


TABULATION = np.random.default_rng(20).integers(1, 2**63, (32, 256), dtype=np.uint64) | np.uint64(1)
IDENTITY = np.arange(256, dtype=np.uint8)
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words between white space [\x20\x09-\x0D].
NOT_SPACE = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
#: ASCII letters, digits and every byte of longer characters.
WORDLIKE = byte_table(lambda b: b >= 128 or chr(b).isalnum())
LETTERLIKE = byte_table(lambda b: b >= 128 or chr(b).isalpha())


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, hot: int = 1000) -> DataFrame:
    """``rows`` with their group's columns, where one group may hold a large share of all rows.

    ``groups`` has one row a key with its number of rows in ``size``. Groups of over n_rows / hot rows are at most
    ``hot`` by arithmetic; these few are broadcast, and their rows never meet in one task. The others join by shuffle.
    """
    large = F.col(size) > max(1, n_rows // hot)
    few = F.broadcast(groups.where(large))
    found = rows.join(few, key, "left")
    named = [c for c in groups.columns if c != key]
    rest = found.where(F.col(size).isNull()).drop(*named).join(groups.where(~large), key)
    return found.where(F.col(size).isNotNull()).unionByName(rest)
