"""Near duplicates: 64-bit SimHash fingerprints linked by Golay-code fuzzy hashing.

Keys. A fingerprint is three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most 4 bits have two
segments with at most 2 differing bits together: at most one bit in each of the two, or (only if the errors are 0, 2
and 2) none in one and two in another. So these keys lose no link (see ``golay``):
 - of every two segments, each pair of codeword indices within reach for one error;
 - of every segment and the next one, the segment itself with each codeword index within reach for two errors.
About 46 keys of 24 or more bits a fingerprint; only distinct fingerprints take part.

Verification. Keys are shuffled and sorted; within a run of equal keys the fingerprints are compared by XOR and bit
count. Short runs give all their links. In a longer run each fingerprint found is compared with those not yet reached,
so a dense group of m gives m - 1 links, which connect it as all its pairs would. Runs longer than ``block`` are handed
on and compared in pairs of blocks by many tasks, also whole.

Defined cases: null text counts as empty; texts without a word have fingerprint 0 and link like others; fewer words than
a shingle give one shingle; repeated rows get the same fingerprint and component; a null id never names a component
unless all its ids are null; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import FOLD, inputs, join_groups, slices, stored
from tesserae.llm.components import components
from tesserae.llm.golay import nearby, parity

SHORT = 64
LOWER = bytes(FOLD)
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
EDGE_SQL = "a long, b long, key long"


def fingerprint(text: str, shingle: int = 4, seed: int = 42, part: int = 1 << 16) -> int:
    """SimHash of a text: bit i is set if it is set in over half of the shingles' XXH64 values."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    n, digest = len(starts), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, part):
        h = np.array([digest(line[s:e], seed) for s, e in zip(starts[at : at + part], ends[at : at + part], strict=True)], np.dtype("<u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash (64 bits, tells apart rows that repeat an id) and fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    return inputs(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, key) for all keys of the fingerprints."""
    bits = fps.view(np.uint64)
    segments = [(bits & np.uint64((1 << 22) - 1)).astype(np.int64), (bits >> np.uint64(22) & np.uint64((1 << 21) - 1)).astype(np.int64), (bits >> np.uint64(43)).astype(np.int64)]
    near = [nearby(s) for s in segments]
    six = np.arange(6)
    two_errors = [six[None, :] < count[:, None] for _, count in near]
    one_error = [m & ((six[None, :] == 0) | (parity(s) == 1)[:, None]) for m, s in zip(two_errors, segments, strict=True)]
    owners, keys = [], []
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        i, x, y = np.nonzero(one_error[a][:, :, None] & one_error[b][:, None, :])
        owners.append(i)
        keys.append(k << 60 | near[a][0][i, x] << 12 | near[b][0][i, y])
    for a in range(3):
        b = (a + 1) % 3
        i, y = np.nonzero(two_errors[b])
        owners.append(i)
        keys.append((4 + a) << 60 | segments[a][i] << 12 | near[b][0][i, y])
    return np.concatenate(owners), np.concatenate(keys)


def close(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(x, y).view(np.uint64)) <= most


def forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the fingerprints of one run just as all their links would, at most one less than them."""
    a, b = [], []
    rest = fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = close(rest, np.broadcast_to(x, rest.shape), most)
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links_of(keys: np.ndarray, fps: np.ndarray, most: int, block: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Links of whole runs of sorted keys; members of runs over ``block`` are handed on as (fp, fp, key)."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    out = []
    few = np.repeat((size > 1) & (size <= SHORT), size)
    k, f = keys[few], fps[few]
    for shift in range(1, SHORT):
        same = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(same):
            break
        same = same[close(f[same], f[same + shift], most)]
        out.append((f[same], f[same + shift], None))
    for s, n in zip(first[size > SHORT], size[size > SHORT], strict=True):
        run = fps[s : s + n]
        out.append((*forest(run, most), None) if n <= block else (run, run, keys[s : s + n]))
    return out


def edges(fps: DataFrame, most: int = 4, block: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) of at most ``most`` = 4 differing bits."""
    if most > 4:
        raise ValueError("the keys find up to 4 differing bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False)
                owner, key = keys_of(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[owner])], ["key", "fp"])

    def rows(found: list) -> Iterator[pa.RecordBatch]:
        for a, b, key in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)], schema=EDGE)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp, late = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(keys):
                continue
            if late is not None:  # the run that was handed on continues
                n = int(np.searchsorted(keys, late, "right"))
                yield from rows([(fp[:n], fp[:n], keys[:n])])
                keys, fp = keys[n:], fp[n:]
                if not len(keys):
                    continue
                late = None
            whole = int(np.searchsorted(keys, keys[-1], "left"))  # the last run may go on
            if whole:
                yield from rows(links_of(keys[:whole], fp[:whole], most, block))
                keys, fp = keys[whole:], fp[whole:]
            elif len(keys) > block:  # too long for one task
                yield from rows([(fp, fp, keys)])
                keys, fp, late = keys[:0], fp[:0], keys[0]
        if len(keys):
            yield from rows(links_of(keys, fp, most, block))

    def between(key: tuple, table: pa.Table) -> pa.Table:
        a, b = forest(table["fp"].to_numpy(), most)
        return pa.table({"a": a, "b": b, "key": pa.nulls(len(a), pa.int64())}, EDGE)

    keyed = fps.select("fp").mapInArrow(emit, "key long, fp long")
    found = stored(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(verify, EDGE_SQL), "edges")
    links = found.where("key is null").select("a", "b")
    late = found.where("key is not null").select("key", F.col("a").alias("fp"))
    counts = late.groupBy("key").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).select("key", "blocks", "count")
    if not counts.isEmpty():
        dealt = join_groups(late, stored(counts, "hot-keys"), "key", "count", late.count()).withColumn("mine", F.expr("pmod(xxhash64(fp), blocks)"))
        # every two blocks of a run meet once, in a task of their own
        others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        meets = dealt.select("key", "fp", "mine", others.alias("other")).where("mine <> other").select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
        late_links = meets.groupBy("key", "i", "j").applyInArrow(between, EDGE_SQL)
        links = links.unionByName(stored(late_links, "late-edges").select("a", "b"))
    return links


def near_groups(docs: DataFrame, most: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, fp, component_id (the least doc_id reachable) and root (a number of the component) of every row."""
    rows = stored(fingerprints(docs, shingle, seed), "fingerprints")
    n = rows.count()
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    found = components(edges(classes, most)).withColumnRenamed("node", "fp")
    rooted = stored(classes.join(found, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    per_fp = join_groups(rooted.select("fp", "n", "root"), stored(named, "named"), "root", "members", max(1, rooted.count()))
    per_fp = stored(per_fp.select("fp", "n", "component_id", "root"), "components")
    return join_groups(rows, per_fp, "fp", "n", n).select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, **parameters: int) -> DataFrame:
    """The documents with one of each group of near duplicates (its least doc_id), all columns as they were."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    groups = near_groups(docs, **parameters).groupBy("root").agg(first)
    kept = stored(groups.select(F.col("first.doc_id").alias("__kept_id"), F.col("first.text_hash").alias("__kept_hash")), "kept")
    key = [F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__hash")]
    marked = docs.select("*", *key)
    # the same plan at any size: texts are dealt by id once and not sorted, ids are hashed
    both = marked["__id"].eqNullSafe(kept["__kept_id"]) & (marked["__hash"] == kept["__kept_hash"])
    out = marked.join(kept.hint("shuffle_hash"), both, "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that repeat an id and a text
        out = out.dropDuplicates(["__id", "__hash"])
    return out.drop("__id", "__hash")
