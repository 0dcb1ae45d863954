"""Best-fit packing of token sequences by hierarchical residual packing.

1. Each partition encodes its documents, cuts only those longer than ``capacity`` (full pieces; the first may be
   shorter), and packs its pieces by best fit, the longest first. Bins with at most ``slack`` free places are emitted.
   A task holds at most about ``held`` pieces: beyond that it packs and emits, and its underfull bins are pieces again.
2. The underfull bins are the items of the next round: bins of ``fan_in`` neighbouring groups meet in one group and are
   packed by best fit again. Nearly full bins are emitted, the others go up the tree, until one group is left.

What a group hands up is bounded: after best fit no two of its bins fit together, so at most one is half full or less,
and of the others only the ``carry`` emptiest can serve smaller bins of other groups; the rest are emitted as they are.
Nothing is dropped, and the last group meets at most fan_in * carry bins. Each round is written to shared storage,
so a lost executor costs one round's task and no round is computed twice.

Defined cases: null text counts as empty, and each document ends with the end id, so every document has a piece;
repeated rows are packed each for itself; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import inputs, scratch
from tesserae.llm.token_counts import safe_segments

#: Characters of a text that one call of the encoder gets, about.
SEGMENT = 50_000
SEQUENCE = (
    "grp long, bin_no long, fill int, emitted boolean, "
    "doc_id array<long>, piece array<int>, start array<long>, length array<int>, ids_crc32 array<long>"
)
ARROW = pa.schema([
    ("grp", pa.int64()), ("bin_no", pa.int64()), ("fill", pa.int32()), ("emitted", pa.bool_()),
    ("doc_id", pa.list_(pa.int64())), ("piece", pa.list_(pa.int32())), ("start", pa.list_(pa.int64())),
    ("length", pa.list_(pa.int32())), ("ids_crc32", pa.list_(pa.int64())),
])


@lru_cache(maxsize=2)
def encoder(json_path: str):
    """ids of a text exactly as ``Tokenizer.from_file(json_path).encode(text, add_special_tokens=False)`` gives them.

    Texts go in segments cut where the pre-split always cuts (``safe_segments``). A several times faster encoder, made
    of the same file's merges, does each of them; special strings become their ids here. A segment that holds no such
    place for over two limits, such as a run of a million blanks, goes to the library itself.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(json_path)
    library.no_truncation()
    library.no_padding()

    def slow(text: str) -> list[int]:
        return library.encode(text, add_special_tokens=False).ids

    fast = fast_encoder(json_path) or slow

    def encode(text: str) -> np.ndarray:
        parts = [(fast if len(part) <= 2 * SEGMENT else slow)(part) for part in safe_segments(text, SEGMENT)]
        return np.concatenate([np.array(x, "<u4") for x in parts])

    return encode


def fast_encoder(json_path: str):
    """A function from texts to ids by the file's merges, or None where their order is not that of their ids."""
    import tiktoken

    from tesserae.llm.bpe_automaton import byte_characters, PRE_SPLIT

    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, of = spec["model"]["vocab"], byte_characters()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in pairwise(made)):
        return None
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    coder = tiktoken.Encoding("byte_bpe", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coder.encode(text, allowed_special="all")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for a first piece that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(i, capacity) for i in range(first, n, capacity)]


def best_fit(items: Iterable[tuple[int, object]], capacity: int) -> list[list]:
    """Items (size, payload) into bins [fill, payloads]: each, the longest first, into the fullest bin that has room."""
    bins: list[list] = []
    rooms: list[tuple[int, int]] = []  # (free places, bin), sorted
    for size, payload in sorted(items, key=lambda x: -x[0]):
        k = bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
            bins[b][0] += size
            bins[b][1].append(payload)
            room -= size
        else:
            b, room = len(bins), capacity - size
            bins.append([size, [payload]])
        if room:
            insort(rooms, (room, b))
    return bins


def judged(bins: list[list], capacity: int, slack: int, carry: int, last: bool) -> list[bool]:
    """Whether each bin is emitted now; the others, at most ``carry``, go up."""
    if last:
        return [True] * len(bins)
    open_ = sorted((b for b in range(len(bins)) if bins[b][0] < capacity - slack), key=lambda b: (bins[b][0], b))[:carry]
    up = set(open_)
    return [b not in up for b in range(len(bins))]


def batches_of(group: int, bins: list[list], emitted: list[bool], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Bins whose payloads are lists of (doc_id, piece, start, length, crc)."""
    for at in range(0, len(bins), rows):
        part = bins[at : at + rows]
        flat = [[x for payload in pieces for x in payload] for _, pieces in part]
        columns = [[[x[k] for x in bin_] for bin_ in flat] for k in range(5)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip([[group] * len(part), list(range(at, at + len(part))), [b[0] for b in part], emitted[at : at + rows], *columns], ARROW, strict=True)],
            schema=ARROW,
        )


def pack_sequences(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, slack: int = 8, fan_in: int = 8, carry: int = 2048, held: int = 100_000) -> DataFrame:
    """The sequences: one row a bin, with its pieces in order (arrays doc_id, piece, start, length, ids_crc32)."""
    spark = docs.sparkSession

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, encode, items, done, made = TaskContext.get().partitionId(), encoder(path), [], [], 0

        def written(bins: list[list], emitted: list[bool]) -> Iterator[pa.RecordBatch]:
            # bins emitted before the end get numbers of their own below zero
            nonlocal made
            for out in batches_of(group, bins, emitted):
                yield out.set_column(1, "bin_no", pa.array(range(-1 - made, -1 - made - out.num_rows, -1), pa.int64()))
                made += out.num_rows

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    piece = (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    if length == capacity:
                        done.append([capacity, [[piece]]])
                    else:
                        items.append((length, [piece]))
                    if len(done) >= 2000:
                        yield from written(done, [True] * len(done))
                        done = []
            if len(items) >= held:  # pack what is held; the underfull bins are items again
                bins = best_fit(items, capacity)
                now = judged(bins, capacity, slack, carry, False)
                closed = [b for b, e in zip(bins, now, strict=True) if e]
                yield from written(closed, [True] * len(closed))
                items = [(fill, [x for p in payloads for x in p]) for (fill, payloads), e in zip(bins, now, strict=True) if not e]
        yield from written(done, [True] * len(done))
        bins = best_fit(items, capacity)
        yield from batches_of(group, bins, judged(bins, capacity, slack, carry, False))

    def merge(last: bool):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (r["grp"], r["bin_no"]))
            items = [(r["fill"], list(zip(*(r[c] for c in ARROW.names[4:]), strict=True))) for r in rows]
            bins = best_fit(items, capacity)
            return pa.Table.from_batches(batches_of(key[0].as_py(), bins, judged(bins, capacity, slack, carry, last)), ARROW)

        return run

    base = scratch(spark, "packing")
    source = inputs(docs)
    groups = max(1, source.rdd.getNumPartitions())
    source.mapInArrow(local, SEQUENCE).write.parquet(f"{base}/level=0")
    level = 0
    while True:
        level += 1
        groups = -(-groups // fan_in)
        before = spark.read.schema(SEQUENCE).parquet(f"{base}/level={level - 1}")
        up = before.where(~F.col("emitted")).withColumn("meets", F.floor(F.col("grp") / fan_in).cast("long"))
        up.groupBy("meets").applyInArrow(merge(groups == 1), SEQUENCE).write.parquet(f"{base}/level={level}")
        if groups == 1:
            break
    rounds = [
        spark.read.schema(SEQUENCE).parquet(f"{base}/level={k}").where("emitted").select(
            # groups and bins of a round are numbered densely enough for one 64-bit number
            ((F.col("grp") * 64 + k) * (1 << 34) + F.col("bin_no") + (1 << 33)).alias("sequence_id"), "fill", *ARROW.names[4:]
        )
        for k in range(level + 1)
    ]
    out = rounds[0]
    for df in rounds[1:]:
        out = out.unionByName(df)
    return out


def pack(docs: DataFrame, path: str, **parameters: int) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (its place in the sequence)."""
    s = pack_sequences(docs, path, **parameters)
    at = F.expr("transform(sequence(1, size(length)), i -> aggregate(slice(length, 1, i - 1), 0L, (a, x) -> a + x))")
    bins = s.select("sequence_id", F.explode(F.arrays_zip("doc_id", "piece", "start", "length", "ids_crc32", at.alias("offset"))).alias("p"))
    return bins.select(
        F.col("p.doc_id").alias("doc_id"), F.col("p.piece").alias("piece"), F.col("p.start").alias("start"),
        F.col("p.length").cast("long").alias("length"), F.col("p.ids_crc32").alias("ids_crc32"), "sequence_id", F.col("p.offset").alias("offset"),
    )
