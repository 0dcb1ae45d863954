"""Support among all seeds of a document, however many there are and however many links they have.

What a pair shares through a node is summed where the node's links stand, packed by the pair's first seed, and met there by
that seed's documents. No row is made for a pair: a row holds a seed and, as bytes, numbers for the seeds after it. Nodes
with more than ``DEALT`` links (and ancestors) would make too many pairs; they travel with the seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import linked
from tesserae.operators.linked import packed, unpacked
from tesserae.operators.resolution import degree_penalty
from tesserae.storage import stored

#: Links of a node beyond which its pairs are made from documents.
DEALT = 300
#: Pairs that one vectorised step works on, and sums held before they are handed on.
PAIRS, SUMS = 1_000_000, 3_000_000
SEED = "doc long, qid string, local double, baseline double, penalty double"
PACKED = "others binary, shared binary, other binary"


def summed(key: np.ndarray, shared: np.ndarray, direct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry a key, in order: shared summed, the largest direct."""
    if not len(key):
        return key, shared, direct
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[at], np.add.reduceat(shared[order], at), np.maximum.reduceat(direct[order], at)


def following(n: np.ndarray) -> np.ndarray:
    """For rows of groups of the sizes ``n``: how many come after each in its group."""
    return np.repeat(np.cumsum(n), n) - np.arange(n.sum()) - 1


def by_first(key: np.ndarray, shared: np.ndarray, direct: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums by pair (first seed's number above 32 bits), packed by first seed."""
    left = key >> 32
    at = np.flatnonzero(np.diff(left, prepend=-1))
    n = np.diff(at, append=len(left))
    cols = [pa.array(left[at].astype("int32")), packed((key & 0xFFFFFFFF).astype("int32"), n), packed(shared, n), packed(direct, n)]
    t = pa.RecordBatch.from_arrays(cols, ["id", "others", "shared", "other"])
    yield from (t.slice(i, 500) for i in range(0, len(t), 500))


def through_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, others, shared, other): what pairs share through nodes, and the links of one to the other. batches: (node, kind, id,
    value) in the order of node, kind and id: a node's own row (kind 0; -1 for no entity, its step, or UP beyond DEALT), then its links."""
    none = np.empty(0, "int64"), np.empty(0), np.empty(0)
    held, sums = [], none

    def add(t: pa.Table) -> None:
        nonlocal sums
        new, kind, qid, value = linked.changed(t["node"]), t["kind"].to_numpy(), t["id"].to_numpy().astype("int64"), t["value"].to_numpy()
        g = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        if kind[first].any():
            raise ValueError("a linked node has no degree")
        own, step = qid[first][g], value[first].astype("int64")[g]
        on = kind == 1
        g, qid, value, own, step = g[on], qid[on], value[on], own[on], step[on]
        if not len(g):
            return
        at = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(qid, prepend=-1) != 0))  # the same link twice: the larger weight
        g, qid, value, own, step = g[at], qid[at], np.maximum.reduceat(value, at), own[at], step[at]
        d = (own >= 0) & (own != qid)
        found = [sums, (np.minimum(qid, own)[d] << 32 | np.maximum(qid, own)[d], np.zeros(d.sum()), value[d] * 0.75)]
        on = (step < linked.UP) & (own != qid)
        g, qid, value, step = g[on], qid[on], value[on], step[on]
        rest = following(np.unique(g, return_counts=True)[1])
        block = np.cumsum(rest) // PAIRS
        for b in np.unique(block):
            lo, hi = np.searchsorted(block, [b, b + 1])
            r = rest[lo:hi]
            left = np.repeat(np.arange(lo, hi), r)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)
            found.append(summed(qid[left] << 32 | qid[right], np.minimum(value[left], value[right]) * linked.SPECIFIC[step[left]], np.zeros(len(left))))
        sums = summed(*(np.concatenate(x) for x in zip(*found, strict=True)))

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < 5 * linked.ROWS:
            continue
        t = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(linked.changed(t["node"]))[-1])
        if cut:
            add(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
        if len(sums[0]) > SUMS:
            yield from by_first(*sums)
            sums = none
    if sum(x.num_rows for x in held):
        add(pa.Table.from_batches(held))
    yield from by_first(*sums)


def among_carried(t: pa.Table, left: np.ndarray, right: np.ndarray, links: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(shared, above) of pairs of rows, through the links that the rows carry."""
    row, node, step, weight, start, key = links
    shared, above = np.zeros(len(left)), np.zeros(len(left))
    own = pc.fill_null(t["id"].combine_chunks(), -1).to_numpy()
    n, i, p = np.diff(start), 0, np.arange(len(left))
    while len(p := p[n[left[p]] > i]):
        x = start[left[p]] + i
        kind = (step[x] >= linked.UP).astype("int64")
        want = (right[p] << 33) | (node[x] << 1) | kind
        spot = np.minimum(np.searchsorted(key, want), len(key) - 1)
        same = key[spot] == want
        q, x, y = p[same], x[same], spot[same]
        specific, up = linked.SPECIFIC[step[x] % linked.UP], step[x] >= linked.UP
        above[q[up]] += 0.3 * specific[up]
        near = ~up & (node[x] != own[left[q]]) & (node[x] != own[right[q]])
        shared[q[near]] += (np.minimum(weight[x], weight[y]) * specific)[near]
        i += 1
    return shared, above


def in_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each seed with the numbers of those after it in its document, and what it shares with them through carried links."""
    for t in linked.whole_documents(batches, 1 << 62):
        own = t["id"].to_numpy()
        row, node, step, weight = linked.flat(t)
        node, step = node.astype("int64"), step.astype("int64")
        key = (row << 33) | (node << 1) | (step >= linked.UP)
        order = np.argsort(key, kind="stable")
        row, node, step, weight, key = row[order], node[order], step[order], weight[order], key[order]
        links = row, node, step, weight, np.searchsorted(row, np.arange(len(t) + 1)), key
        rest = following(np.diff(np.flatnonzero(linked.changed(t["doc"])), append=len(t)))
        block = np.cumsum(rest) // PAIRS
        for b in np.unique(block):
            lo, hi = np.searchsorted(block, [b, b + 1])
            r = rest[lo:hi]
            left = np.repeat(np.arange(lo, hi), r)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)
            shared, above = among_carried(t, left, right, links)
            cols = [t[c].slice(lo, hi - lo) for c in ("id", "doc", "qid", "local", "baseline", "penalty")] + [packed(own[right], r), packed(shared, r), packed(above, r)]
            yield from pa.table(cols, ["id", "doc", "qid", "local", "baseline", "penalty", "others", "shared", "other"]).combine_chunks().to_batches()


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds with their support from those after them, in millionths: batches in the order of id and kind, sums (kind 0) first."""
    last = np.empty(0, "int64"), np.empty(0), np.empty(0)
    for b in batches:
        t = pa.Table.from_batches([b])
        ids = t["id"].to_numpy().astype("int64")
        head = t["kind"].to_numpy() == 0
        s = t.filter(pa.array(head))
        others, n = unpacked(s["others"], "int32")
        new = np.repeat(ids[head], n) << 32 | others, unpacked(s["shared"], "float64")[0], unpacked(s["other"], "float64")[0]
        known, shared, direct = summed(*(np.concatenate(x) for x in zip(last, new, strict=True)))
        end = np.searchsorted(known, ids[-1] << 32) if len(ids) else 0
        last = known[end:], shared[end:], direct[end:]
        d = t.filter(pa.array(~head))
        if not d.num_rows:
            continue
        others, n = unpacked(d["others"], "int32")
        more, above = unpacked(d["shared"], "float64")[0].copy(), unpacked(d["other"], "float64")[0]
        near = np.zeros(len(more))
        if len(known):
            want = np.repeat(ids[~head], n) << 32 | others.astype("int64")
            spot = np.minimum(np.searchsorted(known, want), len(known) - 1)
            same = known[spot] == want
            more[same] += shared[spot[same]]
            near[same] = direct[spot[same]]
        score = linked.rounded(np.minimum(1.0, near + np.minimum(more, 0.75) + np.minimum(above, 0.4)))
        cols = [d[c] for c in ("doc", "qid", "local", "baseline", "penalty")] + [packed(np.rint(score * 1e6).astype("int32"), n)]
        yield from pa.table(cols, ["doc", "qid", "local", "baseline", "penalty", "scores"]).combine_chunks().to_batches()


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds with the number of seeds of their document, the sum of their supports and how many support (.12 or more)."""
    for t in linked.whole_documents(batches, 1 << 62):
        score, rest = unpacked(t["scores"], "int32")
        size = np.diff(np.flatnonzero(linked.changed(t["doc"])), append=len(t))
        left = np.repeat(np.arange(len(t)), rest)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(rest) - rest, rest)
        total = np.bincount(left, score, len(t)) + np.bincount(right, score, len(t))
        good = score >= 120_000
        good = np.bincount(left[good], minlength=len(t)) + np.bincount(right[good], minlength=len(t))
        cols = [t[c] for c in ("doc", "qid", "local", "baseline", "penalty")] + [pa.array(np.repeat(size, size)), pa.array(total / 1e6), pa.array(good)]
        yield from pa.table(cols, ["doc", "qid", "local", "baseline", "penalty", "seeds", "sum", "supporting"]).combine_chunks().to_batches()


def supports(seeds: DataFrame, entities: DataFrame, neighbours: DataFrame, ancestors: DataFrame, degrees: DataFrame) -> DataFrame:
    """(doc, qid, local, baseline, penalty, seeds, sum, supporting) of all seeds (doc, qid, local, baseline), doc a long.

    entities: (qid), all that can be seeds; neighbours: (qid, neighbour, weight), the largest weight counts; ancestors: (qid,
    ancestor); degrees: (node, degree_total) of every node, one row each.
    """
    nodes = linked.numbered(degrees.where("node IS NOT NULL").select("node", F.col("degree_total").cast("long")))
    named = nodes.join(entities.select(F.col("qid").alias("node")).distinct(), "node", "left_semi")
    own = stored(named.select(F.col("node").alias("qid"), "id", degree_penalty(F.col("degree_total")).alias("penalty")), "entities")
    near = neighbours.where("qid IS NOT NULL AND neighbour IS NOT NULL").join(own, "qid")
    near = stored(near.select(F.col("neighbour").alias("node"), "id", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("value")), "near")
    # links that travel with seeds
    heavy, step = nodes.where(F.col("degree_total") > DEALT), linked.degree_step(F.col("degree_total"))
    above = ancestors.where("qid IS NOT NULL AND ancestor IS NOT NULL").select("qid", F.col("ancestor").alias("node")).distinct().join(own, "qid")
    carried = above.select("node", F.col("id").alias("own"), F.lit(0.3).alias("weight"), F.lit(linked.UP).alias("kind"))
    if not heavy.isEmpty():
        some = near.join(heavy.select("node"), "node").groupBy("node", F.col("id").alias("own")).agg(F.max("value").alias("weight"))
        carried = carried.unionByName(some.withColumn("kind", F.lit(0)))
    carried = carried.join(nodes, "node").select("own", F.struct("id", (step + F.col("kind")).cast("tinyint").alias("step"), "weight").alias("link"))
    lists = carried.groupBy(F.col("own").alias("id")).agg(F.sort_array(F.collect_list("link")).alias("x"))
    own = own.join(lists, "id", "left").select("qid", "id", "penalty", F.col("x.id").alias("nodes"), F.col("x.step").alias("steps"), F.col("x.weight").alias("weights"))
    own = stored(own.mapInArrow(linked.as_bytes, "qid string, id int, penalty double, nodes binary, steps binary, weights binary"), "carried")
    # pairs through nodes: rows in the order of nodes, so that what belongs together is summed in one task
    entity = own.select("id", F.lit(True).alias("entity"))
    heads = nodes.join(entity, "id", "left").select(
        "node", F.when(F.col("entity"), F.col("id")).otherwise(-1).alias("id"), F.when(F.col("degree_total") > DEALT, linked.UP).otherwise(step).cast("double").alias("value"), F.lit(0).alias("kind")
    )
    rows = heads.unionByName(near.withColumn("kind", F.lit(1))).repartitionByRange("node").sortWithinPartitions("node", "kind", "id")
    sums = rows.mapInArrow(through_nodes, f"id int, {PACKED}")
    # seeds by document, by first seed, by document again
    rows = seeds.where("doc IS NOT NULL AND qid IS NOT NULL").select("doc", "qid", "local", "baseline").join(own, "qid", "left")
    rows = rows.withColumn("id", F.coalesce("id", -1 - F.pmod(F.hash("qid"), F.lit(1_000_000))))  # a seed without links
    given = rows.repartition("doc").sortWithinPartitions("doc", "qid").mapInArrow(in_documents, f"id int, {SEED}, {PACKED}")
    every = sums.withColumn("kind", F.lit(0)).unionByName(given.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    every = every.repartition("id").sortWithinPartitions("id", "kind").mapInArrow(met, f"{SEED}, scores binary")
    return every.repartition("doc").sortWithinPartitions("doc", "qid").mapInArrow(totals, f"{SEED}, seeds long, sum double, supporting long")


def decisions(supported: DataFrame, min_seeds: int, light: bool) -> DataFrame:
    """``linked.DECIDED`` of ``supports``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            cols = [t["doc"], t["qid"], *linked.decided(t, *(t[c].to_numpy() for c in ("seeds", "sum", "supporting")), min_seeds, light)]
            yield from pa.table(cols, ["doc", "qid", *(x.split()[0] for x in linked.DECIDED.split(", "))]).combine_chunks().to_batches()

    return supported.mapInArrow(run, f"doc long, qid string, {linked.DECIDED}")
