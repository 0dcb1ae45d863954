"""Seeds of documents side by side with their links, so that a document's pairs are weighed where its seeds are.

Each seed carries its links (bounded in the tables given) as numbers in bytes, and is dealt out by document once; no row
is made for a pair and a link. ``links`` numbers the nodes in their order, so equal scores can be ranked by number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.resolution import degree_penalty
from tesserae.storage import stored

#: Degrees up to which specificity or penalty changes, and both (``resolution.degree_specificity``, ``degree_penalty``) by step.
STEPS = (4, 16, 48, 64, 128, 256)
SPECIFIC = np.array([1.0, 0.82, 0.58, 0.58, 0.32, 0.32, 0.12])
PENALTY = np.array([0.0, 0.0, 0.04, 0.08, 0.08, 0.12, 0.18])
#: What a seed carries; the step of its links goes by the node's degree, ``UP`` more where the node is an ancestor.
UP = 8
LINKS = ["own", "nodes", "steps", "weights"]
#: Rows that one vectorised step works on, beside the rest of its last document.
ROWS = 10_000


def degree_step(degree: Column) -> Column:
    step = F.lit(len(STEPS))
    for i, most in reversed(list(enumerate(STEPS))):
        step = F.when(degree <= most, i).otherwise(step)
    return step.cast("tinyint")


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, ...), one row a node, with ``id``: whole numbers from 0 in the order of the nodes."""
    rows = stored(nodes.orderBy("node").withColumn("at", F.monotonically_increasing_id()), "nodes")
    sizes, start, starts = rows.groupBy(F.shiftright("at", 33).alias("p")).count().collect(), 0, {}
    for p, n in sorted(map(tuple, sizes)):
        starts[p], start = start, start + n
    if not starts:
        return rows.select(*nodes.columns, F.lit(0).alias("id"))
    first = F.element_at(F.create_map(*(F.lit(x) for item in starts.items() for x in item)), F.shiftright("at", 33))
    return rows.select(*nodes.columns, (first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("id"))


def packed(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary value for each of ``n``: that many of ``flat``, one after the other."""
    ends = np.concatenate([[0], np.cumsum(n)]) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype("int32")), pa.py_buffer(np.ascontiguousarray(flat))])


def unpacked(x: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many of each value)."""
    x = pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], pa.binary())
    size = np.dtype(kind).itemsize
    ends = np.frombuffer(x.buffers()[1], "int32", len(x) + 1, x.offset * 4) if len(x) else np.zeros(1, "int32")
    raw = x.buffers()[2]
    return (np.frombuffer(raw, "u1")[ends[0] : ends[-1]].view(kind) if raw else np.empty(0, kind)), np.diff(ends) // size


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``nodes``, ``steps`` and ``weights`` (last three columns, arrays) as bytes, which Spark copies whole."""
    for b in batches:
        n = pc.fill_null(pc.list_value_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        lists = [packed(x.flatten().to_numpy(), n) for x in b.columns[-3:]]
        yield pa.RecordBatch.from_arrays(b.columns[:-3] + lists, names=b.schema.names)


def links(neighbours: DataFrame, ancestors: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, own, penalty, nodes, steps, weights) of everything that has links or a degree, stored, and (node, id).

    neighbours: (qid, neighbour, weight), the largest weight counts; ancestors: (qid, ancestor); degrees: (node, degree_total).
    own is a qid's own number, penalty that of its own degree. A node without a degree counts as specific.
    """
    near = neighbours.where("qid IS NOT NULL AND neighbour IS NOT NULL").groupBy("qid", F.col("neighbour").alias("node")).agg(F.max("weight").alias("weight"))
    above = ancestors.where("qid IS NOT NULL AND ancestor IS NOT NULL").select("qid", F.col("ancestor").alias("node")).distinct()
    ends = near.select(F.explode(F.array("qid", "node")).alias("node")).unionByName(above.select(F.explode(F.array("qid", "node")).alias("node")))
    every = ends.withColumn("degree_total", F.lit(0).cast("long")).unionByName(degrees.where("node IS NOT NULL").select("node", F.col("degree_total").cast("long")))
    nodes = numbered(every.groupBy("node").agg(F.max("degree_total").alias("degree_total")))
    rows = near.select("qid", "node", "weight", F.lit(0).alias("kind")).unionByName(above.select("qid", "node", F.lit(0.3).alias("weight"), F.lit(UP).alias("kind")))
    step, weight = (degree_step(F.col("degree_total")) + F.col("kind")).cast("tinyint"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    rows = rows.join(nodes, "node").select("qid", F.struct("id", step.alias("step"), weight.alias("weight")).alias("link"))
    lists = rows.groupBy("qid").agg(F.sort_array(F.collect_list("link")).alias("x"))
    own = nodes.select(F.col("node").alias("qid"), F.col("id").alias("own"), degree_penalty(F.col("degree_total")).alias("penalty"))
    found = own.join(lists, "qid", "left").select("qid", "own", "penalty", F.col("x.id").alias("nodes"), F.col("x.step").alias("steps"), F.col("x.weight").alias("weights"))
    found = found.mapInArrow(as_bytes, "qid string, own int, penalty double, nodes binary, steps binary, weights binary")
    return stored(found, "links"), nodes.select("node", "id")


def side_by_side(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Seeds (doc, qid, local, baseline) with their links, a document's in one partition one after the other."""
    rows = seeds.where("doc IS NOT NULL AND qid IS NOT NULL").select("doc", "qid", "local", "baseline").join(links, "qid", "left")
    return rows.repartition("doc").sortWithinPartitions("doc", "qid")


def changed(x: pa.ChunkedArray) -> np.ndarray:
    """Whether each row differs from the one before it; true for the first."""
    x = x.combine_chunks()
    new = np.ones(len(x), bool)
    new[1:] = pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return new


def best_seeds(t: pa.Table, most: int, open_end: bool = False) -> pa.Table:
    """One row a document and seed, the ``most`` best of a document by local score, then id. open_end: the last seed may go on
    in rows to come, so it stays too."""
    start = changed(t["doc"])
    new = start | changed(t["qid"])
    if not new.all():
        at = np.flatnonzero(new)
        top = {c: np.fmax.reduceat(t[c].to_numpy(), at) for c in ("local", "baseline")}
        t, start = t.take(pa.array(at)), start[at]
        for c, v in top.items():
            t = t.set_column(t.schema.get_field_index(c), c, pa.array(v, from_pandas=True))
    g = np.cumsum(start) - 1
    if len(g) and np.bincount(g).max() > most:
        order = np.lexsort((-t["local"].to_numpy(), g))
        keep = np.empty(len(g), bool)
        keep[order] = np.arange(len(g)) - np.flatnonzero(start)[g] < most
        keep[-1] |= open_end
        t = t.filter(pa.array(keep))
    return t


def whole_documents(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole documents, their seeds bounded; of a document that goes on without end only its best seeds are held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < ROWS:
            continue
        t = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(changed(t["doc"]))[-1])
        if cut:
            yield best_seeds(t.slice(0, cut), most)
        held = best_seeds(t.slice(cut), most, open_end=True).combine_chunks().to_batches()
    if sum(x.num_rows for x in held):
        yield best_seeds(pa.Table.from_batches(held), most)


def flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, step, weight) of all links."""
    (nodes, n), (steps, _), (weights, _) = (unpacked(t[c], kind) for c, kind in (("nodes", "int32"), ("steps", "int8"), ("weights", "float64")))
    return np.repeat(np.arange(len(n)), n), nodes, steps, weights


def by_document(t: pa.Table, node: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A number for each link's (document, node), one for each row's (document, own node), -1 for none, and each row's document;
    and for each row whether anything links to its node."""
    g = np.cumsum(changed(t["doc"])) - 1
    names, at = np.unique(node, return_inverse=True)
    own = pc.fill_null(t["own"].combine_chunks(), -1).to_numpy()
    spot = np.minimum(np.searchsorted(names, own), max(len(names) - 1, 0))
    known = names[spot] == own if len(names) else np.zeros(len(own), bool)
    return g[row] * len(names) + at, np.where(known, g * len(names) + spot, -1), g, known


def rounded(x: np.ndarray) -> np.ndarray:
    """Six places, half up, as Spark rounds a double: by the digits it is written with."""
    y = np.floor(x * 1e6 + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(x * 1e6 - np.floor(x * 1e6) - 0.5) < 1e-4):
        y[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return y


def weighed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left row, right row, support) of all pairs of seeds of a document; the rows of a document are in the order of their ids."""
    row, node, step, weight = flat(t)
    key, own, g, known = by_document(t, node, row)
    rest = np.bincount(g)[g] - 1 - (np.arange(len(g)) - np.flatnonzero(np.diff(g, prepend=-1))[g])  # seeds after each in its document
    first = np.cumsum(rest) - rest
    left = np.repeat(np.arange(len(g)), rest)
    right = np.arange(len(left)) - first[left] + left + 1
    direct, shared, above = (np.zeros(len(left)) for _ in range(3))
    # nodes that both are linked to, and ancestors that both have: equal keys stand together, their rows in order
    order = np.argsort(key * 2 + (step >= UP), kind="stable")
    k, r, w, s, n = (key * 2 + (step >= UP))[order], row[order], weight[order], step[order], key[order]
    i = np.arange(len(k))
    for d in range(1, len(k)):
        i = i[: np.searchsorted(i, len(k) - d)]
        i = i[k[i] == k[i + d]]
        if not len(i):
            break
        a, b = r[i], r[i + d]
        pair, up = first[a] + b - a - 1, s[i] >= UP
        specific = SPECIFIC[s[i] % UP]
        above += np.bincount(pair[up], 0.3 * specific[up], len(left))
        near = ~up & (n[i] != own[a]) & (n[i] != own[b])
        shared += np.bincount(pair[near], (np.minimum(w[i], w[i + d]) * specific)[near], len(left))
    # links to another seed of the document
    seeds = np.flatnonzero(known)
    if len(seeds):
        seeds = seeds[np.argsort(own[seeds], kind="stable")]
        hit = np.flatnonzero(step < UP)
        spot = np.minimum(np.searchsorted(own[seeds], key[hit]), len(seeds) - 1)
        hit, other = hit[same := own[seeds][spot] == key[hit]], seeds[spot[same]]
        hit, other = hit[same := row[hit] != other], other[same]
        a, b = np.minimum(row[hit], other), np.maximum(row[hit], other)
        np.maximum.at(direct, first[a] + b - a - 1, weight[hit] * 0.75)
    return left, right, np.minimum(1.0, direct + np.minimum(shared, 0.75) + np.minimum(above, 0.4))


def pairs(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_documents(batches, most):
            left, right, score = weighed(t)
            qid = t["qid"].combine_chunks()
            yield pa.RecordBatch.from_arrays([qid.take(pa.array(left)), qid.take(pa.array(right)), pa.array(score)], ["left", "right", "score"])

    return run


#: What a decision is, beside its document and seed.
DECIDED = "baseline double, seeds long, mean_peer_support double, supporting long, cluster_fit double, action string, score_delta double"
ACTIONS = pa.array(["keep", "suppress", "downgrade", "boost"])


def six_places(x: np.ndarray) -> np.ndarray:
    """Six places, half up, of |x| < 1,000. What lies beyond twelve places is noise of the sum's order and decides no tie."""
    return np.sign(x) * ((np.floor(np.abs(x) * 1e12 + 0.5).astype("int64") + 500_000) // 1_000_000) / 1e6


def decided(t: pa.Table, seeds: np.ndarray, total: np.ndarray, supporting: np.ndarray, min_seeds: int, light: bool) -> list[pa.Array]:
    """The columns ``DECIDED`` of seeds (local, baseline, penalty), given the number of seeds of their document, the sum of
    their supports and how many support. Each value is made once; as Spark columns the conditions would make it many times."""
    local, base, penalty = (t[c].to_numpy() for c in ("local", "baseline", "penalty"))
    mean = six_places(total / np.maximum(seeds - 1, 1))
    fit = six_places(np.fmax(0.0, 0.45 * local + 0.55 * mean - np.nan_to_num(penalty)))
    s, needed, many, two = supporting, np.minimum(max(min_seeds - 1, 1), np.maximum(seeds - 1, 1)), seeds >= 3, seeds == 2
    isolated = (s == 0) & (mean <= 0.03) & (local < 0.56) & (fit < 0.26)
    alone = (s < needed) & (mean < 0.12) & (local < (0.52 if light else 0.58)) & (fit < 0.28)
    weak = (mean < 0.14) & (local < 0.56) & (fit < 0.38)
    action = np.select(
        [many & (isolated | alone), many & weak, many & (s >= needed) & (mean >= 0.45) & (base < 0.82),
         two & (s == 0) & (local < 0.45) & (penalty >= 0.08) & (fit < 0.38), two & (s > 0) & (mean >= 0.55) & (base < 0.82)], [1, 2, 3, 2, 3], 0,
    )
    delta = np.select(
        [many & (action == 2), action == 2, many & (action == 3), action == 3],
        [-0.06 if light else -0.08, -0.05, np.minimum(0.08 if light else 0.11, mean * 0.18), np.minimum(0.07, mean * 0.16)], 0.0,
    )
    return [t["baseline"], *map(pa.array, (seeds.astype("int64"), mean, s.astype("int64"), fit)), ACTIONS.take(pa.array(action)), pa.array(six_places(delta))]


def peers(most: int, min_seeds: int, light: bool, carry: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc, qid), ``DECIDED`` and, to carry, ``LINKS`` of the seeds, by the supports of the other seeds of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_documents(batches, most):
            left, right, score = weighed(t)
            score = rounded(score)
            g = np.cumsum(changed(t["doc"])) - 1
            total = np.bincount(left, score, len(g)) + np.bincount(right, score, len(g))
            good = np.bincount(left, score >= 0.12, len(g)) + np.bincount(right, score >= 0.12, len(g))
            cols = [t["doc"], t["qid"], *decided(t, np.bincount(g)[g], total, good, min_seeds, light), *(t[c] for c in LINKS if carry)]
            yield from pa.table(cols, ["doc", "qid", *(x.split()[0] for x in DECIDED.split(", ")), *LINKS[: len(LINKS) * carry]]).combine_chunks().to_batches()

    return run


def related(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc, id, seeds, score, rank) of the best ``limit`` nodes that two or more strong rows of a document are linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_documents(batches, 1 << 30):
            t = t.filter(t["strong"])
            row, node, step, weight = flat(t)
            key, own, g, _ = by_document(t, node, row)
            order = np.argsort(key, kind="stable")  # the rows of a node stay in order
            k, r, s = key[order], row[order], step[order]
            at = np.flatnonzero(np.diff(k, prepend=-1))
            if not len(at):
                continue
            new = np.diff(r, prepend=-1) != 0
            new[at] = True
            seeds, support = np.add.reduceat(new.astype("int64"), at), np.add.reduceat(weight[order], at)
            ups, n = np.add.reduceat((s >= UP).astype("int64"), at), np.diff(at, append=len(k))
            keep = (seeds >= 2) & ~np.isin(k[at], own)
            at, seeds, support, ups, n = at[keep], seeds[keep], support[keep], ups[keep], n[keep]
            bonus = np.minimum(0.36, (seeds - 1) * 0.18) + np.where(ups < n, 0.08, 0.04) + np.where((ups > 0) & (ups < n), 0.06, 0.0)
            loss = np.where(ups < n, 0.0, np.where(seeds <= 2, 0.06, 0.03))
            kind = s[at] % UP
            score = rounded(np.maximum(0.0, np.minimum(1.0, (support + bonus) * SPECIFIC[kind] - PENALTY[kind] - loss)))
            ids, docs = node[order][at], g[r[at]]
            order = np.lexsort((ids, -score, docs))
            order = order[score[order] > 0]
            docs = docs[order]
            rank = np.arange(len(docs)) - np.searchsorted(docs, docs) + 1
            order, docs, rank = order[rank <= limit], docs[rank <= limit], rank[rank <= limit]
            doc = t["doc"].combine_chunks().take(pa.array(np.flatnonzero(np.diff(g, prepend=-1))[docs]))
            cols = [doc, pa.array(ids[order].astype("int32")), pa.array(seeds[order]), pa.array(score[order]), pa.array(rank.astype("int32"))]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "id", "seeds", "score", "rank"])

    return run
