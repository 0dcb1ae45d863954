"""Graph context of a document's linked entities: pairwise support, decisions on seeds, and related entities.

A document's seeds are bounded, and so are a seed's neighbours and ancestors in the tables given. Seeds travel with their
links (``linked``) and are dealt out by document once; pairs, decisions and related entities are made where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import linked, peers


def local_score(baseline: Column, mentions: Column, start_ratio: Column, actor: Column) -> Column:
    """Baseline, .04 for each further mention up to .12, and place: actors in the body gain, single late mentions lose."""
    place = F.when((mentions == 1) & (start_ratio >= 0.8), -0.08).when(actor & start_ratio.between(0.08, 0.74), 0.04).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), baseline + F.least(F.lit(0.12), F.greatest(F.lit(0), mentions - 1) * 0.04) + place))


def six_places(value: Column) -> Column:
    """Six places, half up. What lies beyond twelve places is noise of the sum's order and decides no tie; for |value| < 1e8."""
    return F.round(value.try_cast("decimal(20,12)"), 6).cast("double")


def pair_supports(seeds: DataFrame, links: DataFrame, most: int = 24) -> DataFrame:
    """(left, right, score) of the distinct pairs of seeds (doc, qid, local, baseline) that a document holds, left < right.

    Of a document the ``most`` best seeds count, by local score and then id. Support is direct links (weight times .75, the
    stronger way), nodes that both are linked to (the weaker weight times the node's specificity, .75 at most) and ancestors
    that both have (.3 times specificity, .4 at most), 1 at most. links: of ``linked.links``.
    """
    found = linked.side_by_side(seeds, links).mapInArrow(linked.pairs(most), "left string, right string, score double")
    return found.withColumn("score", F.round("score", 6)).groupBy("left", "right").agg(F.max("score").alias("score"))


def seed_decisions(seeds: DataFrame, links: DataFrame, min_seeds: int = 2, light: bool = True, most: int = 24, carry: bool = True) -> DataFrame:
    """(doc, qid, baseline, seeds, mean_peer_support, supporting, cluster_fit, action, score_delta) of the ``most`` best seeds
    (doc, qid, local, baseline) of each document, by local score and then id; carry: with their links (``linked.LINKS``).

    An isolated or unsupported seed of three or more is suppressed, a weak one downgraded, a well supported one boosted;
    of two seeds a generic unsupported one is downgraded, a supported one boosted; all others are kept. The rows of a
    document stand together, as ``related_entities`` needs them.
    """
    near = linked.side_by_side(seeds, links)
    decided = T.StructType.fromDDL(linked.DECIDED).fields
    schema = T.StructType([near.schema["doc"], near.schema["qid"], *decided, *(near.schema[c] for c in linked.LINKS if carry)])
    return near.mapInArrow(linked.peers(most, min_seeds, light, carry), schema)


def whole_decisions(seeds: DataFrame, entities: DataFrame, neighbours: DataFrame, ancestors: DataFrame, degrees: DataFrame, min_seeds: int = 2, light: bool = True) -> DataFrame:
    """``seed_decisions`` of all seeds of each document, with all their links; tables as ``peers.supports`` takes them."""
    return peers.decisions(peers.supports(seeds, entities, neighbours, ancestors, degrees), min_seeds, light)


def strong_seeds(decisions: DataFrame) -> DataFrame:
    """Decisions with ``strong``, whether related entities are looked for from the seed: boosted ones, and kept ones that fit or
    are supported. A column and no filter, which would compute the decision's sums again for each condition."""
    fit, mean = F.col("cluster_fit"), F.col("mean_peer_support")
    good = (fit >= 0.35) | (mean >= 0.1) | ((F.col("supporting") > 0) & (fit >= 0.3))
    return decisions.withColumn("strong", F.coalesce((F.col("action") == "boost") | ((F.col("action") == "keep") & good), F.lit(False)))


def related_entities(strong: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """(doc, qid, seeds, score, rank): nodes that two or more strong seeds of a document are linked to or descend from.

    strong: of ``strong_seeds``, in the order of ``seed_decisions``, with links; nodes: (node, id) of ``linked.links``.
    Support is the sum of link weights, .3 an ancestor. More seeds, short ways and both kinds of support add; the sum is
    multiplied by specificity, generic nodes and those with ancestors' support alone lose. The best ``limit`` stay.
    """
    schema = T.StructType([strong.schema["doc"]]).add("id", "integer").add("seeds", "long").add("score", "double").add("rank", "integer")
    found = strong.select("doc", "qid", "strong", *linked.LINKS).mapInArrow(linked.related(limit), schema)
    return found.join(nodes, "id").select("doc", F.col("node").alias("qid"), "seeds", "score", "rank")


def gate_candidates(candidates: DataFrame, supports: DataFrame, least: int = 1, step: float = 0.04, most: float = 0.12) -> DataFrame:
    """Candidates (doc, qid, score) that support (doc, qid, seeds) admits, with a bonus for each supporting seed."""
    hit = candidates.join(supports.select("doc", "qid", "seeds"), ["doc", "qid"]).where(F.col("seeds") >= least)
    return hit.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + F.least(F.lit(most), F.col("seeds") * step)), 6))


def moved(score: Column, delta: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + F.coalesce(delta, F.lit(0.0)))), 6)


def refined(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mentions (doc, qid, score) after the decisions: suppressed ones dropped, the others' scores moved, 0 to 1."""
    rows = mentions.join(decisions.select("doc", "qid", "action", "score_delta"), ["doc", "qid"], "left").where(~F.col("action").eqNullSafe("suppress"))
    return rows.withColumn("score", moved(F.col("score"), F.col("score_delta"))).drop("score_delta")


def refined_seeds(decisions: DataFrame) -> DataFrame:
    """(doc, qid, score, action): ``refined`` of the seeds themselves, whose score is their baseline; nothing is joined."""
    return decisions.where("action <> 'suppress'").select("doc", "qid", moved(F.col("baseline"), F.col("score_delta")).alias("score"), "action")
