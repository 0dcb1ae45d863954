"""Relations of edges by a catalogue: a table with one row a relation, joined as a dimension.

Catalogue columns: relation, family, event_types, preconditions, source_types, target_types, evidence (arrays of names
but for family), conflict_policy, direction. It holds a row a kind of edge; Spark broadcasts it where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"family": "other", "conflict_policy": "keep_all", "direction": "source_to_target"}


def codes(*conditions: tuple[str, Column]) -> Column:
    """The names of the conditions that hold (null as not), in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions)))


def canonical_type(kind: Column, names: dict[str, str]) -> Column:
    """The canonical name of a node type, without regard to case; unknown ones in lower case."""
    low = F.lower(F.trim(kind))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[low], low) if names else low


def with_catalogue(edges: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Edges (relation, ...) with their relation's properties; an edge's own event types, if it has any, stand over those of the
    catalogue."""
    own = "event_types" in edges.columns
    rows = edges.withColumnRenamed("event_types", "__own") if own else edges
    rows = rows.join(catalogue, "relation", "left").fillna(DEFAULTS)
    lists = ("event_types", "preconditions", "source_types", "target_types", "evidence")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists})
    if own:
        rows = rows.withColumn("event_types", F.when(F.size("__own") > 0, F.col("__own")).otherwise(F.col("event_types"))).drop("__own")
    return rows


def metadata_warnings(known_events: list[str], given: str = "given_events") -> Column:
    """Warning codes of an edge with its relation's properties (columns source_type, target_type, given evidence fields and
    events): types that the relation does not allow, evidence that is missing, events that are unknown or not the relation's."""
    return codes(
        ("unknown_relation", F.col("family") == DEFAULTS["family"]),
        ("source_type_not_allowed", (F.size("source_types") > 0) & ~F.array_contains("source_types", F.col("source_type"))),
        ("target_type_not_allowed", (F.size("target_types") > 0) & ~F.array_contains("target_types", F.col("target_type"))),
        ("evidence_missing", F.size(F.array_except("evidence", "fields")) > 0),
        ("event_unknown", F.size(F.array_except(given, F.array(*map(F.lit, known_events)))) > 0),
        ("event_not_of_relation", F.size(F.array_except(given, "event_types")) > 0),
    )


def event_gated(edges: DataFrame, gated: list[str], context: Column) -> DataFrame:
    """Edges that stay in a context of events (an array): gated relations need one of their event types in it."""
    return edges.where(~F.col("relation").isin(gated) | F.arrays_overlap(F.transform("event_types", lambda e: F.lower(e)), context))


def attribution_warnings(name: Column, url: Column, snapshot: Column) -> Column:
    """Warning codes of a row's source: no name, no address, an address without a scheme, no snapshot or one that is no date."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return codes(
        ("source_name_missing", blank(name)), ("source_url_missing", blank(url)), ("source_url_without_scheme", ~blank(url) & ~url.rlike("^https?://")),
        ("snapshot_missing", blank(snapshot)), ("snapshot_no_date", ~blank(snapshot) & ~snapshot.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")),
    )


def tier_policy(tier: Column, policies: dict[str, list[str]], otherwise: str = "review") -> Column:
    """The policy bucket whose tiers hold a source's tier."""
    chain = F.lit(otherwise)
    for name, tiers in policies.items():
        chain = F.when(tier.isin(tiers), name).otherwise(chain)
    return chain


def row_edges(rows: DataFrame, specs: list[tuple[Column, str, Column, Column]]) -> DataFrame:
    """(src, relation, dst, confidence): the edges that each source row stands for, one for each (src, relation, dst,
    confidence) whose ends are both there; a narrow flat-map."""
    made = [F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("src"), F.lit(r).alias("relation"), b.alias("dst"), c.alias("confidence"))) for a, r, b, c in specs]
    return rows.select(F.inline(F.array_compact(F.array(*made))))
