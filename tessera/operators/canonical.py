"""Canonical entities from clusters: ids, record maps, survivorship and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components

POLICIES = ("PREFERRED_SOURCE", "MOST_RECENT_VALID", "MOST_COMPLETE", "CONSENSUS", "REVIEW_REQUIRED")


def entity_id(kind: str, members: Column, version: str = "1") -> Column:
    """A hash of the entity's kind, its sorted members and the version; the same whatever their order."""
    return F.concat(F.lit("entity_"), F.substring(F.sha2(F.to_json(F.struct(F.array_sort(members).alias("members"), F.lit(kind).alias("type"), F.lit(version).alias("version"))), 256), 1, 32))


def record_map(records: DataFrame, clusters: DataFrame, kind: str, event: bool = False, ref: str = "record_ref") -> DataFrame:
    """(record_ref, canonical_ref, disposition) for every record: those of accepted clusters are consolidated, others stand alone."""
    accepted = clusters.where("decision = 'CANDIDATE_CLUSTER'").select(entity_id(kind, F.col("members")).alias("shared"), F.explode("members").alias(ref))
    joined = records.select(ref).join(accepted, ref, "left")
    single = entity_id(kind, F.array(F.col(ref)))
    lone = F.col("shared").isNull() | F.lit(event)
    return joined.select(ref, F.when(lone, single).otherwise(F.col("shared")).alias("canonical_ref"), F.when(lone, "EMITTED_DIRECT").otherwise("CONSOLIDATED").alias("disposition"))


def survivors(values: DataFrame, policy: str, priority: tuple[str, ...] = ()) -> DataFrame:
    """(canonical_ref, attribute, value, value_ref, conflict, state) from (canonical_ref, attribute, value_ref, source_id, value, observed_at).

    Ties go to the smallest value_ref. conflict names what kept a value from being chosen, or that others differed.
    """
    if policy not in POLICIES:
        raise ValueError(f"UNKNOWN_SURVIVORSHIP_POLICY: {policy}")
    rank = F.lit(0)
    able = F.lit(True)
    if policy == "PREFERRED_SOURCE":
        rank = F.array_position(F.lit(list(priority)), F.col("source_id")) if priority else F.lit(0)
        able = rank > 0
    elif policy == "MOST_RECENT_VALID":
        rank = -F.unix_micros(F.col("observed_at").cast("timestamp"))
    elif policy == "MOST_COMPLETE":
        able = F.col("value").isNotNull()
    # the best value is a smallest struct, so a group of any size is put together before it is shuffled
    best = F.min(F.struct((~able).cast("int").alias("unable"), rank.isNull().alias("unranked"), rank.alias("rank"), "value_ref", "value")).alias("best")
    kinds, undated = F.countDistinct("value").alias("kinds"), F.count_if(F.col("observed_at").isNull()).alias("undated")
    first = values.groupBy("canonical_ref", "attribute").agg(best, kinds, undated).select("canonical_ref", "attribute", "kinds", "undated", (F.col("best.unable") == 0).alias("able"), "best.value_ref", "best.value")
    if policy == "PREFERRED_SOURCE":
        chosen, reason = F.col("able"), F.lit("MISSING_AUTHORITY_CONFLICT")
    elif policy == "MOST_RECENT_VALID":
        chosen, reason = F.col("undated") == 0, F.lit("TEMPORAL_CONFLICT")
    elif policy == "MOST_COMPLETE":
        chosen, reason = F.col("able"), F.lit("NO_COMPLETE_VALUE")
    elif policy == "CONSENSUS":
        chosen, reason = F.col("kinds") == 1, F.lit("DIFFERING_SOURCE_VALUES")
    else:
        chosen, reason = F.lit(False), F.lit("MISSING_AUTHORITY_CONFLICT")
    differ = F.when(chosen & (F.col("kinds") > 1), "DIFFERING_SOURCE_VALUES").when(~chosen, reason)
    return first.select(
        "canonical_ref",
        "attribute",
        F.when(chosen, F.col("value")).alias("value"),
        F.when(chosen, F.col("value_ref")).alias("value_ref"),
        differ.alias("conflict"),
        F.when(~chosen, "REVIEW_REQUIRED").when(F.col("kinds") > 1, "RESOLVED_BY_POLICY").otherwise("NO_CONFLICT").alias("state"),
    )


def memberships(clusters: DataFrame, edges: DataFrame, kind: str, max_members: int = 50) -> DataFrame:
    """(cluster, canonical_ref, record_ref, size, state): a proposed member for each record of the clusters; all are for review.

    clusters: (cluster, record_ref, decision); edges: (l, r), the links. A cluster that its own links don't hold together
    is refused, so that a label alone proves nothing. One of more than max_members has no entity proposed.
    """
    sides = clusters.select(F.col("record_ref").alias("l"), F.col("cluster").alias("_a")), clusters.select(F.col("record_ref").alias("r"), F.col("cluster").alias("_b"))
    inside = edges.join(sides[0], "l").join(sides[1], "r").where("_a = _b").select("l", "r")
    reached = connected_components(inside, "l", "r").join(clusters.select(F.col("record_ref").alias("node"), "cluster"), "node")
    parts = reached.groupBy("cluster").agg(F.countDistinct("component").alias("parts"), F.count("*").alias("linked"))
    known = clusters.groupBy("cluster").agg(F.count("*").alias("size")).join(parts, "cluster", "left")
    whole = F.coalesce((F.col("size") == 1) | ((F.col("parts") == 1) & (F.col("linked") == F.col("size"))), F.lit(False))
    names = clusters.join(known.where(F.col("size") <= max_members).select("cluster"), "cluster").groupBy("cluster").agg(entity_id(kind, F.collect_set("record_ref")).alias("canonical_ref"))
    accepted = (F.col("decision") == "CANDIDATE_CLUSTER") & (F.col("size") <= max_members)
    state = F.when(~F.col("_whole"), "REFUSED_DISCONNECTED").when(accepted, "PROPOSED").otherwise("REVIEW_REQUIRED")
    judged = clusters.join(known.select("cluster", "size", whole.alias("_whole")), "cluster").join(names, "cluster", "left")
    return judged.select("cluster", F.when(F.col("_whole"), F.col("canonical_ref")).alias("canonical_ref"), "record_ref", "size", state.alias("state"))


def conflict_records(values: DataFrame) -> DataFrame:
    """(canonical_ref, attribute, kind, candidates, values): attributes whose sources differ, with how many values and how many rows say them.

    values: (canonical_ref, attribute, source_id, value). Differing texts that are the same but for case and white space
    are a matter of form.
    """
    each = values.where("value IS NOT NULL").groupBy("canonical_ref", "attribute", "value").agg(F.count("*").alias("n"))
    one = each.groupBy("canonical_ref", "attribute").agg(F.count("*").alias("candidates"), F.sum("n").alias("values"), F.countDistinct(F.lower(F.regexp_replace(F.trim("value"), r"\s+", " "))).alias("forms"))
    return one.where("candidates > 1").select("canonical_ref", "attribute", F.when(F.col("forms") == 1, "FORMAT_CONFLICT").otherwise("VALUE_CONFLICT").alias("kind"), "candidates", "values")
