"""Hypotheses of a canonical model: bindings of mappings and relationships to the reviewed decisions that they rest on.

Every binding names a decision and a review of it. What doesn't hold is told as rows of refusals, all of them at once, and a
hypothesis is published only without any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKPOINT = "REVIEW_EVIDENCE_DECISIONS"
ACCEPTABLE = ("ACCEPTED", "SKIPPED")
OPEN_STATES = ("REVIEW_REQUIRED", "INCOMPLETE_REQUIRED_EVIDENCE")
KINDS = ("RELATIONSHIP", "MAPPING")
REFUSALS = "binding string, code string, reason string"


def _bare(rows: DataFrame, prefix: str, **names: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{prefix}_{n}") for n, c in names.items()])


def bound(bindings: DataFrame, decisions: DataFrame, reviews: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The bindings (binding, kind, decision, review, source) beside their decision and review, with how often each of those ids stands in its table.

    decisions: (decision, kind, state, fingerprint, snapshot); reviews: (review, checkpoint, decision, verdict, superseded,
    fingerprint, snapshot); snapshots: (source, snapshot) of the sources that the model is of. Ids that stand several
    times keep one row, so a binding stays one; the count refuses it.
    """
    once = decisions.groupBy("decision").agg(F.min(F.struct("kind", "state", "fingerprint", "snapshot")).alias("d"), F.count("*").alias("d_count")).select("decision", "d_count", *[F.col(f"d.{c}").alias(f"d_{c}") for c in ("kind", "state", "fingerprint", "snapshot")])
    fields = ("checkpoint", "decision", "verdict", "superseded", "fingerprint", "snapshot")
    read = reviews.groupBy("review").agg(F.min(F.struct(*fields)).alias("r"), F.count("*").alias("r_count")).select("review", "r_count", *[F.col(f"r.{c}").alias(f"r_{c}") for c in fields])
    pinned = snapshots.groupBy("source").agg(F.min("snapshot").alias("s_snapshot"), F.countDistinct("snapshot").alias("s_count"))
    # reviews of the same decision that were accepted beside the named one
    others = reviews.where(F.col("verdict").isin(*ACCEPTABLE) & ~F.coalesce("superseded", F.lit(False)) & (F.col("checkpoint") == CHECKPOINT)).groupBy("decision").agg(F.countDistinct("review").alias("accepted"))
    # all that a decision's id gives at once, so that bindings are shuffled once for it, and before they have a review's columns
    known = once.join(others, "decision", "full")
    return bindings.join(known, "decision", "left").join(read, "review", "left").join(pinned, "source", "left")


def _reasons() -> list[tuple[str, str, Column]]:
    """(code, reason, condition); a condition that is null is none."""
    named = F.col("review").isNotNull() & F.col("r_count").isNotNull()
    known = F.col("decision").isNotNull() & F.col("d_count").isNotNull()
    return [
        ("INCOMPLETE_REVIEW", "DECISION_UNKNOWN", ~known),
        ("INCOMPLETE_REVIEW", "DECISION_REPEATED", F.col("d_count") > 1),
        ("INCOMPLETE_REVIEW", "DECISION_OF_ANOTHER_KIND", F.col("d_kind") != F.col("kind")),
        ("INVALID_SOURCE_MAPPING", "DECISION_NOT_FOR_REVIEW", ~F.col("d_state").isin(*OPEN_STATES)),
        ("INCOMPLETE_REVIEW", "REVIEW_MISSING", F.col("review").isNull()),
        ("INCOMPLETE_REVIEW", "REVIEW_UNKNOWN", F.col("review").isNotNull() & F.col("r_count").isNull()),
        ("INCOMPLETE_REVIEW", "REVIEW_REPEATED", F.col("r_count") > 1),
        ("INCOMPLETE_REVIEW", "REVIEW_OF_ANOTHER_CHECKPOINT", named & (F.col("r_checkpoint") != CHECKPOINT)),
        ("INCOMPLETE_REVIEW", "REVIEW_NOT_ACCEPTED", named & ~F.col("r_verdict").isin(*ACCEPTABLE)),
        ("INCOMPLETE_REVIEW", "REVIEW_SUPERSEDED", F.coalesce("r_superseded", F.lit(False))),
        ("INCOMPLETE_REVIEW", "REVIEW_OF_ANOTHER_DECISION", named & ~F.col("r_decision").eqNullSafe(F.col("decision"))),
        ("INCOMPLETE_REVIEW", "REVIEW_OF_OTHER_EVIDENCE", known & named & ~F.col("r_fingerprint").eqNullSafe(F.col("d_fingerprint"))),
        ("INCOMPLETE_REVIEW", "REVIEWED_TWICE", F.col("accepted") > 1),
        ("SNAPSHOT_UNIVERSE", "SOURCE_OUTSIDE", F.col("s_count").isNull()),
        ("SNAPSHOT_UNIVERSE", "SOURCE_OF_SEVERAL_SNAPSHOTS", F.col("s_count") > 1),
        ("SNAPSHOT_UNIVERSE", "DECISION_OF_ANOTHER_SNAPSHOT", known & (F.col("s_count") == 1) & ~F.col("d_snapshot").eqNullSafe(F.col("s_snapshot"))),
        ("SNAPSHOT_UNIVERSE", "REVIEW_OF_ANOTHER_SNAPSHOT", named & (F.col("s_count") == 1) & ~F.col("r_snapshot").eqNullSafe(F.col("s_snapshot"))),
    ]


def judged(bindings: DataFrame, decisions: DataFrame, reviews: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The bindings with `refusals`, an array of (code, reason) in a fixed order, empty where the binding holds."""
    cells = F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))) for code, reason, cond in _reasons()])
    return bound(bindings, decisions, reviews, snapshots).select(*bindings.columns, F.array_compact(cells).alias("refusals"))


def refusals(found: DataFrame) -> DataFrame:
    """(binding, code, reason) of judged bindings."""
    return found.select("binding", F.explode("refusals").alias("x")).select("binding", "x.code", "x.reason")


def missing_requirements(requirements: DataFrame, specs: DataFrame) -> DataFrame:
    """Refusals of entity families (family, requirement) that need a resolution and have no spec (family)."""
    lacking = requirements.where("requirement = 'ER_REQUIRED'").join(specs.select("family").distinct(), "family", "left_anti")
    return lacking.select(F.col("family").alias("binding"), F.lit("MISSING_REQUIRED_ER").alias("code"), F.lit("NO_SPEC").alias("reason"))


def missing_references(**found: list[str]) -> list[tuple[str, str, str]]:
    """Refusals of a model without references of a kind: domain, evidence and provenance are needed."""
    return [("model", "PROVENANCE_INCOMPLETE", f"NO_{kind.upper()}_REFERENCES") for kind in ("domain", "evidence", "provenance") if not found.get(kind)]


def hypothesis(found: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(hypothesis, kind, bindings, decisions, reviews) for each kind of binding: an id from all that it rests on, the same whatever the order.

    An error names what is refused, if anything is; `more` has refusals beside those of the bindings.
    """
    against = refusals(found) if more is None else refusals(found).unionByName(more)
    some = against.groupBy("code", "reason").agg(F.count("*").alias("n"), F.min("binding").alias("first")).orderBy("code", "reason").take(5)
    if some:
        raise ValueError("; ".join(f"{r.code}/{r.reason}: {r.n}, first {r.first}" for r in some))
    # bindings are hashed one by one and their hashes summed, so no list of them is gathered
    one = F.xxhash64("binding", "decision", "review").cast("decimal(38,0)")
    other = F.xxhash64("review", "binding", "decision").cast("decimal(38,0)")
    groups = found.groupBy("kind").agg(F.count("*").alias("bindings"), F.countDistinct("decision").alias("decisions"), F.countDistinct("review").alias("reviews"), F.sum(one).alias("a"), F.sum(other).alias("b"))
    name = F.concat(F.lit("hypothesis_"), F.substring(F.sha2(F.concat_ws("|", "kind", "bindings", "a", "b"), 256), 1, 32))
    return groups.select(name.alias("hypothesis"), "kind", "bindings", "decisions", "reviews")
