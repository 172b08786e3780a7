"""Reviews as guards of stages: a stage goes on only if its review was made of exactly what it is about to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a review and a guard have to agree in, and the names of what keeps them apart.
FIELDS = ("subject_stage", "subject_artifact_id", "subject_content_hash", "subject_schema_version", "model_version", "policy_version", "subject_semantic_id", "applicability_fingerprint")
WRONG_CHECKPOINT = "WRONG_REVIEW_CHECKPOINT"
SCHEMAS = "MISMATCH_SOURCE_SCHEMA_FINGERPRINTS"
ASSERTIONS = "MISMATCH_DOMAIN_ASSERTION_SCOPE"
NOT_SATISFYING = "DECISION_NOT_SATISFYING_GUARD"
SKIP_NOT_AUTHORIZED = "SKIP_POLICY_NOT_AUTHORIZED"
SUPERSEDED = "DECISION_INVALIDATED_OR_SUPERSEDED"
CHECKPOINTS = ("REVIEW_EVIDENCE_DECISIONS", "REVIEW_ANALYTICAL_PLAN", "REVIEW_MATERIALIZATION_PLAN")

SCOPE = ("checkpoint", *FIELDS, "schemas", "assertions", "skip_authorization")
GIVEN = (*SCOPE, "verdict", "superseded", "invalidation_reason")


def _entries(column: str) -> Column:
    """A map's entries in order, as maps can't be compared; a null map is an empty one."""
    return F.array_sort(F.map_entries(F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))))


def held(guards: DataFrame, decisions: DataFrame) -> DataFrame:
    """(guard, review, reasons): each guard against the review that it presents.

    guards: guard, review and the columns of SCOPE; decisions: review and the columns of GIVEN. schemas is a
    map<string,string>, assertions an array<string> whose order doesn't count. A review that isn't there, or stands twice,
    satisfies nothing; null equals null. reasons is a list of one guard's own, empty if it is satisfied.
    """
    theirs = decisions.select("review", *[F.col(c).alias(f"_{c}") for c in GIVEN], F.lit(True).alias("_known"))
    # of a repeated id any row will do, as it is refused
    once = theirs.groupBy("review").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in theirs.columns if c != "review"])
    both = guards.join(once, "review", "left")
    known, skipped = F.coalesce("_known", F.lit(False)), F.col("_verdict").eqNullSafe(F.lit("SKIPPED"))
    sorted_refs = lambda c: F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>")))
    found = [
        (F.lit("REVIEW_MISSING"), ~known),
        (F.lit("REVIEW_REPEATED"), F.col("_n") > 1),
        (F.lit(WRONG_CHECKPOINT), known & ~F.col("_checkpoint").eqNullSafe(F.col("checkpoint"))),
        *[(F.lit("MISMATCH_" + f.upper()), known & ~F.col(f"_{f}").eqNullSafe(F.col(f))) for f in FIELDS],
        (F.lit(SCHEMAS), known & (_entries("_schemas") != _entries("schemas"))),
        (F.lit(ASSERTIONS), known & (sorted_refs("_assertions") != sorted_refs("assertions"))),
        (F.lit(NOT_SATISFYING), known & ~F.coalesce(F.col("_verdict").isin("ACCEPTED", "SKIPPED"), F.lit(False))),
        (F.lit(SKIP_NOT_AUTHORIZED), known & skipped & (F.col("skip_authorization").isNull() | ~F.col("_skip_authorization").eqNullSafe(F.col("skip_authorization")))),
        (F.lit(SUPERSEDED), known & (F.coalesce("_superseded", F.lit(False)) | F.coalesce(F.col("_invalidation_reason") != "", F.lit(False)))),
    ]
    return both.select("guard", "review", F.array_compact(F.array(*[F.when(when, name) for name, when in found])).alias("reasons"))


def refusals(guards: DataFrame, decisions: DataFrame) -> DataFrame:
    """(guard, review, reason), a row for each thing that keeps a guard closed."""
    return held(guards, decisions).select("guard", "review", F.explode("reasons").alias("reason"))


def invalidated(decisions: DataFrame, reasons: DataFrame) -> DataFrame:
    """decisions with the reasons (review, reason) for which they no longer hold; blank reasons are an error."""
    if reasons.where(F.col("reason").isNull() | (F.trim("reason") == "")).take(1):
        raise ValueError("INVALIDATION_WITHOUT_REASON")
    told = reasons.groupBy("review").agg(F.min("reason").alias("_reason"))
    return decisions.join(told, "review", "left").withColumn("invalidation_reason", F.coalesce("_reason", "invalidation_reason")).drop("_reason").select(*decisions.columns)
