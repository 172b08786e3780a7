"""Weighted fusion of evidence into reviewable scores; scores order candidates and are no probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import settled


@dataclass(frozen=True)
class Dimension:
    """A scoring dimension: its metrics in order of preference, weight, method of normalization and whether it is required."""

    id: str
    metrics: tuple[str, ...]
    weight: float
    method: str = "identity"  # identity, compatibility or ordinal
    required: bool = True


# The weights, metrics and bands of the relationship policy.
RELATIONSHIP = (
    Dimension("inclusion", ("inclusion_coverage", "orphan_ratio"), 1.0),
    Dimension("target_uniqueness", ("target_uniqueness",), 1.0),
    Dimension("type_compatibility", ("type_compatibility",), 0.75, "compatibility"),
    Dimension("declared_constraint", ("declared_foreign_key",), 1.0, required=False),
)
# The weights and metrics of the mapping policy; one matcher at least has to rank the pair.
MAPPING = (
    Dimension("matcher:coma:rank", ("matcher_rank:coma",), 1.0, "ordinal", required=False),
    Dimension("matcher:cupid:rank", ("matcher_rank:cupid",), 1.0, "ordinal", required=False),
    Dimension("type_compatibility", ("type_compatibility",), 0.75, "compatibility"),
)
MAPPING_FAMILIES = ("PROFILE", "QUALITY", "DEPENDENCY")
MAPPING_MATCHERS = ("matcher:coma:rank", "matcher:cupid:rank")
BANDS = (("HIGH", 0.75), ("MEDIUM", 0.4))


def collisions(signals: DataFrame) -> DataFrame:
    """Evidence ids that stand with different contents."""
    content = F.struct(*[c for c in signals.columns if c != "evidence_id"])
    return signals.groupBy("evidence_id").agg(F.countDistinct(content).alias("versions")).where("versions > 1")


def normalized(signals: DataFrame, policy: tuple[Dimension, ...] = RELATIONSHIP) -> DataFrame:
    """signals (subject, metric, value, direction, …) with dimension and normal value; out-of-range values don't score."""
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    inside = F.col("value").between(-1, 1)
    for d in policy:
        mine = F.col("metric").isin(*d.metrics)
        dimension = F.when(mine, d.id).otherwise(dimension)
        form = {"identity": F.when(inside, F.col("value")), "compatibility": F.when(inside, 2 * F.col("value") - 1), "ordinal": F.when(F.col("value") >= 1, 1 / (1 + F.col("value")))}[d.method]
        value = F.when(mine, form).otherwise(value)
    return signals.withColumn("dimension", dimension).withColumn("normal", value)


def scores(signals: DataFrame, policy: tuple[Dimension, ...] = RELATIONSHIP, conflicts: DataFrame | None = None) -> DataFrame:
    """(subject, score, evidence_coverage, missing, band): one row for each subject.

    The denominator holds the weights of all required dimensions and of the optional ones with evidence. A
    contradiction turns a dimension's sign, but for inclusion and compatibility, whose values already say it.
    """
    ready = normalized(signals, policy).where("normal IS NOT NULL")
    per = []
    for d in policy:
        mine = F.col("dimension") == d.id
        if d.id == "inclusion":
            cover = F.min_by(F.when(mine & (F.col("metric") == d.metrics[0]), F.col("normal")), F.when(mine & (F.col("metric") == d.metrics[0]), F.col("evidence_id")))
            orphan = F.min_by(F.when(mine & (F.col("metric") == d.metrics[1]), F.col("normal")), F.when(mine & (F.col("metric") == d.metrics[1]), F.col("evidence_id")))
            per.append(F.coalesce(cover, 1 - orphan).alias(d.id))
            continue
        value = F.min_by(F.when(mine, F.col("normal")), F.when(mine, F.col("evidence_id")))
        if d.required and d.method != "compatibility":
            against = F.max(mine & (F.col("direction") == "CONTRADICTS"))
            value = F.when(against, -F.abs(value)).otherwise(value)
        per.append(value.alias(d.id))
    wide = ready.groupBy("subject").agg(*per)
    subjects = signals.select("subject").distinct()
    wide = subjects.join(wide, "subject", "left")
    weighted = [F.when(F.col(d.id).isNotNull(), F.round(d.weight * F.col(d.id), 12)) for d in policy]
    total = sum((F.coalesce(w, F.lit(0.0)) for w in weighted), F.lit(0.0))
    seen = sum((F.when(F.col(d.id).isNotNull(), F.lit(d.weight)).otherwise(0.0) for d in policy), F.lit(0.0))
    eligible = sum((F.lit(d.weight) if d.required else F.when(F.col(d.id).isNotNull(), F.lit(d.weight)).otherwise(0.0) for d in policy), F.lit(0.0))
    any_seen = F.coalesce(*[F.col(d.id) for d in policy]).isNotNull()
    missing = F.array_compact(F.array(*[F.when(F.col(d.id).isNull(), F.lit(d.id)) for d in policy if d.required]))
    out = wide.select("subject", F.when(any_seen, F.round(total / eligible, 12)).alias("score"), F.round(seen / eligible, 12).alias("evidence_coverage"), F.concat_ws(",", missing).alias("missing"))
    band = F.when(F.col("score").isNull(), "INSUFFICIENT")
    for name, least in BANDS:
        band = band.when(F.col("score") >= least, name)
    out = out.withColumn("band", band.otherwise("LOW"))
    if conflicts is not None:
        marked = conflicts.select("subject").distinct().withColumn("_c", F.lit(True))
        out = out.join(marked, "subject", "left").withColumn("band", F.when(F.col("_c"), "CONFLICTED").otherwise(F.col("band"))).drop("_c")
    return out


def find_conflicts(signals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(subject, conflict): declared keys against data, hypotheses against structure, types, samples against full scans."""
    flags = signals.groupBy("subject").agg(
        F.max(F.col("metric") == "declared_foreign_key").alias("declared"),
        F.max(F.col("metric") == "semantic_hypothesis").alias("hypothesis"),
        F.max((F.col("direction") == "CONTRADICTS") & F.col("metric").isin("orphan_ratio", "target_uniqueness", "type_compatibility")).alias("against"),
        F.max((F.col("metric") == "type_compatibility") & (F.col("value") < 0.5)).alias("types"),
    )
    one = F.array_compact(
        F.array(
            F.when(F.col("declared") & F.col("against"), F.lit("DECLARED_DATA_CONFLICT")),
            F.when(F.col("hypothesis") & F.col("against"), F.lit("SEMANTIC_STRUCTURAL_CONFLICT")),
            F.when(F.col("hypothesis") & F.col("types"), F.lit("TYPE_SEMANTIC_CONFLICT")),
        )
    )
    scopes = signals.groupBy("subject", "metric").agg(F.avg(F.when(F.col("scope") == "SAMPLE", F.col("value"))).alias("s"), F.avg(F.when(F.col("scope") == "FULL", F.col("value"))).alias("f"))
    split = scopes.where(F.abs(F.col("s") - F.col("f")) >= threshold).select("subject", F.lit("SAMPLE_FULLSCAN_CONFLICT").alias("conflict"))
    return flags.select("subject", F.explode(one).alias("conflict")).unionByName(split).distinct()


def ambiguous_targets(candidates: DataFrame) -> DataFrame:
    """(subject, conflict) of candidates whose left side has several targets: columns subject, left, right."""
    several = candidates.groupBy("left").agg(F.countDistinct("right").alias("n")).where("n > 1")
    return candidates.join(several, "left").select("subject", F.lit("MULTIPLE_TARGET_AMBIGUITY").alias("conflict"))


def mixed_snapshots(signals: DataFrame) -> DataFrame:
    """Subjects with evidence of more than one snapshot of a source."""
    return signals.groupBy("subject", "source").agg(F.countDistinct("snapshot").alias("snapshots")).where("snapshots > 1")


def dependency_signals(measured: DataFrame) -> DataFrame:
    """Measures of inclusions (subject and their columns) as long signals."""
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"), F.when(against, "CONTRADICTS").otherwise("SUPPORTS").alias("direction"))
            for m, c, against in (
                ("inclusion_coverage", "coverage", F.col("coverage") < 1),
                ("orphan_ratio", "orphan_ratio", F.col("orphan_ratio") > 0),
                ("target_uniqueness", "target_uniqueness", F.col("target_uniqueness") < 1),
            )
        ]
    )
    long = measured.select("subject", F.explode(cells).alias("c")).select("subject", "c.*")
    order = Window.partitionBy("subject").orderBy("metric")
    return long.withColumn("evidence_id", F.concat_ws("#", "subject", F.row_number().over(order))).withColumn("scope", F.lit("FULL")).withColumn("family", F.lit("DEPENDENCY"))


FAMILIES = ("SCHEMA_MATCHING", "DECLARED", "ASSERTION", "PROFILE", "QUALITY", "ML", "SEMANTIC", "DEPENDENCY")


def signals_of(rows: DataFrame, family: str, metric: Column, value: Column, direction: Column | str = "SUPPORTS", subject: str = "subject", scope: str = "FULL") -> DataFrame:
    """Evidence of any family in the long form (subject, metric, value, direction, evidence_id, scope, family); null values are no evidence.

    An evidence's id follows from its subject, family and metric, so the same evidence taken twice is one.
    """
    if family not in FAMILIES:
        raise ValueError(f"UNKNOWN_EVIDENCE_FAMILY: {family}")
    side = F.lit(direction) if isinstance(direction, str) else direction
    out = rows.select(F.col(subject).alias("subject"), metric.alias("metric"), value.cast("double").alias("value"), side.alias("direction")).where("value IS NOT NULL")
    return out.withColumns({"evidence_id": F.concat_ws("#", "subject", F.lit(family.lower()), "metric"), "scope": F.lit(scope), "family": F.lit(family)})


def deduplicated(signals: DataFrame) -> DataFrame:
    """signals, each once; an id with several contents is an error."""
    once = settled(signals.distinct())  # measured once, however often decisions read it
    clash = collisions(once).select("evidence_id").take(3)
    if clash:
        raise ValueError(f"EVIDENCE_COLLISION: {[r[0] for r in clash]}")
    return once


def decisions(signals: DataFrame, policy: tuple[Dimension, ...] = RELATIONSHIP, required: tuple[str, ...] = (), conflicts: DataFrame | None = None, one_of: tuple[str, ...] = ()) -> DataFrame:
    """A decision for each subject, with what speaks for and against it; all are for review, none is taken here.

    (subject, score, band, state, supports, contradicts, missing, conflicts, limitations, fingerprint). A subject lacks
    evidence if a required dimension or a required family has none, or all the dimensions of one_of. The explanations are lists of one subject's own
    evidence, in order. The fingerprint is that of the evidence and the policy; another one makes an old review stale.
    """
    found = conflicts if conflicts is not None else find_conflicts(signals)
    scored = scores(signals, policy, found)
    ready = normalized(signals, policy)
    said = F.concat_ws(" ", "evidence_id", F.concat(F.lit("value="), F.format_string("%.6f", "value")), F.concat(F.lit("dimension="), F.coalesce("dimension", F.lit("none"))))
    lists = ready.groupBy("subject").agg(
        F.array_sort(F.collect_set(F.when(F.col("direction") == "SUPPORTS", said))).alias("supports"),
        F.array_sort(F.collect_set(F.when(F.col("direction") == "CONTRADICTS", said))).alias("contradicts"),
        F.array_sort(F.collect_set(F.when(F.col("normal").isNull(), F.concat("evidence_id", F.lit(": doesn't score"))))).alias("silent"),
        F.array_sort(F.collect_set("family")).alias("families"),
        F.max(F.col("dimension").isin(*one_of) & F.col("normal").isNotNull() if one_of else F.lit(True)).alias("chosen"),
        F.sha2(F.concat_ws("|", F.lit(repr(policy)), F.array_sort(F.collect_set(F.concat_ws("=", "evidence_id", "direction", F.col("value").cast("string"))))), 256).alias("fingerprint"),
    )
    clashes = found.groupBy("subject").agg(F.array_sort(F.collect_set("conflict")).alias("conflicts"))
    out = scored.join(lists, "subject").join(clashes, "subject", "left")
    producers = F.transform(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), "families"), lambda f: F.concat(F.lit("producer:"), F.lower(f)))
    dimensions = F.transform(F.filter(F.split("missing", ","), lambda d: d != ""), lambda d: F.concat(F.lit("dimension:"), d))
    lacking = F.when(F.coalesce("chosen", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("dimension:" + "|".join(one_of))))
    missing = F.array_sort(F.concat(producers, dimensions, lacking))
    clash = F.coalesce("conflicts", F.array().cast("array<string>"))
    state = F.when(F.size(missing) > 0, "INCOMPLETE_REQUIRED_EVIDENCE").otherwise("REVIEW_REQUIRED")
    return out.select("subject", "score", "band", state.alias("state"), "supports", "contradicts", missing.alias("missing"), clash.alias("conflicts"), F.concat(missing, F.transform(clash, lambda c: F.concat(F.lit("conflict "), c)), "silent").alias("limitations"), "fingerprint")


def stale_reviews(reviews: DataFrame, current: DataFrame) -> DataFrame:
    """(subject, state) of reviews (subject, fingerprint, decision): CURRENT, STALE if the evidence has changed, or SUBJECT_GONE."""
    now = current.select("subject", F.col("fingerprint").alias("_now"))
    state = F.when(F.col("_now").isNull(), "SUBJECT_GONE").when(F.col("_now") != F.col("fingerprint"), "STALE").otherwise("CURRENT")
    return reviews.join(now, "subject", "left").select("subject", "decision", state.alias("state"))
