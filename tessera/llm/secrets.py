"""Secret scans that weigh candidates by how many owners and repositories have them.

Three base kinds are searched in whole texts: assignments, access keys and long hexadecimal runs. A further kind takes
other tokens that look like keys. Each candidate's value is hashed, and the hashes are counted over the corpus by
distinct repositories and owners: values that many owners have are examples that were copied widely, values of few
owners that look live are credentials. Candidates of the further kind are kept as spans only if they are such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, joined_by_weight, pinned, text_or_empty
from .spans import matched, with_places

# The patterns of the base kinds, in their order.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The same matches as of HEX with 24 characters or more, and as of ACCESS with 20 or more: runs are always whole.
LONG_HEX = r"[0-9a-f]{24,}"
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
#: Kind "keylike": whole runs of 32 or more key characters with a digit, a small and a capital letter anywhere in them.
KEYLIKE = r"[A-Za-z0-9+/_-]{32,}={0,2}"
KEYLIKE_CLASSES = ("[0-9]", "[a-z]", "[A-Z]")
KINDS = ("assign", "access", "hex", "keylike")
MIN_ASSIGNED = 6


@dataclass(frozen=True)
class Limits:
    """From how many owners or repositories on a value is a copied example, and what looks live."""

    example_owners: int = 4
    example_repositories: int = 6
    min_length: int = 12
    min_distinct: int = 8


def secret_of(kind: Column, value: Column) -> Column:
    """The part of a match that is the secret itself."""
    return F.when(kind == "assign", F.regexp_extract(value, ASSIGN, 2)).otherwise(value)


def looks_live(secret: Column, limits: Limits) -> Column:
    """Long and varied enough: letters and digits, many distinct characters, no word that marks a placeholder."""
    distinct = F.size(F.array_distinct(F.split(secret, "")))
    return (
        (F.length(secret) >= limits.min_length)
        & (distinct >= limits.min_distinct)
        & secret.rlike("[0-9]")
        & secret.rlike("[A-Za-z]")
        & ~secret.rlike("(?i)example|placeholder|changeme|dummy|sample|your[_-]?(?:key|token|secret|password)|x{6,}|1234567")
    )


def candidates(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """A row for each match, and one without a kind for each document without matches.

    A document's owner is its source; its repository is the source's part in one language.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("owner"),
        F.concat_ws("/", F.coalesce(F.col(source_col), F.lit("")), F.coalesce(F.col(lang_col), F.lit(""))).alias("repository"),
        text_or_empty(text_col).alias("text"),
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("text_key", F.xxhash64("text"))
    patterns = dict(zip(KINDS, (ASSIGN, LONG_ACCESS, LONG_HEX, KEYLIKE), strict=True))

    def of_kind(kind: int, pattern: str) -> Column:
        return F.transform(matched("text", pattern), lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), m["gap"].alias("gap"), m["value"].alias("value")))

    parts = [of_kind(k, pattern) for k, pattern in enumerate(patterns.values())]
    keys = ["doc_id", "row", "text_key", "owner", "repository"]
    return rows.select(*keys, F.concat(*parts).alias("found")).select(*keys, F.explode_outer("found").alias("m")).select(*keys, "m.*")


def judged(found: DataFrame, limits: Limits) -> DataFrame:
    """Candidates with their places, and the verdict on their value: example, live or weak."""
    placed = with_places(found, ["row", "kind"], "n")
    for letters in KEYLIKE_CLASSES:
        placed = placed.where((F.col("kind") != KINDS.index("keylike")) | F.col("value").rlike(letters))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    placed = placed.withColumn("secret", secret_of(kind, F.col("value"))).where((F.col("kind") != 0) | (F.length("secret") >= MIN_ASSIGNED))
    placed = pinned(placed.withColumn("hash", F.sha2("secret", 256)))
    # distinct (value, owner, repository) first: a value that a third of the rows share is counted from few rows
    seen = placed.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    spread = pinned(seen.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repositories"), F.sum("n").alias("mentions")))
    example = (F.col("owners") >= limits.example_owners) | (F.col("repositories") >= limits.example_repositories)
    verdict = F.when(example, "example").when(looks_live(F.col("secret"), limits), "live").otherwise("weak")
    return joined_by_weight(placed, spread, "hash", "mentions").withColumn("verdict", verdict)


def scan(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: base counts and spans, all spans, and what the corpus says of their values.

    A null text counts as empty. Rows with one id, or a null id, are kept apart. Null sources and languages count as
    one of their own. A document without matches has counts of 0 and empty spans; an empty table gives no rows.
    """
    # documents without matches wait in the pinned table and aren't shuffled
    rows = pinned(candidates(docs, id_col, text_col, source_col, lang_col))
    places = judged(rows.where("kind IS NOT NULL"), limits)
    keys = ["row", "doc_id", "text_key"]
    spread = F.struct(F.max("owners").alias("owners"), F.max("repositories").alias("repositories"))
    grouped = places.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("found"), spread.alias("spread"))
    # texts whose matches were all too short have no row in grouped
    heads = rows.where("kind IS NULL OR n = 0").select(*keys).distinct()
    with_matches = heads.join(grouped, "row", "left")
    base = F.filter("found", lambda s: s["kind"] < 3)
    # a further span needs a live value, and a place that no base span has
    kept = F.filter("found", lambda s: (s["kind"] < 3) | ((s["verdict"] == "live") & ~F.exists(F.col("found"), lambda b: (b["kind"] < 3) & (b["start"] < s["end"]) & (s["start"] < b["end"]))))

    def listed(spans: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(spans: Column, verdict: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["verdict"] == verdict)).cast("long")

    def of_kind(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    filled = with_matches.withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string>>")))
    return filled.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(kept).alias("spans"),
        count(kept, "live").alias("n_live"),
        count(kept, "example").alias("n_example"),
        F.coalesce(F.col("spread.owners"), F.lit(0)).alias("most_owners"),
        F.coalesce(F.col("spread.repositories"), F.lit(0)).alias("most_repositories"),
        "text_key",
        kept.alias("found"),
    )


def redacted(docs: DataFrame, limits: Limits = Limits(), mark: str = "[SECRET]", example_mark: str = "[EXAMPLE_KEY]") -> DataFrame:
    """docs, all rows and columns, with each span's text replaced: by example_mark for widely copied values, else by mark.

    Overlapping spans are replaced together. n_chars, where there is such a column, is brought up to date.
    """
    names = docs.columns
    id_, key, found = fresh(docs, "id", "key", "found")
    spans = scan(docs, limits).where(F.size("found") > 0).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("found").alias(found)).dropDuplicates([id_, key])
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty("text")) == F.col(key)), "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.col("text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        sign = F.when(s["verdict"] == "example", example_mark).otherwise(mark)
        grown = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, sign)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), grown.alias("out"))

    whole = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text"))))
    out = joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(whole))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)
