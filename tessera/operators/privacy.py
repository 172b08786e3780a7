"""Privacy classes, masks, keyed pseudonyms and exposure rules for columns of text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import PATTERNS, SECRET_ASSIGNMENT, hmac_sha256, matches

# What masked values become.
MASKS = {"AUTHENTICATION_SECRET": "<REDACTED_SECRET>", "EMAIL": "<REDACTED_EMAIL>", "PHONE": "<REDACTED_PHONE>"}
UNKNOWN_MASK = "<REDACTED_UNKNOWN>"


@dataclass(frozen=True)
class PrivacyRule:
    """An explicit class of a table's column; None matches any."""

    category: str
    state: str = "CONFIRMED_SENSITIVE"
    table: str | None = None
    column: str | None = None


def category(value: Column, table: str | None = None, column: str | None = None, rules: tuple[PrivacyRule, ...] = ()) -> Column:
    """The category of a value: an explicit rule's, else that of a pattern, else null; never 'public'."""
    for r in rules:
        if r.table in (None, table) and r.column in (None, column):
            return F.lit(r.category)
    return F.when(matches(value, "EMAIL_LIKE"), "EMAIL").when(matches(value, "PHONE_LIKE"), "PHONE")


def state(value: Column, table: str | None = None, column: str | None = None, rules: tuple[PrivacyRule, ...] = ()) -> Column:
    for r in rules:
        if r.table in (None, table) and r.column in (None, column):
            return F.lit(r.state)
    return F.when(category(value).isNotNull(), "POTENTIALLY_SENSITIVE").otherwise("UNKNOWN")


def masked(value: Column, kind: Column) -> Column:
    out = F.when(kind == "AUTHENTICATION_SECRET", MASKS["AUTHENTICATION_SECRET"]).when((kind == "EMAIL") & value.contains("@"), MASKS["EMAIL"]).when(kind == "PHONE", MASKS["PHONE"])
    return F.when(value.isNotNull(), out.otherwise("<REDACTED>"))


def pseudonym(value: Column, key: bytes | None, scope: str, version: str = "1", prefix: str = "psn_") -> Column:
    """A keyed hash of scope, version and value. Without a key there is none: plain hashes aren't a way out."""
    if not key:
        raise ValueError("PSEUDONYMIZATION_KEY_UNAVAILABLE")
    return F.concat(F.lit(prefix), hmac_sha256(key, F.concat(F.lit(f"{scope}:{version}:"), value)))


def sanitized(value: Column, trusted: bool = False) -> Column:
    """A log text with addresses, numbers and secrets blanked; what has none is shown only if it is trusted."""
    out = F.regexp_replace(value, f"(?U){PATTERNS['EMAIL_LIKE']}", MASKS["EMAIL"])
    out = F.regexp_replace(out, f"(?U){PATTERNS['PHONE_LIKE']}", MASKS["PHONE"])
    out = F.regexp_replace(out, f"(?U){SECRET_ASSIGNMENT}", MASKS["AUTHENTICATION_SECRET"])
    return out if trusted else F.when(out == value, UNKNOWN_MASK).otherwise(out)


def exposure(states: Column, context: str, purpose: str = "", mode: str = "", raw_staging_allowed: bool = True) -> Column:
    """What may be shown of a value of a state in a context: RETAIN_RESTRICTED, ALLOW_MASKED, ALLOW_AGGREGATE or BLOCK."""
    if context == purpose == "ENTITY_RESOLUTION_LOCAL_ANALYSIS" or context == "RAW_STAGING" and raw_staging_allowed and mode == "raw":
        return F.lit("RETAIN_RESTRICTED")
    if context == "EXTERNAL_PROCESSING":
        return F.lit("BLOCK")
    if context in ("LOG", "DEBUG", "EXPORT", "UI_PREVIEW"):
        return F.lit("ALLOW_MASKED")
    return F.when(states == "EXPLICITLY_NON_SENSITIVE", "ALLOW_AGGREGATE").otherwise("BLOCK")


def scan(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, scanned, sensitive, unknown, clean) of text columns: one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = rows.select(F.explode(cells).alias("c")).select("c.*")
    s = state(F.col("value"))
    out = long.groupBy("column").agg(F.count("*").alias("scanned"), F.count_if(s != "UNKNOWN").alias("sensitive"), F.count_if(s == "UNKNOWN").alias("unknown"))
    return out.withColumn("clean", (F.col("sensitive") == 0) & (F.col("unknown") == 0))
