"""Column expressions that several operators share: patterns, stable keys, masks and normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The value patterns that profiling, quality rules and privacy share.
PATTERNS = {
    "EMAIL_LIKE": r"[^@\s]+@[^@\s]+\.[^@\s]+",
    "PHONE_LIKE": r"\+?[0-9][0-9()\-\s]{6,}",
    "UUID_LIKE": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}",
    "INTEGER_STRING": r"[+-]?\d+",
    "DECIMAL_STRING": r"[+-]?\d+\.\d+",
    "DATE_STRING": r"\d{4}-\d{2}-\d{2}(?:[T ].*)?",
    "URL_LIKE": r"(?i)https?://[^\s]+",
}
SECRET_ASSIGNMENT = r"(?i)(?:password|passwd|secret|token|api[_-]?key)\s*[:=]\s*[^\s,;]+"
# What counts as a missing identity.
PLACEHOLDERS = ("unknown", "n/a", "na", "none", "null", "-", "not provided", "not available")

_LARGEST = 0x7FFFFFFFFFFFFFFF
_HEX_ESCAPES = ["b", "e", "f", *"1a 1b 1c 1d 1e 1f".split()]


def matches(column: Column, pattern: str) -> Column:
    """Whether the whole value has the named pattern, with Unicode digits and white space."""
    return column.rlike(rf"(?U)^(?:{PATTERNS[pattern]})\z")


def canonical_json(**parts: Column) -> Column:
    """Compact JSON with sorted keys, text kept as it is and control characters escaped in small letters."""
    text = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})
    fixed = text
    for code in _HEX_ESCAPES:
        wide = code.rjust(4, "0")
        # an even run of backslashes before it: the escape itself, not an escaped backslash
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u{wide.upper()}", rf"$1\\u{wide}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)


def head_of_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def surrogate_key(namespace: str, reference: Column, plain: bool = False) -> Column:
    """A positive 63-bit key that depends on namespace and reference alone; never 0.

    plain: the reference is of characters that JSON leaves as they are, as numbers and dates are; it's then put together without a JSON writer.
    """
    if plain and namespace.isidentifier() and namespace.isascii():
        text = F.concat(F.lit('{"canonical_reference":"'), reference, F.lit(f'","namespace":"{namespace}"}}'))
    else:
        text = F.when(reference.isNotNull(), canonical_json(canonical_reference=reference, namespace=F.lit(namespace)))
    key = F.conv(head_of_hash(text), 16, -10).cast("bigint").bitwiseAND(F.lit(_LARGEST))
    # 1 for 0 without a branch, in which the hash would be worked out again
    return key + (key == 0).cast("bigint")


def bucket(seed: int, key: Column, count: int) -> Column:
    """The bucket of a text key among count: the first 64 bits of its seeded hash, taken modulo count."""
    value = F.conv(head_of_hash(F.concat(F.lit(f"{seed}:"), key)), 16, 10).cast("decimal(20,0)")
    return F.pmod(value, F.lit(count).cast("decimal(20,0)")).cast("int")


def record_reference(scope: str, *keys: Column) -> Column:
    """A stable id for a row, from its key's values or its place."""
    return F.sha2(F.concat(F.lit(scope + ":"), F.to_json(F.array(*[k.cast("string") for k in keys]), {"ignoreNullFields": "false"})), 256)


def stripped(column: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+\z", "")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """RFC 2104 from built-in hashes, in hexadecimal."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def _folded_series(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def folded(column: Column) -> Column:
    """Compatibility-composed and case-folded; Spark has no built-in of either."""
    return F.pandas_udf(_folded_series, "string")(column)


def identity_form(column: Column, digits_only: bool = False) -> Column:
    """An identity field for comparison: folded, trimmed, single spaces; placeholders and repeated digits are null."""
    text = F.regexp_replace(stripped(folded(column.cast("string"))), r"(?U)\s+", " ")
    missing = (text == "") | text.isin(*PLACEHOLDERS) | text.rlike(r"(?U)^(\d)\1{3,}\z")
    kept = F.when(~missing, text)
    if digits_only:
        kept = F.regexp_replace(kept, r"(?U)\D", "")
        kept = F.when(kept != "", kept)
    return kept


def iso_weekday(column: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(column) + 1


def iso_timestamp(column: Column) -> Column:
    """ISO-8601 dates and times as timestamps without a zone; null for what can't be read."""
    shaped = column.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\z")
    return F.when(shaped, F.try_to_timestamp(column).cast("timestamp_ntz"))
