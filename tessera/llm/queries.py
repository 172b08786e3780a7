"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(read_table(spark, sf_dir, "documents")).drop("text_key", "found")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_pairs

    return edited_pairs(read_table(spark, sf_dir, "documents"), null_ids="last")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    found = quality(read_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(read_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_model as qm

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    found = qm.score(docs, qm.fit(docs, labels), keep=["doc_id"])
    return found.select("doc_id", (qm.fold_of("doc_id") == 0).alias("held_out"), "score", "predicted")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import with_surrogates

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, key="tessera-surrogates-1")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(read_table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import deduplicated_words

    return deduplicated_words(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: q for name, q in globals().items() if name.startswith("op") and callable(q)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {"op2_secret_scan": oracles.secret_scan(), "op4_quality_rules": oracles.quality(), "op6_warc": oracles.warc(), "op11_collocations": oracles.collocations(), "op12_spelling_variants": oracles.spelling(), "op13_substring_dedup": oracles.substrings()}
