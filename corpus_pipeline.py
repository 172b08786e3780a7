"""From raw documents to packed training windows: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before it; between stages the rows are written
as Parquet in the folder that the cluster shares. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import quality_model
from tessera.llm.common import read_table, removed, shared_dir
from tessera.llm.mixing import in_mixed_order
from tessera.llm.near_dedup import deduplicated
from tessera.llm.packing import pack
from tessera.llm.secrets import redacted


CACHE_BYTES = 40 << 20  # for words; the workers have the other stages' memory beside it


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of the documents at hand, predicts to be good.

    Null and empty texts are judged by the classes' balance alone, rows of one id each by its own text, and rows without
    an id like others. An empty table stays empty.
    """
    model = quality_model.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).where("predicted = 1").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class.

    Null and empty texts are one class. Rows of one id with different texts are in the classes of their texts, and a class
    without any id keeps a row without one. Equal rows leave one. An empty table stays empty.
    """
    return deduplicated(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in the place of their secrets.

    Null and empty texts stay as they are; repeated rows, and rows without an id, are kept and marked like others.
    """
    return redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the mixed order of their sources.

    A null source is a source of its own. Rows without an id or with one id have places of their own; equal rows share
    one. An empty table stays empty.
    """
    return in_mixed_order(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training windows that follow the mixed order, which files read anew don't keep.

    Null and empty texts give their end id; repeated rows, and rows without an id, are packed as they come.
    """
    return pack(in_mixed_order(docs), public_tokenizers.path("word_bpe_49k.json"), in_order=True, cache_bytes=CACHE_BYTES)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained weights, signatures and token ids can't be expressed in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is deleted once the next one has read it."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
