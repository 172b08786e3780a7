"""Partition routing with skew and fan-out guards, partial and final merges that must agree with the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import bucket


class ScaleError(Exception):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code = code


def decide(rows: int, size: int, max_rows: int, max_bytes: int) -> str:
    return "LOCAL_REFERENCE" if rows <= max_rows and size <= max_bytes else "PARTITIONED"


def route(strategy: str, key: Column, count: int, seed: int = 0, boundaries: tuple = ()) -> Column:
    """A row's partition: HASH and BLOCK_KEY by seeded hash, RANGE by the number of boundaries at or below the key."""
    if strategy == "SINGLE_NODE":
        return F.lit(0)
    if strategy == "RANGE":
        return F.least(sum(((key >= b).cast("int") for b in boundaries), F.lit(0)), F.lit(count - 1))
    if strategy in ("HASH", "BLOCK_KEY"):
        return bucket(seed, key.cast("string"), count)
    raise ScaleError("UNKNOWN_STRATEGY", strategy)


def skew(routed: DataFrame, count: int, threshold: float = 2.0, action: str = "REVIEW", partition: str = "partition") -> DataFrame:
    """(partitions, least, most, mean, ratio, empty, status, action) over all partitions, empty ones included."""
    sizes = routed.groupBy(partition).agg(F.count("*").alias("n"))
    one = sizes.agg(F.count("*").alias("filled"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.min("n"), F.lit(0)).alias("low"))
    mean = F.col("total") / count
    ratio = F.coalesce(F.try_divide(F.col("most"), mean), F.lit(0.0))
    status = F.when(F.col("most") == 0, "EMPTY").when(ratio > threshold, "SKEWED").otherwise("BALANCED")
    least = F.when(F.col("filled") < count, 0).otherwise(F.col("low"))
    return one.select(F.lit(count).alias("partitions"), least.cast("bigint").alias("least"), "most", mean.alias("mean"), ratio.alias("ratio"), (F.lit(count) - F.col("filled")).cast("bigint").alias("empty"), status.alias("status"), F.when(status == "SKEWED", action).otherwise("ALLOW").alias("action"))


def over_budget(routed: DataFrame, max_rows: int, partition: str = "partition") -> DataFrame:
    return routed.groupBy(partition).agg(F.count("*").alias("rows")).where(F.col("rows") > max_rows)


def hash_sample(rows: DataFrame, ref: str, ratio: float, limit: int | None = None, seed: int = 0) -> DataFrame:
    """Rows whose seeded 64-bit hash lies below ratio, the smallest hashes first."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ref).cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    kept = rows.withColumn("_h", head).where(F.col("_h") < F.lit(str(int(ratio * (1 << 64)))).cast("decimal(20,0)"))
    return kept.orderBy("_h", ref).limit(limit).drop("_h") if limit is not None else kept.drop("_h")


def block_pairs(rows: DataFrame, ref: str, keys: str, max_pairs: int) -> DataFrame:
    """(l, r) pairs of rows that share a blocking key (an array column); keys of too many pairs are refused before they are joined."""
    exploded = rows.select(F.col(ref).alias("ref"), F.explode(F.array_distinct(keys)).alias("key")).distinct()
    sizes = exploded.groupBy("key").agg(F.count("*").alias("n"))
    wide = sizes.where(F.col("n") * (F.col("n") - 1) / 2 > max_pairs)
    if wide.take(1):
        raise ScaleError("LARGE_JOIN_FANOUT", f"a blocking key has more than {max_pairs} pairs")
    left, right = exploded.withColumnRenamed("ref", "l"), exploded.withColumnRenamed("ref", "r")
    return left.join(right, "key").where("l < r").select("l", "r").distinct()


def fanout(left: DataFrame, right: DataFrame, key: str, max_pairs: int) -> int:
    """Rows that a join would have, from the keys' counts alone; too many are refused."""
    a, b = left.groupBy(key).agg(F.count("*").alias("a")), right.groupBy(key).agg(F.count("*").alias("b"))
    n = a.join(b, key).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n")).first().n
    if n > max_pairs:
        raise ScaleError("LARGE_JOIN_FANOUT", f"{n} > {max_pairs}")
    return n


def partial(routed: DataFrame, measure: str, partition: str = "partition") -> DataFrame:
    """Counts, nulls, extremes and the exact sum of each partition."""
    m = F.col(measure).cast("decimal(38,9)")
    return routed.groupBy(partition).agg(F.count("*").alias("rows"), F.count_if(F.col(measure).isNull()).alias("nulls"), F.min(m).alias("least"), F.max(m).alias("most"), F.sum(m).alias("total"))


def merged(partials: DataFrame) -> DataFrame:
    return partials.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))


def cross_partition_duplicates(routed: DataFrame, key: str, partition: str = "partition") -> DataFrame:
    """Keys that stand more than once, whether in one partition or in several."""
    return routed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(partition).alias("partitions")).where("n > 1")


def fd_violations(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left).agg(F.countDistinct(right).alias("n")).where("n > 1")


def equivalent(a: DataFrame, b: DataFrame) -> bool:
    """Whether two small results hold the same rows."""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)
