"""Connected components and bounded neighbourhoods on edge tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and the executors share; one of our own only where none is set and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def joined_by_weight(rows: DataFrame, named: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined with named, one row a key, where weight says how many rows have the key.

    Keys above a quarter of a task's even share are broadcast, at most four a task, so none brings all its rows to one.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = named.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total"), F.coalesce(F.max(weight), F.lit(0)).alias("most")).first()
    least = max(64, found.total // parts)
    if found.most <= least:
        return rows.join(named, key)
    heavy = named.where(F.col(weight) > least)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(named.where(F.col(weight) <= least), key)
    return light.unionByName(rows.join(F.broadcast(heavy), key))


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared checkpoint folder."""
    spark = df.sparkSession
    shared_folder(spark)
    # a checkpoint keeps its plan's estimated size, which multiplies with every join of a loop; its rows have none
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.javaRDD(), kept.schema()), spark)


def connected_components(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(node, component) of all nodes in the edges; a component is named by its smallest node.

    Labels take the smallest label among neighbours, then that label's own: long chains halve in each round.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = settled(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    first = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"), F.count("*").alias("degree"))
    labels = settled(first.select("node", F.least("node", "component").alias("component"), "degree"))
    while True:
        beside = joined_by_weight(both, labels.withColumnRenamed("node", "v"), "v", "degree")
        reached = beside.groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = settled(labels.join(reached, "node").select("node", "degree", F.least("component", "near").alias("component"), F.col("component").alias("was")))
        parents = lower.select(F.col("node").alias("component"), F.col("component").alias("above"))
        sizes = settled(lower.groupBy("component").agg(F.count("*").alias("size")).join(parents, "component"))
        fresh = settled(joined_by_weight(lower, sizes, "component", "size").select("node", "degree", F.least("component", "above").alias("component"), "was"))
        labels = fresh.select("node", "component", "degree")
        if not fresh.where("component != was").take(1):
            return labels.select("node", "component")


def neighbourhood(edges: DataFrame, focus: DataFrame, hops: int, direction: str = "both", left: str = "left", right: str = "right") -> DataFrame:
    """(node, depth) of the nodes within some hops of the focus nodes: one join for each hop, of the new nodes alone."""
    down = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    up = edges.select(F.col(right).alias("a"), F.col(left).alias("b"))
    steps = {"downstream": down, "upstream": up, "both": down.unionByName(up)}[direction]
    seen = focus.select(F.col(focus.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0))
    edge_of = seen
    for depth in range(1, hops + 1):
        reached = edge_of.join(steps, edge_of["node"] == steps["a"]).select(F.col("b").alias("node")).distinct()
        edge_of = settled(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(edge_of)
    return seen
