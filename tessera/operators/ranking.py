"""Linear ranking of relationship candidates with missing-value indicators and explainable contributions."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_indicators(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with each feature as a number, 0 where it is missing, and `<feature>_missing`."""
    return rows.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in features} | {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def names_of(features: list[str]) -> list[str]:
    return [n for f in features for n in (f, f"{f}_missing")]


def train(rows: DataFrame, features: list[str], label: str = "label") -> LogisticRegressionModel:
    """A logistic model on the given rows; both classes have to be there."""
    if rows.select(label).distinct().count() < 2:
        raise ValueError("BOTH_CLASSES_REQUIRED")
    ready = VectorAssembler(inputCols=names_of(features), outputCol="_x").transform(with_indicators(rows, features))
    return LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01, standardization=True).fit(ready.withColumn(label, F.col(label).cast("double")))


def contributions(features: list[str], model: LogisticRegressionModel) -> dict[str, Column]:
    return {n: F.col(n) * float(w) for n, w in zip(names_of(features), model.coefficients, strict=True)}


def scored(rows: DataFrame, features: list[str], model: LogisticRegressionModel) -> DataFrame:
    """rows with `score` (log-odds), `probability` and `contributions`, a map that sums to the score without the intercept."""
    ready = with_indicators(rows, features)
    parts = contributions(features, model)
    total = reduce(lambda a, b: a + b, parts.values(), F.lit(float(model.intercept)))
    table = F.create_map(*[x for n, c in parts.items() for x in (F.lit(n), c)])
    return ready.withColumn("score", total).withColumn("contributions", table).withColumn("probability", 1 / (1 + F.exp(-F.col("score"))))


def baselines(rows: DataFrame, features: list[str]) -> DataFrame:
    """(ranker, query, item, label, score): each feature as a ranker of its own."""
    cells = F.array(*[F.struct(F.lit(f).alias("ranker"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("score")) for f in features])
    return rows.select("query", "item", "label", F.explode(cells).alias("c")).select("c.ranker", "query", "item", "label", "c.score")
