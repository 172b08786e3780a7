"""Places of regular-expression matches in whole texts, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matched(text: str, pattern: str) -> Column:
    """The leftmost non-overlapping matches and the lengths of the pieces of text before them, as an array of structs.

    Texts without a match, by far most, are searched once; the others are also split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def paired(matches: Column) -> Column:
        lengths = F.transform(F.slice(pieces, 1, F.size(matches)), lambda p: F.length(p))
        return F.zip_with(matches, lengths, lambda m, gap: F.struct(m.alias("value"), gap.alias("gap")))

    empty = F.array().cast("array<struct<value:string,gap:int>>")
    return F.element_at(F.transform(F.array(found), lambda m: F.when(F.size(m) > 0, paired(m)).otherwise(empty)), 1)


def with_places(rows: DataFrame, keys: list[str], order: str, gap: str = "gap", value: str = "value") -> DataFrame:
    """rows with `start` and `end` in code points: running sums over the matches of one text and kind."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = rows.withColumn("end", F.sum(F.col(gap) + F.length(value)).over(upto))
    return ended.withColumn("start", F.col("end") - F.length(value))
