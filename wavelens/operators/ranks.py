"""Ranks in groups of any size, and what follows from them.

Rows are dealt to chunks by a range of (group, order): Spark draws the borders from a sample of the rows themselves, so
chunks are of like size whatever the values, and however large a group is. Each row's place is its place in the chunk plus
what the group has in the chunks before, of which there is one small row each. No task holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise


def chunked(rows: DataFrame, *order: str) -> DataFrame:
    """rows in chunks (__chunk) by the range of the columns order, written once, so that every later read sees the same."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(n, *order).withColumn("__chunk", F.spark_partition_id()))


def before(chunks: DataFrame, group: str, size) -> DataFrame:
    """(group, __chunk, __k, __before, __all): what each chunk has of a group, what the chunks before it have, and the whole."""
    by = Window.partitionBy(group)
    counted = chunks.groupBy(group, "__chunk").agg(size.alias("__k"))
    upto = F.sum("__k").over(by.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, 0))
    return counted.select(group, "__chunk", "__k", (upto - F.col("__k")).alias("__before"), F.sum("__k").over(by).alias("__all"))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with __r, their number in the group by order (unique in a group; from 1), and __n, the group's size. Null keys
    are a group."""
    chunks = chunked(rows.withColumn("__g", F.struct(*by)), "__g", *order)
    ahead = before(chunks, "__g", F.count("*"))
    within = F.row_number().over(Window.partitionBy("__g", "__chunk").orderBy(*order))
    placed = chunks.withColumn("__r", within).join(ahead, ["__g", "__chunk"])
    return placed.select(*rows.columns, (F.col("__r") + F.col("__before")).alias("__r"), F.col("__all").alias("__n"))


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(__g, __v, __k, __chunk): distinct values by group with their numbers, in chunks. Nulls and NaNs are left out."""
    base = rows.select(F.struct(*by).alias("__g"), F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    return chunked(base.groupBy("__g", "__v").agg(F.count("*").alias("__k")), "__g", "__v")


def average_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(__g, __v, __rank, __size): each distinct value's average rank in its group (from 1; ties share it)."""
    chunks = counted(rows, by, value)
    ahead = before(chunks, "__g", F.sum("__k"))
    w = Window.partitionBy("__g", "__chunk").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = chunks.withColumn("__upto", F.sum("__k").over(w)).join(ahead.drop("__k"), ["__g", "__chunk"])
    return placed.select("__g", "__v", (F.col("__before") + F.col("__upto") - (F.col("__k") - 1) / 2).alias("__rank"), F.col("__all").alias("__size"))


def values_at(chunks: DataFrame, ahead: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(__g, rank from 0, ...) with __v, the value of that rank. Only chunks that hold a wanted rank are looked into."""
    holds = wanted.join(ahead, "__g").where("rank >= __before AND rank < __before + __k").drop("__k", "__all")
    some = chunks.join(holds.select("__g", "__chunk", "__before").distinct(), ["__g", "__chunk"])
    upto = F.sum("__k").over(Window.partitionBy("__g", "__chunk").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    some = some.select("__g", "__chunk", "__v", (F.col("__before") + upto).alias("__to"), (F.col("__before") + upto - F.col("__k")).alias("__from"))
    return holds.drop("__before").join(some, ["__g", "__chunk"]).where("rank >= __from AND rank < __to").drop("__chunk", "__from", "__to")


def rank_correlation(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rank_correlation) by group over rows where neither is null or NaN: the correlation of average ranks; null
    under three rows or where one side has a single value."""
    both = materialise(rows.select(F.struct(*by).alias("__g"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL AND NOT isnan(__x) AND NOT isnan(__y)"))
    side = lambda c: average_ranks(both, ["__g"], c).select(F.col("__g.__g").alias("__g"), F.col("__v").alias(c), F.col("__rank").alias(f"r{c}"), "__size")
    ranked = both.join(side("__x"), ["__g", "__x"]).join(side("__y").drop("__size"), ["__g", "__y"])
    # Both sides' ranks have the mean (n + 1) / 2, so centred sums don't cancel.
    a, b = F.col("r__x") - (F.col("__size") + 1) / 2, F.col("r__y") - (F.col("__size") + 1) / 2
    out = ranked.groupBy("__g").agg(F.count("*").alias("n"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    return out.select(*(F.col("__g")[c].alias(c) for c in by), "n", F.expr("if(n >= 3 AND aa > 0 AND bb > 0, ab / sqrt(aa * bb), NULL)").alias("rank_correlation"))
