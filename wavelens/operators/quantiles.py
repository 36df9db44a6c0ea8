"""Exact quantiles of groups of any size.

Spark's exact percentile keeps a map of all distinct values of a group in one task. Here distinct values are counted on the
map side, dealt to chunks by range (ranks.py), and only the chunks that hold a wanted rank are looked into. The input is
read once; neither outliers nor infinities unbalance the chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, q): the number of values and the quantiles (array, in the order of shares) by linear interpolation between
    the two nearest ranks. Nulls and NaNs are left out; a group without values has no row. Null keys are a group."""
    chunks = ranks.counted(rows, by, value)
    ahead = ranks.before(chunks, "__g", F.sum("__k"))
    wanted = ", ".join(f"named_struct('i', {i}, 'at', {float(s)!r}D * (n - 1))" for i, s in enumerate(shares))
    sizes = ahead.select("__g", F.col("__all").alias("n")).distinct()
    places = sizes.select("__g", "n", F.inline(F.expr(f"array({wanted})"))).select("__g", "n", "i", "at", F.explode(F.expr("array_distinct(array(floor(at), ceil(at)))")).alias("rank"))
    met = ranks.values_at(chunks, ahead, places)
    each = met.groupBy("__g", "n", "i", "at").agg(F.min_by("__v", "rank").alias("a"), F.max_by("__v", "rank").alias("b")).withColumn("x", F.expr("if(a = b, a, a + (b - a) * (at - floor(at)))"))
    out = each.groupBy("__g", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("q"))
    return out.select(*(F.col("__g")[c].alias(c) for c in by), "n", "q")
