"""Interval, nearest and as-of joins within captures. All have an equi key; ranges are bucketed, so a join's work follows
the rows near each other in time, not the square of a capture's length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, t: str, value: str, max_lag: float | None = None) -> DataFrame:
    """left with the value and time of right's latest row at or before its own time; null if older than max_lag.

    One shuffle on key: both sides are united and the last value is carried along. At equal times right comes first,
    and of right's rows the greatest value."""
    fields = F.struct(F.col(t).alias("t"), F.col(value).alias("v"))
    both = right.select(F.col(key), F.col(t).alias("__t"), F.lit(0).alias("__side"), F.col(value).cast("double").alias("__o"), fields.alias("__r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    mine = left.select(F.col(key), F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__o"), F.lit(None).cast(both.schema["__r"].dataType).alias("__r"), F.struct("*").alias("__l"))
    w = Window.partitionBy(key).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.union(mine).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    near: Column = F.lit(True) if max_lag is None else F.col("__t") - F.col("__r.t") <= max_lag
    return found.select("__l.*", F.when(near, F.col("__r.v")).alias(f"asof_{value}"), F.when(near, F.col("__r.t")).alias(f"asof_{t}"))


def _width(least: float, *spans: tuple[DataFrame, str, str]) -> float:
    """Width of buckets: the mean length of all spans, at least `least`. So intervals touch two buckets on average at most,
    whatever their lengths."""
    total, number = 0.0, 0
    for df, start, end in spans:
        length = F.col(end).cast("double") - F.col(start).cast("double")
        found = df.where(length > 0).agg(F.sum(length), F.count("*")).first()
        total, number = total + (found[0] or 0.0), number + found[1]
    return max(least, total / number) if number and math.isfinite(total) else least


def _bucketed(df: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def interval_join(left: DataFrame, right: DataFrame, key: str, low: str, high: str, at: str, width: float, fixed: bool = False) -> DataFrame:
    """Pairs with low <= at <= high (low and high of left, at of right), equal in key. left's intervals are dealt to buckets
    of their mean length, which a job of its own finds; a point lies in one bucket, so no pair appears twice.

    width: of a bucket at least; with fixed, exactly (for intervals that are known to be no longer, which saves the job)."""
    width = width if fixed else _width(width, (left, low, high))
    a = _bucketed(left.withColumnRenamed(key, "__k"), low, high, width, "__b")
    b = right.withColumn("__c", F.floor(F.col(at) / width))
    return a.join(b, (F.col("__k") == F.col(key)) & (F.col("__b") == F.col("__c")) & F.col(at).between(F.col(low), F.col(high))).drop("__k", "__b", "__c")


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of overlapping intervals equal in key. Each pair is kept in the first bucket that both touch. Buckets are of the
    mean length of both sides' intervals, and of width at least."""
    (a0, a1), (b0, b1) = left_span, right_span
    width = _width(width, (left, a0, a1), (right, b0, b1))
    a = _bucketed(left.withColumnRenamed(key, "__k"), a0, a1, width, "__b")
    b = _bucketed(right, b0, b1, width, "__c")
    once = F.col("__b") == F.floor(F.greatest(F.col(a0), F.col(b0)) / width)
    return a.join(b, (F.col("__k") == F.col(key)) & (F.col("__b") == F.col("__c")) & (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)) & once).drop("__k", "__b", "__c")


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, left_at: str, right_at: str, tolerance: float, ident: str) -> DataFrame:
    """left with the nearest row of right within tolerance, equal in key: nearest_<ident>, distance; ties by ident.

    left_id identifies left's rows."""
    a = left.select(F.col(key).alias("__k"), F.col(left_id).alias("__row"), F.col(left_at).alias("__from")).withColumn("__b", F.explode(F.array(*(F.floor(F.col("__from") / tolerance) + i for i in (-1, 0, 1)))))
    b = right.select(key, F.col(right_at).alias("__at"), F.col(ident).alias("__id")).withColumn("__c", F.floor(F.col("__at") / tolerance))
    gap = F.abs(F.col("__from") - F.col("__at"))
    pairs = a.join(b, (F.col("__k") == F.col(key)) & (F.col("__b") == F.col("__c")) & (gap <= tolerance)).groupBy("__row").agg(F.min(F.struct(gap.alias("d"), "__id")).alias("__m"))
    return left.join(pairs, F.col(left_id) == F.col("__row"), "left").select(*left.columns, F.col("__m.__id").alias(f"nearest_{ident}"), F.col("__m.d").alias("distance"))


def nearest_time_score(left: DataFrame, right: DataFrame, key: str, t: str, tau: float) -> DataFrame:
    """left with score, exp(-distance in time to right's nearest row / tau); 0 where there is none. One shuffle on key: the
    last row of right before and the next one after are carried along, however far they are."""
    both = right.select(F.col(key), F.col(t).alias("__t"), F.col(t).alias("__r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    both = both.union(left.select(F.col(key), F.col(t).alias("__t"), F.lit(None).cast("double"), F.struct("*")))
    w = Window.partitionBy(key).orderBy("__t")
    behind, ahead = F.last("__r", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first("__r", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumn("__a", behind).withColumn("__b", ahead).where("__l IS NOT NULL")
    gap = F.least(F.col("__t") - F.col("__a"), F.col("__b") - F.col("__t"))
    return found.select("__l.*", F.coalesce(F.exp(-gap / tau), F.lit(0.0)).alias("score")).drop(t)
