"""Instrument exports in CSV as samples(capture_id, channel, n, t, v)."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .campaign import read_csv

#: Names of time columns.
TIME_NAMES = ["time", "time_s", "t", "seconds", "timestamp", "x"]


def _numbers(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c not in ("ordinal", "source_file")]
    return rows.select("source_file", "ordinal", *(F.expr(f"try_cast(trim(`{c}`) AS double)").alias(c) for c in names))


def _fields(line: str) -> list[str]:
    return next(csv.reader([line]), [])


def header_rows(spark: SparkSession, path: str | list[str]) -> int:
    """Lines before the table in the first file: the first line without numbers whose next line has two numbers or more begins
    it; 0 if there is none. Lines come to the driver one partition after the other, until it is found."""

    def numbers(line: str) -> int:
        found = 0
        for field in _fields(line):
            try:
                found += float(field) == float(field)
            except ValueError:
                pass
        return found

    first = spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()
    before = None
    for i, row in enumerate(spark.read.text(first.path).toLocalIterator()) if first else ():
        if before is not None and len(_fields(before)) > 1 and not numbers(before) and numbers(row.value) >= 2:
            return i - 1
        before = row.value
    return 0


def without_preamble(spark: SparkSession, path: str | list[str], skip: int) -> DataFrame:
    """Rows (columns of the header as strings, source_file, ordinal) of files whose table begins after skip lines; all have the
    header of the first file. The lines to drop are told by their place in a file's first block, so a file is read by as
    many tasks as it has blocks. Fields may hold quoted commas, no line ends."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ordinal"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("b"))
    starts = lines.where("b = 0").groupBy("source_file").agg(F.min("ordinal").alias("__first"))
    placed = lines.join(starts, "source_file").withColumn("k", F.expr("if(b = 0, ordinal - __first, 9223372036854775807)"))
    head = placed.where(F.col("k") == skip).orderBy("source_file").first().value
    names = [x.strip() or f"column_{i}" for i, x in enumerate(_fields(head))]
    kind = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = placed.where(F.col("k") > skip).select("source_file", "ordinal", F.from_csv("value", kind, {"escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("source_file", "ordinal", *(F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)))


def time_column(rows: DataFrame) -> str:
    """The column named like time, else the one that most often rises from row to row (of equal ones the first). One
    aggregation over all rows."""
    names = [c for c in rows.columns if c not in ("ordinal", "source_file")]
    for name in TIME_NAMES:
        for c in names:
            if c.strip().lower() == name:
                return c
    steps = rows.select(*(F.expr(f"`{c}` > lag(`{c}`) OVER (PARTITION BY source_file ORDER BY ordinal)").alias(c) for c in names))
    scores = steps.agg(*(F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in names)).first()
    return max(names, key=lambda c: (scores[c] or 0.0, -names.index(c)))


def analog(spark: SparkSession, path: str, skip: int | None = None) -> DataFrame:
    """Samples of one or more CSV files; a capture is a file. Files with lines before the table share their header, others are
    read by their own. Rows without a time or without any value are skipped, as are channels that are never numbers or
    never change."""
    skip = header_rows(spark, path) if skip is None else skip
    rows = without_preamble(spark, path, skip) if skip else read_csv(spark, path)
    rows = _numbers(rows)
    t = time_column(rows)
    channels = [c for c in rows.columns if c not in ("ordinal", "source_file", t)]
    spread = rows.agg(*(F.expr(f"max(`{c}`) > min(`{c}`)").alias(c) for c in channels)).first()
    live = [c for c in channels if spread[c]]
    long = rows.where(F.col(f"`{t}`").isNotNull()).select("source_file", "ordinal", F.col(f"`{t}`").alias("t"), F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"`{c}`").alias("v")) for c in live)))).where("v IS NOT NULL")
    return long.selectExpr("source_file AS capture_id", "channel", "row_number() OVER (PARTITION BY source_file, channel ORDER BY ordinal) - 1 AS n", "t", "v")


def aligned(captures: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """captures(capture_id, channel, n, t, v) if all share one time vector; raises otherwise. One shuffle on n."""
    apart = captures.groupBy("n").agg((F.max("t") - F.min("t")).alias("d"), F.countDistinct("capture_id").alias("k")).agg(F.max("d").alias("d"), F.min("k").alias("least"), F.max("k").alias("most")).first()
    if apart.d is not None and (apart.d > tolerance or apart.least != apart.most):
        raise ValueError(f"captures do not share a time vector: {apart.d} s apart, {apart.least} to {apart.most} captures at a sample")
    return captures


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a table whose first column is the time and whose others are a capture each."""
    rows = _numbers(read_csv(spark, path))
    t, *names = [c for c in rows.columns if c not in ("ordinal", "source_file")]
    long = rows.select("ordinal", F.col(f"`{t}`").alias("t"), F.inline(F.array(*(F.struct(F.lit(c).alias("capture_id"), F.col(f"`{c}`").alias("v")) for c in names))))
    return long.where("t IS NOT NULL").selectExpr("capture_id", "row_number() OVER (PARTITION BY capture_id ORDER BY ordinal) - 1 AS n", "t", "v")
