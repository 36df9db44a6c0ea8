"""Campaign tables in CSV: manifests, results and scores. All are read with every column a string, so that a bad field is
a value to be judged and never a failed job; empty fields are empty strings."""

from __future__ import annotations

import csv
import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = {
    "manifest": ["capture_id", "signature_id", "family", "truth_label", "expected_fault_present", "noise_tier"],
    "results": ["capture_id", "signature_id", "confidence"],
    "scores": ["capture_id", "truth_label", "signature_id", "confidence"],
}
#: Words that count as true, families that take part, and parts of ids of mechanical faults.
TRUE = ["true", "1", "yes", "y"]
FAMILIES = ["power_quality", "switching_emc", "digital_timing", "measurement_artifact"]
MECHANICAL = ["bearing", "gear", "imbalance", "misalignment", "mechanical", "rotating_machine"]


def read_groups(spark: SparkSession, path: str | list[str], kind: str | None = None) -> list[DataFrame]:
    """The files' rows, a frame for each different header line, so that every file is read by its own columns.

    Columns as strings (null: empty), without a byte order mark; with ordinal, the order of rows by file name and place in
    the file, and source_file. Quoted fields may hold commas, quotes and line ends; for that a file is one task's work.
    Headers are found in two passes over the first blocks; the driver holds the list of files only. Raises if a file misses a
    required column of kind."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("__file")).orderBy("path").toPandas()
    files["__at"] = range(len(files))
    order = F.broadcast(spark.createDataFrame(files[["__file", "__at"]].values.tolist(), "__file string, __at bigint"))  # as long as Spark's own list
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    first = {r.f: r.value.lstrip("\ufeff") for r in _first_lines(text).collect()}
    out = []
    for line in dict.fromkeys(first[f] for f in files["__file"] if f in first):  # an empty file has no header and no rows
        names = [c.strip() or f"column_{i}" for i, c in enumerate(next(csv.reader([line])))]
        names = [c if c not in names[:i] else f"{c}_{i}" for i, c in enumerate(names)]
        if missing := sorted(set(REQUIRED.get(kind, [])) - set(names)):
            raise ValueError(f"{path} misses columns {missing}")
        kind_of = T.StructType([T.StructField(c, T.StringType()) for c in names])
        some = [p for p, f in zip(files["path"], files["__file"], strict=True) if first.get(f) == line]
        rows = spark.read.schema(kind_of).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(some)
        rows = rows.select(*(F.coalesce(F.col(_name(c)), F.lit("")).alias(c) for c in names), F.monotonically_increasing_id().alias("__i"), F.col("_metadata.file_path").alias("__file"))
        out.append(rows.join(order, "__file").select(*(F.col(_name(c)) for c in names), F.expr("shiftleft(__at, 33) | (__i & 8589934591L)").alias("ordinal"), F.col("__file").alias("source_file")))
    if not out:
        raise ValueError(f"{path} has no header")
    return out


def _first_lines(text: DataFrame) -> DataFrame:
    """(f, value) of lines (value, f file, b start of block, i number): each file's first line that is not empty. The numbers are
    found first, then their lines: an aggregate of the lines themselves would sort whole blocks."""
    head = text.where("b = 0 AND value <> ''").groupBy("f").agg(F.min("i").alias("i"))
    return text.where("b = 0").join(F.broadcast(head), ["f", "i"]).select("f", "value")


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def united(groups: list[DataFrame]) -> DataFrame:
    """All rows; where a file lacks a column, it is empty."""
    if len(groups) == 1:
        return groups[0]
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    return every.select(*(F.coalesce(F.col(_name(c)), F.lit("")).alias(c) if t == "string" else F.col(_name(c)) for c, t in every.dtypes))


def read_csv(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    """read_groups in one frame."""
    return united(read_groups(spark, path, kind))


def is_true(column: str) -> Column:
    return F.lower(F.trim(column)).isin(TRUE)


def number(column: str, default: float = 0.0) -> Column:
    """The column as a double; what is no finite number becomes default."""
    value = F.expr(f"try_cast(trim(`{column}`) AS double)")
    return F.when(value.isNotNull() & ~F.isnan(value), value).otherwise(F.lit(default))


def is_mechanical(column: str) -> Column:
    return F.replace(F.lower(column), F.lit("-"), F.lit("_")).rlike("|".join(MECHANICAL))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with expected_fault_present as boolean and waveform_intent from variant or truth_label where it is absent.
    Raises if a signature is a mechanical one."""
    rows = read_csv(spark, path, "manifest")
    if "waveform_intent" not in rows.columns:
        rows = rows.withColumn("waveform_intent", F.col("variant" if "variant" in rows.columns else "truth_label"))
    bad = [r[0] for r in rows.where(is_mechanical("signature_id")).select("signature_id").distinct().orderBy("signature_id").limit(20).collect()]
    if bad:
        raise ValueError(f"mechanical signatures in the manifest: {bad}")
    return rows.withColumn("expected_fault_present", is_true("expected_fault_present"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Results with confidence (bad: 0), raw_matched (from it or matched; absent: true), reference_evidence_score (bad: 0;
    absent: 1) and rank (bad: 0; absent: by confidence, of equal ones the first met). Absent texts are empty, an absent
    threshold_profile is unknown. What is absent is told for the files of each header by themselves."""
    return united([_results(rows) for rows in read_groups(spark, path, "results")])


def _results(rows: DataFrame) -> DataFrame:
    has = set(rows.columns)
    matched = is_true("raw_matched") if "raw_matched" in has else is_true("matched") if "matched" in has else F.lit(True)
    rows = rows.withColumn("raw_matched", matched).withColumn("confidence", number("confidence"))
    rows = rows.withColumn("reference_evidence_score", number("reference_evidence_score") if "reference_evidence_score" in has else F.lit(1.0))
    rank = F.row_number().over(Window.partitionBy("capture_id").orderBy(F.desc("confidence"), "ordinal")) if "rank" not in has else number("rank").cast("int")
    rows = rows.withColumn("rank", rank)
    for name, default in (("threshold_profile", "unknown"), ("warnings", ""), ("conflict_warning", "")):
        if name not in has:
            rows = rows.withColumn(name, F.lit(default))
    return rows


def campaign_scores(spark: SparkSession, scores_path: str, summary_json: str | None = None, summary_csv: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores, and the signatures (signature_id) of the campaign: those of the summary document, else of the summary
    table, else those met. Raises if no row has a truth."""
    rows = read_csv(spark, scores_path, "scores").withColumn("confidence", number("confidence"))
    if rows.where("truth_label <> ''").isEmpty():
        raise ValueError("no row has a truth_label")
    if summary_json:
        named = spark.read.option("multiLine", True).json(summary_json).select(F.explode("loaded_signatures").alias("signature_id")).where("signature_id IS NOT NULL")
        if not named.isEmpty():
            return rows, named
    if summary_csv:
        named = read_csv(spark, summary_csv).where("signature_id <> ''").select("signature_id")
        if not named.isEmpty():
            return rows, named
    return rows, rows.select("signature_id").distinct()


def registry(spark: SparkSession, root: str, statuses: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Signature specifications from all seed_manifest.json below root, and the failures (manifest, error): unreadable
    documents, missing keys, families that take no part, mechanical ids. Build and cache folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "seed_manifest.json").load(root)
    files = files.where(r"NOT path RLIKE '/(dist|build|__pycache__|\\.pytest_cache)/'")
    kind = "seed_id string, family string, status string, version string, entrypoint string"
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    specs = files.select(F.col("path").alias("manifest"), F.from_json(text, kind).alias("s")).select("manifest", "s.*")
    reason = (
        F.when(F.coalesce("seed_id", "family", "status", "entrypoint").isNull(), "not a specification")
        .when(F.col("seed_id").isNull() | F.col("family").isNull() | F.col("entrypoint").isNull(), "a required key is missing")
        .when(~F.col("family").isin(FAMILIES) | is_mechanical("seed_id"), F.concat(F.lit("skipped: "), "seed_id"))
    )
    judged = specs.withColumn("error", reason)
    good = judged.where("error IS NULL").drop("error")
    return (good.where(F.col("status").isin(statuses)) if statuses else good), judged.where("error IS NOT NULL").select("manifest", "error")


def registry_errors(entries: DataFrame) -> DataFrame:
    """(seed_id, error) of registry entries(seed_id, family): families that do not exist, mechanical ids."""
    problems = F.array(F.when(~F.coalesce(F.col("family").isin(FAMILIES), F.lit(False)), F.concat(F.lit("invalid family "), F.coalesce("family", F.lit("null")))), F.when(is_mechanical("seed_id"), F.lit("mechanical-only id")))
    return entries.select("seed_id", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("error"))


def capture_files(spark: SparkSession, path: str, extensions: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files below path of the given extensions (path, length; the first most by path, a limit that the caller asks for),
    and warnings (path, warning) for all others. Only the listing is read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    known = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions])
    found = files.where(known).orderBy("path")
    return (found.limit(most) if most is not None else found), files.where(~known).select("path", F.lit("unsupported file type").alias("warning"))
