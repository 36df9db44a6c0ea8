"""Writers of result tables: evidence, thresholds and the validation store. Tables are written by Spark, as many files as
they have partitions; hashes are computed where the files lie."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import deployable_thresholds, threshold_sweep


def stable_json(column: str) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))


def capture_documents(rows: DataFrame, key: str = "capture_id", order: str = "rank") -> DataFrame:
    """(capture, document): each capture's rows nested in order under it, as JSON. A capture has as many rows as there are
    signatures."""
    others = [c for c in rows.columns if c not in (key, order)]
    nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("results"))
    return nested.select(key, F.to_json(F.struct(key, "results")).alias("document"))


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """df as CSV with a header (nulls empty) or JSON lines, over what was there; nested columns of CSV as JSON."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    else:
        df.write.mode("overwrite").json(path)


def hashes(spark: SparkSession, root: str) -> DataFrame:
    """(file, bytes, sha256) of all files of data below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = F.regexp_extract("path", r"([^/]+/part-[^/]+|[^/]+)$", 1)
    return files.select(part.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_evidence(root: str, tables: dict[str, DataFrame], ranked: DataFrame, config: dict[str, str]) -> DataFrame:
    """Every table as CSV under its name, ranked as JSON lines with a capture's results nested, config as JSON, and a
    manifest with the hash of every file; returns the manifest."""
    spark = ranked.sparkSession
    for name, df in tables.items():
        write_table(df, f"{root}/{name}")
    write_table(capture_documents(ranked), f"{root}/ranked_results", "json")
    write_table(spark.range(1).select(F.create_map(*(F.lit(x) for kv in sorted(config.items()) for x in kv)).alias("config")), f"{root}/config", "json")
    found = hashes(spark, root).where("NOT file LIKE 'manifest/%'")
    write_table(found, f"{root}/manifest", "json")
    return spark.read.schema("file string, bytes bigint, sha256 string").json(f"{root}/manifest")


def report_documents(rows: DataFrame, title: str = "Report", key: str = "capture_id", order: str = "rank") -> DataFrame:
    """(key, markdown): a report for each capture, its rows as a table in order. Bars in values are escaped, nulls empty."""
    shown = [c for c in rows.columns if c != key]
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in shown)), F.lit(" |"))
    lines = rows.select(F.col(key), F.col(order).alias("__at"), line.alias("__line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", "__line"))).alias("l"))
    head = F.concat(F.lit(f"# {title}: "), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\n\n| " + " | ".join(shown) + " |\n|" + " --- |" * len(shown) + "\n"))
    return lines.select(key, F.concat(head, F.array_join(F.transform("l", lambda x: x["__line"]), "\n"), F.lit("\n")).alias("markdown"))


def write_campaign(root: str, ranked: DataFrame, config: dict[str, str], problems: DataFrame | None = None) -> None:
    """A campaign's results as CSV, as JSON lines nested by capture and as a table of reports (one row a capture, not one
    file each), config and, if given, problems (warnings and registry failures) as JSON lines."""
    write_table(ranked, f"{root}/campaign_results")
    write_table(capture_documents(ranked), f"{root}/campaign_documents", "json")
    write_table(report_documents(ranked), f"{root}/reports", "json")
    write_table(ranked.sparkSession.createDataFrame(sorted(config.items()), "name string, value string"), f"{root}/run_config", "json")
    if problems is not None:
        write_table(problems, f"{root}/problems", "json")


def write_summary_tables(root: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Tables (tracks, metrics, observations; channel, harmonic and pair statistics) as CSV under their names, and a
    summary (name, rows, columns) of what was written as JSON lines, which comes back. Tables without columns are left out."""
    summary = None
    for name, df in sorted(tables.items()):
        if not df.columns:
            continue
        write_table(df, f"{root}/{name}")
        back = df.sparkSession.read.option("header", True).option("multiLine", True).option("escape", '"').schema(", ".join(f"`{c}` string" for c in df.columns)).csv(f"{root}/{name}")
        row = back.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))
        summary = row if summary is None else summary.unionAll(row)
    if summary is None:
        raise ValueError("no table to write")
    write_table(summary, f"{root}/summary", "json")
    return summary.sparkSession.read.schema("name string, rows bigint, columns int").json(f"{root}/summary")


def write_thresholds(scores: DataFrame, root: str, thresholds: list[float], min_tpr: float = 0.9, max_fpr: float = 0.05) -> None:
    """The threshold sweep and the deployable thresholds as CSV tables."""
    sweep = threshold_sweep(scores, thresholds, min_tpr, max_fpr)
    write_table(sweep, f"{root}/threshold_evaluation")
    write_table(deployable_thresholds(sweep), f"{root}/deployable_thresholds")


class ValidationStore:
    """Cases by capture id and results by session in Parquet tables under root. A change writes a new version of a table
    beside the old one; readers take the newest, so none sees half a change."""

    CASES = "capture_id string, file_path string, truth_label string, expected_signature string, notes string, updated_at timestamp"
    RESULTS = "session_id string, created_at timestamp, capture_id string, signature_id string, matched boolean, confidence double"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        every = [s.getPath() for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName() for p in every if fs.exists(done(p, "_SUCCESS")))

    def _read(self, name: str, kind: str) -> DataFrame:
        found = self._versions(name)
        return self.spark.read.schema(kind).parquet(f"{self.root}/{name}/{found[-1]}") if found else self.spark.createDataFrame([], kind)

    def _write(self, name: str, df: DataFrame) -> None:
        n = len(self._versions(name))
        df.write.parquet(f"{self.root}/{name}/v{n:08d}-{uuid.uuid4().hex[:8]}")

    def cases(self) -> DataFrame:
        return self._read("cases", self.CASES)

    def upsert(self, cases: DataFrame) -> None:
        """cases replace those of the same capture_id; of repeated ones the latest update counts."""
        new = cases.select("capture_id", "file_path", "truth_label", "expected_signature", "notes", F.coalesce("updated_at", F.current_timestamp()).alias("updated_at"), F.lit(1).alias("age")) if "updated_at" in cases.columns else cases.select("capture_id", "file_path", "truth_label", "expected_signature", "notes", F.current_timestamp().alias("updated_at"), F.lit(1).alias("age"))
        w = Window.partitionBy("capture_id").orderBy(F.desc("age"), F.desc("updated_at"))
        both = self.cases().withColumn("age", F.lit(0)).unionByName(new).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "age")
        self._write("cases", both)

    def results(self) -> DataFrame:
        return self._read("results", self.RESULTS)

    def record(self, session_id: str, rows: DataFrame) -> None:
        """rows(capture_id, signature_id, matched, confidence) are the session's results; recording a session again
        replaces it."""
        new = rows.select(F.lit(session_id).alias("session_id"), F.current_timestamp().alias("created_at"), "capture_id", "signature_id", "matched", "confidence")
        self._write("results", self.results().where(F.col("session_id") != session_id).unionByName(new))

    def summary(self, session_id: str | None = None) -> DataFrame:
        """Counts of TP, FP, TN, FN by signature in a session (the latest by default), of cases with a truth."""
        rows = self.results()
        if session_id is None:
            latest = rows.agg(F.max_by("session_id", F.struct("created_at", "session_id")).alias("s")).first().s
            session_id = latest or ""
        marked = rows.where(F.col("session_id") == session_id).join(self.cases().select("capture_id", "expected_signature"), "capture_id").where("expected_signature <> ''")
        truth, hit = F.col("signature_id") == F.col("expected_signature"), F.col("matched")
        return marked.groupBy("session_id", "signature_id").agg(F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & ~truth).alias("tn"), F.count_if(~hit & truth).alias("fn"))

    def export(self, path: str) -> None:
        write_table(self.cases().orderBy("capture_id"), f"{path}/cases")
        write_table(self.results().orderBy("session_id", "capture_id", "signature_id"), f"{path}/results", "json")
