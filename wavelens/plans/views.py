"""The star schema's tables as captures, scores and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples(capture_id, n, t, v, event_id, event_type): a capture is a user, t seconds since its start."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return e.selectExpr("user_id AS capture_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n", "timestampdiff(MICROSECOND, min(ts) OVER (PARTITION BY user_id), ts) / 1e6 AS t", "value AS v", "event_id", "event_type")


SAMPLES = """samples AS (SELECT user_id AS capture_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
    epoch_us(ts) / 1e6 - epoch_us(min(ts) OVER (PARTITION BY user_id)) / 1e6 AS t0, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS t, value AS v, event_id, event_type FROM events)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as scores(capture_id, signature_id, confidence, matched, truth, tier): one row for each order
    and return flag, the most confident; truth from the order's status."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("capture_id"), F.col("l_returnflag").alias("signature_id")).agg((F.max("l_quantity") / 50).alias("confidence"))
    truth = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise("A")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("capture_id"), truth.alias("truth"), F.col("o_orderpriority").alias("tier"))
    return items.join(orders, "capture_id").withColumn("matched", F.col("confidence") >= 0.5)


SCORES = """scores AS (SELECT *, confidence >= 0.5 AS matched FROM (SELECT l_orderkey AS capture_id, l_returnflag AS signature_id, max(l_quantity) / 50 AS confidence FROM lineitem GROUP BY ALL) AS i
    JOIN (SELECT o_orderkey AS capture_id, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END AS truth, o_orderpriority AS tier FROM orders) AS o USING (capture_id))"""


def decisions(scored: DataFrame) -> DataFrame:
    """One row a capture: the winner is its most confident matched signature, ties by id; null if none matches."""
    best = F.max(F.when(F.col("matched"), F.struct("confidence", F.translate("signature_id", "ANR", "cba").alias("o"), "signature_id")))
    return scored.groupBy("capture_id", "truth", "tier").agg(best.alias("b")).select("capture_id", "truth", "tier", F.col("b.signature_id").alias("winner"), F.col("b.confidence").alias("winner_confidence"))


DECISIONS = """decisions AS (SELECT capture_id, any_value(truth) AS truth, any_value(tier) AS tier, max(CASE WHEN matched AND r = 1 THEN signature_id END) AS winner, max(CASE WHEN matched AND r = 1 THEN confidence END) AS winner_confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY matched DESC, confidence DESC, signature_id) AS r FROM scores) GROUP BY capture_id)"""


def vectors(spark: SparkSession, sf_dir: str, rate: float = 4096.0) -> DataFrame:
    """embeddings as captures against their label's mean vector, the reference."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("capture_id"), "label", F.col("embedding").cast("array<double>").alias("primary"))
    mean = e.select("label", F.posexplode("primary").alias("n", "v")).groupBy("label", "n").agg(F.avg("v").alias("m"))
    reference = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "m"))), lambda x: x.m).alias("reference"))
    return e.join(reference, "label").select("capture_id", F.col("label").cast("string").alias("reference_label"), F.lit(rate).alias("rate"), "primary", "reference")


def vector_pairs(spark: SparkSession, sf_dir: str, rate: float = 4096.0) -> DataFrame:
    """embeddings as captures against two references each, exploded: their label's mean vector and the next label's."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("capture_id"), "label", F.col("embedding").cast("array<double>").alias("primary"))
    mean = e.select("label", F.posexplode("primary").alias("n", "v")).groupBy("label", "n").agg(F.avg("v").alias("m"))
    reference = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "m"))), lambda x: x.m).alias("reference"))
    every = reference.agg(F.array_sort(F.collect_set("label")).alias("all"))  # one row: the labels
    next_of = every.select(F.posexplode("all").alias("i", "label"), "all").select("label", F.expr("array_distinct(array(label, all[(i + 1) % size(all)]))").alias("refs"))
    pairs = e.join(next_of, "label").select("capture_id", "primary", F.explode("refs").alias("label"))
    return pairs.join(reference, "label").select("capture_id", F.col("label").cast("string").alias("reference_label"), F.lit(rate).alias("rate"), "primary", "reference")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as references(capture_id, signature_id, reference_label, confidence, matched) of orders' return flags."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("capture_id"), F.col("l_returnflag").alias("signature_id"), F.concat(F.lit("line"), "l_linenumber").alias("reference_label"), (F.col("l_quantity") / 50).alias("confidence"))
    return items.withColumn("matched", F.col("confidence") >= 0.5)


REFERENCES = "refs0 AS (SELECT *, confidence >= 0.5 AS matched FROM (SELECT l_orderkey AS capture_id, l_returnflag AS signature_id, 'line' || l_linenumber AS reference_label, l_quantity / 50 AS confidence FROM lineitem))"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a manifest: the expected signature from the status, split by key, noise from the priority."""
    return table(spark, sf_dir, "orders").selectExpr(*MANIFEST_COLUMNS)


MANIFEST_COLUMNS = [
    "o_orderkey AS capture_id", "CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END AS signature_id", "CASE o_orderstatus WHEN 'F' THEN 'return' ELSE 'keep' END AS family", "o_orderkey % 3 <> 0 AS expected_fault_present", "CASE WHEN o_orderkey % 3 <> 0 THEN 'positive' ELSE 'negative' END AS truth_label",
    "CASE o_orderkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split", "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'normal' END AS noise_tier", "o_orderpriority AS waveform_intent", "concat(o_orderstatus, '-', substr(o_orderpriority, 1, 1)) AS test_id",
]
MANIFEST = f"manifest AS (SELECT {', '.join(MANIFEST_COLUMNS)} FROM orders)"
