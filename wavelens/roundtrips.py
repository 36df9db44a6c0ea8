"""Queries that write the given tables out, read them back by the library's readers and count what came, and streams
over them; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import CUTS, ORACLE_SQL, query, r
from .plans import views
from .plans.views import MANIFEST, REFERENCES, SAMPLES, SCORES
from .sources import campaign, scope, writers
from .streaming import detector, sessions
from .tables import shared_dir


def place(spark) -> str:
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


@query(f"WITH {MANIFEST} SELECT signature_id, family, noise_tier, expected_fault_present, waveform_intent, count(*) AS n FROM manifest GROUP BY ALL")
def q111_manifest_round_trip(spark, sf_dir):
    """A manifest written as CSV and loaded again."""
    at = place(spark)
    writers.write_table(views.manifest(spark, sf_dir).withColumn("truth_label", F.col("family")), at)
    return campaign.manifest(spark, at).groupBy("signature_id", "family", "noise_tier", "expected_fault_present", "waveform_intent").agg(F.count("*").alias("n"))


@query(f"""WITH {REFERENCES}, a AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC) AS rank, '' AS warnings FROM refs0 WHERE capture_id % 2 = 1),
    b AS (SELECT *, 3 AS rank, reference_label || ', "x"' || chr(10) || 'y | z' AS warnings FROM refs0 WHERE capture_id % 2 = 0), c AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT signature_id, warnings, count(*) AS n, round(sum(confidence), 6) AS confidence, count(*) FILTER (matched) AS matched FROM c GROUP BY ALL""")
def q112_results_round_trip(spark, sf_dir):
    """Results in files of two headers, whose columns stand in other orders and whose fields hold quotes and line ends."""
    rows = views.references(spark, sf_dir)
    first, second = place(spark), place(spark)
    writers.write_table(rows.where("capture_id % 2 = 1").select("capture_id", "signature_id", "confidence", "matched"), first)
    warnings = F.concat("reference_label", F.lit(', "x"\ny | z'))
    writers.write_table(rows.where("capture_id % 2 = 0").select("signature_id", "capture_id", F.lit(3).alias("rank"), warnings.alias("warnings"), "confidence", F.col("matched").alias("raw_matched")), second)
    back = campaign.results(spark, [first, second])
    return back.groupBy("signature_id", "warnings").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.count_if("raw_matched").alias("matched"))


@query(f"WITH {SCORES} SELECT signature_id, truth AS truth_label, count(*) AS n, round(sum(confidence), 6) AS confidence, true AS named FROM scores GROUP BY ALL")
def q113_scores_round_trip(spark, sf_dir):
    """Scores of a campaign with the signatures that its summary document names."""
    at, document = place(spark), place(spark)
    rows = views.scores(spark, sf_dir)
    writers.write_table(rows.select("capture_id", F.col("truth").alias("truth_label"), "signature_id", "confidence"), at)
    rows.agg(F.collect_set("signature_id").alias("loaded_signatures")).write.json(document)
    scores, named = campaign.campaign_scores(spark, at, document)
    marked = scores.join(named.withColumn("named", F.lit(True)), "signature_id", "left")
    return marked.groupBy("signature_id", "truth_label", "named").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))


@query(f"WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings), m AS (SELECT 'ch ' || label || ', mean' AS channel, n, avg(v) AS v FROM e GROUP BY ALL) SELECT channel, kind, count(*) AS samples, {r('sum(v) AS total', 'max(n) / 1000.0 AS end_s')} FROM m, (VALUES ('preamble'), ('plain'), ('tracks')) k(kind) GROUP BY ALL")
def q114_scope_round_trip(spark, sf_dir):
    """Mean waveforms as instrument exports: with lines before the table, without, and as tracks."""
    from functools import reduce

    mean = views.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("n", "v")).groupBy("n", F.concat(F.lit("ch "), "label", F.lit(", mean")).alias("channel")).agg(F.avg("v").alias("v"))
    names = [x.channel for x in mean.select("channel").distinct().orderBy("channel").collect()]  # one for each label
    wide = mean.groupBy((F.col("n") / 1000).alias("time_s")).pivot("channel", names).agg(F.first("v")).orderBy("time_s").coalesce(1)
    plain, noted = place(spark), place(spark)
    writers.write_table(wide, plain)
    head = ["Model,X1", "no table yet", ",".join(["time_s", *(f'"{c}"' for c in names)])]
    lines = spark.range(1).select(F.explode(F.array(*map(F.lit, head))).alias("value")).coalesce(1).union(wide.select(F.concat_ws(",", *(F.col(f"`{c}`").cast("string") for c in wide.columns)).alias("value")))
    lines.coalesce(1).write.text(noted)
    sources = {"preamble": scope.analog(spark, noted), "plain": scope.analog(spark, plain), "tracks": scope.tracks(spark, plain).withColumnRenamed("capture_id", "channel")}
    parts = [df.groupBy("channel").agg(F.count("*").alias("samples"), F.sum("v").alias("total"), F.max("t").alias("end_s")).withColumn("kind", F.lit(k)) for k, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {SCORES} SELECT signature_id, count(*) AS n, count(DISTINCT capture_id) AS captures, round(sum(confidence), 6) AS confidence, 0::BIGINT AS changed FROM scores GROUP BY ALL")
def q115_evidence_round_trip(spark, sf_dir):
    """Evidence tables: the nested results read back, and files whose hash is not the manifest's."""
    at = place(spark)
    rows = views.scores(spark, sf_dir).withColumn("rank", F.expr("row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, signature_id)"))
    manifest = writers.write_evidence(at, {"scores": rows}, rows.select("capture_id", "rank", "signature_id", "confidence"), {"b": "2", "a": "1"})
    now = writers.hashes(spark, at).select("file", F.col("sha256").alias("now"))
    changed = manifest.join(now, "file", "left").agg(F.count_if(~F.coalesce(F.col("sha256") == F.col("now"), F.lit(False))).alias("changed"))
    nested = spark.read.schema("document string").json(f"{at}/ranked_results").select(F.from_json("document", "capture_id bigint, results array<struct<rank:int,signature_id:string,confidence:double>>").alias("d"))
    back = nested.select("d.capture_id", F.inline("d.results")).groupBy("signature_id").agg(F.count("*").alias("n"), F.countDistinct("capture_id").alias("captures"), F.sum("confidence").alias("confidence"))
    return back.join(F.broadcast(changed))  # one row


@query(f"SELECT signature_id, round(threshold, 6) AS threshold, tp, fp, tn, fn FROM ({ORACLE_SQL['q14_threshold_sweep']})")
def q116_threshold_files(spark, sf_dir):
    """The threshold sweep from the files it was written to."""
    at = place(spark)
    writers.write_thresholds(views.scores(spark, sf_dir), at, CUTS)
    return campaign.read_csv(spark, f"{at}/threshold_evaluation").select("signature_id", F.col("threshold").cast("double").alias("threshold"), *(F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")))


@query(f"""WITH {SCORES}, s AS (SELECT signature_id, matched, CASE WHEN capture_id % 3 = 0 THEN 'N' ELSE truth END AS truth FROM scores)
    SELECT signature_id, count(*) FILTER (matched AND signature_id = truth) AS tp, count(*) FILTER (matched AND signature_id <> truth) AS fp, count(*) FILTER (NOT matched AND signature_id <> truth) AS tn, count(*) FILTER (NOT matched AND signature_id = truth) AS fn FROM s GROUP BY 1""")
def q117_validation_store(spark, sf_dir):
    """Cases and results recorded, cases changed, a session recorded again, and its summary."""
    store = writers.ValidationStore(spark, place(spark))
    rows = views.scores(spark, sf_dir)
    cases = rows.select(F.col("capture_id").cast("string").alias("capture_id"), F.lit("f").alias("file_path"), F.lit("positive").alias("truth_label"), F.col("truth").alias("expected_signature"), F.lit("").alias("notes")).distinct()
    store.upsert(cases)
    store.upsert(cases.where("capture_id % 3 = 0").withColumn("expected_signature", F.lit("N")))
    found = rows.select(F.col("capture_id").cast("string").alias("capture_id"), "signature_id", "matched", "confidence")
    store.record("s1", found.limit(1))
    store.record("s2", found.withColumn("matched", F.lit(True)))
    store.record("s2", found)
    return store.summary("s2").drop("session_id")


@query(f"WITH {SCORES} SELECT 'scores' AS name, count(*) AS rows, 6 AS columns FROM scores UNION ALL SELECT 'tiers', count(DISTINCT tier), 2 FROM scores")
def q118_summary_tables(spark, sf_dir):
    rows = views.scores(spark, sf_dir)
    return writers.write_summary_tables(place(spark), {"scores": rows, "tiers": rows.groupBy("tier").count()})


@query(f"""WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, signature_id) AS rank FROM scores)
    SELECT capture_id, string_agg(signature_id, '>' ORDER BY rank) AS ranked, '{{"a":"' || min(signature_id) || '","b":"' || max(truth) || '"}}' AS labels, sha256(capture_id::VARCHAR) AS id_hash FROM k GROUP BY capture_id""")
def q119_capture_documents(spark, sf_dir):
    """Nested documents and maps as JSON with keys in order, read back."""
    rows = views.scores(spark, sf_dir).withColumn("rank", F.expr("row_number() OVER (PARTITION BY capture_id ORDER BY confidence DESC, signature_id)"))
    nested = writers.capture_documents(rows.select("capture_id", "rank", "signature_id", "truth")).select("capture_id", F.from_json("document", "results array<struct<rank:int,signature_id:string,truth:string>>").alias("d"))
    # The labels are taken from the documents: a second aggregate of the scores would hold all its sorts beside those of the first.
    signatures, truths = F.transform("d.results", lambda x: x.signature_id), F.transform("d.results", lambda x: x.truth)
    marked = nested.withColumn("m", F.create_map(F.lit("b"), F.array_max(truths), F.lit("a"), F.array_min(signatures)))
    return marked.select("capture_id", F.array_join(signatures, ">").alias("ranked"), writers.stable_json("m").alias("labels"), F.sha2(F.col("capture_id").cast("string"), 256).alias("id_hash"))


@query("""WITH e AS (SELECT CASE WHEN p_size % 7 = 0 THEN 'gear-' || p_partkey ELSE 's' || p_partkey END AS seed_id, CASE p_size % 4 WHEN 0 THEN 'power_quality' WHEN 1 THEN 'digital_timing' WHEN 2 THEN 'other' END AS family FROM part)
    SELECT seed_id, 'invalid family ' || coalesce(family, 'null') AS error FROM e WHERE coalesce(family, '') NOT IN ('power_quality', 'digital_timing') UNION ALL SELECT seed_id, 'mechanical-only id' FROM e WHERE seed_id LIKE 'gear%'""")
def q120_registry_errors(spark, sf_dir):
    entries = views.table(spark, sf_dir, "part").selectExpr("CASE WHEN p_size % 7 = 0 THEN concat('gear-', p_partkey) ELSE concat('s', p_partkey) END AS seed_id", "CASE p_size % 4 WHEN 0 THEN 'power_quality' WHEN 1 THEN 'digital_timing' WHEN 2 THEN 'other' END AS family")
    return campaign.registry_errors(entries)


def streamed(spark, sf_dir, make) -> DataFrame:
    """What make gives over events(capture_id, ts, v, event_id, event_type) as a stream, once all that lies there is read."""
    kind = views.table(spark, sf_dir, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = spark.readStream.schema(kind)  # streams read folders: a table of one file is picked from its own by name
    source = source.parquet(f"{sf_dir}/events.parquet") if folder else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.selectExpr("user_id AS capture_id", "CAST(ts AS timestamp) AS ts", "value AS v", "event_id", "event_type")
    at = place(spark)
    q = make(rows).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


#: Streams give a window when the watermark, an hour behind the newest row, has passed its end.
PASSED = "epoch_ms(date_trunc('milliseconds', (SELECT max(ts) FROM events))) - 3600000"


@query(f"""WITH w AS (SELECT user_id AS capture_id, (epoch_us(ts) // 86400000000) * 86400000000 AS s, value AS v FROM events) SELECT capture_id, s AS start_us, count(*) AS count, {r('avg(v) AS mean', 'sqrt(avg(v * v)) AS rms')} FROM w GROUP BY ALL HAVING s // 1000 + 86400000 <= {PASSED}""")
def q121_stream_windows(spark, sf_dir):
    """Daily statistics of each user's values, as a stream."""
    return streamed(spark, sf_dir, lambda s: sessions.windowed_stats(s, "1 day", "1 hour")).select("capture_id", F.unix_micros("start").alias("start_us"), "count", "mean", "rms")


@query(f"""WITH w AS (SELECT user_id AS capture_id, (epoch_us(ts) // 43200000000 - b) * 43200000000 AS s, value AS v FROM events, (VALUES (0), (1)) x(b)) SELECT capture_id, s AS start_us, count(*) AS count, {r('avg(v) AS mean', 'sqrt(avg(v * v)) AS rms')} FROM w GROUP BY ALL HAVING s // 1000 + 86400000 <= {PASSED}""")
def q122_stream_sliding(spark, sf_dir):
    """Statistics of daily windows that begin twice a day, as a stream."""
    return streamed(spark, sf_dir, lambda s: sessions.windowed_stats(s, "1 day", "1 hour", "12 hours")).select("capture_id", F.unix_micros("start").alias("start_us"), "count", "mean", "rms")


@query(f"""WITH o AS (SELECT user_id AS capture_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 28800000000 THEN 0 ELSE 1 END AS opens FROM events), g AS (SELECT *, sum(opens) OVER (PARTITION BY capture_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM o)
    SELECT capture_id, count(*) AS events, min(t) AS start_us, max(t) AS last_us FROM g GROUP BY capture_id, g HAVING (max(t) + 28800000000) // 1000 <= {PASSED}""")
def q123_stream_sessions(spark, sf_dir):
    """Each user's sessions with pauses under eight hours, as a stream."""
    return streamed(spark, sf_dir, lambda s: sessions.gap_sessions(s, "8 hours", "1 hour")).select("capture_id", "events", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"))


@query("""SELECT a.user_id AS capture_id, a.event_id AS source_id, b.event_id AS output_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND b.ts >= a.ts + INTERVAL 1 MINUTE AND b.ts <= a.ts + INTERVAL 12 HOUR""")
def q124_stream_pairs(spark, sf_dir):
    """Clicks within half a day after purchases, joined as streams."""
    side = lambda s, kind, name: s.where(f"event_type = '{kind}'").selectExpr("capture_id", "ts", f"event_id AS {name}")
    return streamed(spark, sf_dir, lambda s: sessions.interval_pairs(side(s, "purchase", "source_id"), side(s, "click", "output_id"), "1 minutes", "12 hours", "1 hour")).select("capture_id", "source_id", "output_id")


@query(f"""WITH {SAMPLES}, q AS (SELECT *, v >= 60 AS up, v <= 20 AS down FROM samples), m AS (SELECT *, CASE WHEN up AND coalesce(lag(up) OVER w, false) THEN 1 WHEN down THEN 0 END AS mark FROM q WINDOW w AS (PARTITION BY capture_id ORDER BY n)),
    s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS state FROM m), e AS (SELECT *, lag(state, 1, 0) OVER (PARTITION BY capture_id ORDER BY n) AS was FROM s),
    g AS (SELECT *, sum(CASE WHEN state = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS event FROM e), c AS (SELECT capture_id, event, min(n) - 1 AS start_n, max(CASE WHEN state = 0 THEN n END) AS end_n FROM g WHERE event > 0 AND (state = 1 OR was = 1) GROUP BY ALL HAVING count(*) FILTER (state = 0) > 0)
    SELECT c.capture_id, c.event::BIGINT AS event, start_n, end_n FROM c JOIN samples x ON x.capture_id = c.capture_id AND x.n = c.end_n JOIN events v ON v.event_id = x.event_id WHERE epoch_ms(v.ts) <= {PASSED}""")
def q125_stream_detector(spark, sf_dir):
    """Events of a detector that enters after two values at 60 and leaves at 20, as a stream; the silence is endless."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return streamed(spark, sf_dir, lambda s: detector.hysteresis_events(s, 60.0, 20.0, enter_n=2, late="1 hour", silence_ms=10**12)).select("capture_id", "event", "start_n", "end_n")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
