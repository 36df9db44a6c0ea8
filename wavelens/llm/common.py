"""Shared pieces of the corpus operators: durable intermediate tables, row keys and connected components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialise, shared_dir  # noqa: F401


def written(df: DataFrame) -> DataFrame:
    """materialise, for large tables: compressed more, and the shuffle files behind it are let go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    let_go(spark)
    return out


def removed(table: DataFrame) -> None:
    """Delete a table that written or materialise made, by any frame of its columns. Nothing may read it afterwards."""
    jvm = table.sparkSession._jvm
    for file in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def let_go(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished work when the driver collects its garbage. Many small stages over many
    partitions leave more in files than in rows, so loops ask for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shortened(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; the files go when the frame does."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*columns: str):
    """128-bit key of a row's content, null-safe. Rows of equal content share it."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x00", *parts)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected edges (a, b), as rows (id, component) with the least id of each component.

    Alternates two star contractions: every node hands its larger neighbours to its least one, then its smaller
    ones. Each round is aggregations and equi-joins, so a hub's rows are pre-aggregated or split by adaptive skew
    joins; no group is gathered. Null ends and self links are ignored; nodes without links don't appear.
    """

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())

    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = shortened(e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = stamp(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        ends = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.join(least, e.lo == least.u).select("hi", F.col("m").alias("lo")).where("hi <> lo").distinct()
        roots = large.groupBy(F.col("hi").alias("r_hi")).agg(F.min("lo").alias("m"))
        small = (
            large.join(roots, large.hi == roots.r_hi)
            .where("lo <> m")
            .select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))
            .union(roots.select("r_hi", "m"))
            .distinct()
        )
        e = shortened(small)
        del ends, least, large, roots, small
        let_go(edges.sparkSession)
        if (now := stamp(e)) == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(e.select(F.col("lo"), F.col("lo")).distinct())
