"""Near-duplicate embeddings: spherical k-means deals vectors to cells, blocked products compare within cells.

A vector also probes each other cell that may hold a partner: one whose nearest members are no farther than the
threshold allows, by the cell's radius and by the distance to the plane between both centres. So no link across
cells is lost. Equal vectors are one vector with a multiplicity throughout. Cells are searched in waves, and a wave's
shuffle files go before the next one begins; so disk follows the input even where vectors without clusters probe most cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, let_go, materialise
from .pairing import Union, block_pairs, sides

CELL_ROWS = 16384
MAX_CELLS = 1024
SAMPLE = 20_000

#: Rows of a block at least and at most: a row is shuffled once for each block that its own meets.
BLOCKS = 2048, 16384

#: Vectors' components that a wave shuffles; as many as all vectors have, if these are more.
WAVE = 32_000_000


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centres of unit rows v; an empty cell keeps its centre."""
    centres = v[np.random.default_rng(seed).choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        home = (v @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, home, v)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding", cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> DataFrame:
    """Links between all pairs of vectors with cosine (double precision) of threshold or more.

    Returns a row per input row: vec_id, n_links (other rows linked directly), component_id (least vec_id reachable,
    itself included), kept (vec_id = component_id). Vectors that are null, empty or zero, or hold null or non-finite
    components link with nothing; their component is their own id. Vectors of different lengths never link. Rows that
    repeat an id are rows of their own; a row with a null id links like any other, its component being the least id
    known (null if there is none). Extra columns are ignored, an empty table gives no rows.

    The centres are fitted on a bounded sample (sample rows); all rows are dealt to cells and compared.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"  # as narrow as they came
    base = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast(kind).alias("v"))
    good = "v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity')) AND exists(v, c -> c <> 0)"
    base = base.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    base = base.withColumn("v", F.expr("if(good, transform(v, c -> c + 0.0D), NULL)").cast(kind))
    distinct = base.where("good").groupBy("v").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"))
    distinct = materialise(distinct.withColumn("rep", F.monotonically_increasing_id()))
    dims = [r[0] for r in distinct.select(F.size("v")).distinct().collect()]  # lengths of vectors, usually one
    edges, counts = [], []
    for dim in dims:
        rows = distinct.where(F.size("v") == dim) if len(dims) > 1 else distinct
        found = _links(rows, dim, threshold, cell_rows, sample)
        counts.append(found.groupBy("rep").agg(F.sum("n").alias("n")))
        edges.append(found.selectExpr("rep AS a", "root AS b").distinct())
    if not dims:
        return base.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    every = edges[0]
    for e in edges[1:]:
        every = every.union(e)
    n_links = counts[0]
    for c in counts[1:]:
        n_links = n_links.union(c)
    parts = connected_components(every).withColumnRenamed("id", "rep")
    grouped = distinct.select("rep", "v", "mult", "least").join(parts, "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    ids = grouped.groupBy("part").agg(F.min("least").alias("component_id"))
    known = grouped.join(ids, "part").join(n_links, "rep", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    out = base.join(known.withColumnRenamed("v", "w"), F.col("v") == F.col("w"), "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links(rows: DataFrame, dim: int, threshold: float, cell_rows: int, sample: int) -> DataFrame:
    """rows(rep, v, mult) -> (rep, n, root): number of rows linked to rep in some group, and rep's least partner there."""
    n = rows.count()
    k = max(1, min(MAX_CELLS, n // cell_rows))
    picked = rows.where(f"pmod(xxhash64(rep), {max(1, -(-n // sample))}) = 0").select("v").toPandas()  # about sample rows
    fitted = np.array(picked.v.tolist() or [np.ones(dim)], float)
    centres = spherical_kmeans(unit(fitted), k)
    angle = math.acos(max(-1.0, min(1.0, threshold))) + 1e-9
    chord = 2 * math.sin(angle / 2)

    def homes(batches):
        for pdf in batches:
            sims = unit(np.array(pdf.v.tolist(), float)) @ centres.T
            yield pd.DataFrame({"cell": sims.argmax(1), "far": np.arccos(np.clip(sims.max(1), -1, 1))})

    radii = np.zeros(len(centres))
    for r in rows.select("v").mapInPandas(homes, "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect():  # MAX_CELLS rows at most
        radii[r.cell] = r.far + 1e-9
    gap = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))

    def assign(batches):
        for pdf in batches:
            sims = unit(np.array(pdf.v.tolist(), float)) @ centres.T
            home = sims.argmax(1)
            own = sims[np.arange(len(home)), home]
            reach = np.arccos(np.clip(sims, -1, 1)) <= angle + radii + 1e-9
            reach &= (own[:, None] - sims) / gap[home] <= chord + 1e-9
            reach &= np.arange(len(centres)) > home[:, None]
            yield pdf.assign(cell=home, probes=[np.flatnonzero(r).astype(np.int32) for r in reach])[["rep", "v", "mult", "cell", "probes"]]

    dealt = materialise(rows.select("rep", "v", "mult").mapInPandas(assign, f"rep bigint, v {rows.schema['v'].dataType.simpleString()}, mult bigint, cell int, probes array<int>"))
    block = min(BLOCKS[1], max(BLOCKS[0], n // 8))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, a, b = sides(pdf, "rep")
        v, mult, same = unit(sides(pdf, "v")[0].astype(float)), sides(pdf, "mult")[0].astype(float), pdf["x"].iloc[0] == pdf["y"].iloc[0]
        links, union = np.zeros(len(v)), Union(len(v))
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            near = v[some] @ v[b].T >= threshold
            if same:
                near[np.arange(len(some)), at + np.arange(len(some))] = False
            if near.any():
                i, j = np.nonzero(near)
                links[some] += near @ mult[b]
                if not same:
                    links[b] += mult[some] @ near
                union.link(some[i], b[j])
        linked = np.flatnonzero(links > 0)
        return pd.DataFrame({"rep": rep[linked], "n": links[linked].astype(np.int64), "root": rep[union.root[linked]]})

    found = None
    for cells in waves(dealt, block, max(WAVE, n * dim) // dim):
        these = f"array({', '.join(map(str, cells))})"
        some = dealt.selectExpr("rep", "v", "mult", f"if(array_contains({these}, cell), cell, NULL) AS cell", f"array_intersect(probes, {these}) AS probes").where("cell IS NOT NULL OR size(probes) > 0")
        links = materialise(block_pairs(some, "rep", block).groupBy("cell", "x", "y").applyInPandas(compare, "rep bigint, n bigint, root bigint"))
        found = links if found is None else found.union(links)
        let_go(rows.sparkSession)
    return found


def waves(dealt: DataFrame, block: int, most: int) -> list[list[int]]:
    """Cells of rows(cell, probes) in groups whose pairs of blocks hold about most rows; a cell is not split."""
    sides = dealt.select("cell", F.lit(1).alias("m"), F.lit(0).alias("p")).union(dealt.select(F.explode("probes"), F.lit(0), F.lit(1)))
    out, left = [], 0
    for r in sides.groupBy("cell").agg(F.sum("m").alias("m"), F.sum("p").alias("p")).where("m > 0").orderBy("cell").collect():  # MAX_CELLS rows at most
        members, probes = -(-r.m // block), -(-r.p // block)
        rows = r.m * (members + probes) + r.p * members
        if not out or rows > left:
            out.append([])
            left = most
        out[-1].append(r.cell)
        left -= rows
    return out
