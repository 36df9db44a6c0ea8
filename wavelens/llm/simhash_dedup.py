"""Near-duplicate documents by SimHash, pairs found exactly with vantage-point trees.

Fingerprints are dealt to shards, the leaves of a vantage-point tree whose vantage points and radii come from a
bounded sample. A fingerprint also visits each shard that the triangle inequality cannot exclude, so every pair
within the radius meets. Within a group of blocks another tree prunes the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, row_key
from .pairing import Union, block_pairs, sides

SHARD = 65_536
MAX_SHARDS = 1024
SAMPLE = 20_000
LEAF = 128
BLOCK = 8192


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half the XXH64 hashes of the lower-cased text's shingles."""
    parts = text.encode("utf-8", "replace").lower().split()  # A-Z, and white space x20, x09 to x0D: of bytes
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[words - 1 :].tolist() if len(parts) >= words else [len(joined)]
    digest, hashes = xxhash.xxh64_intdigest, np.empty(n, "<u8")
    hashes[:] = [digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        total += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(key, doc_id, fp): the fingerprint of each whole text as a signed long, and the key of the row's doc_id and text; a
    null text counts as empty. A text is one task's work, whatever its length."""

    def run(batches):
        for batch in batches:
            keys, ids, texts = batch.columns
            fp = np.array([fingerprint(t.as_py() or "", words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array(fp)], ["key", "doc_id", "fp"])

    return docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "key binary, doc_id bigint, fp bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Median splits of fingerprints by distance to a vantage point: within the radius to the left, beyond to the right.

    Leaves are numbered; a side that no split can reduce becomes a leaf whatever its size."""

    def __init__(self, points: np.ndarray, leaf: int, depth: int = 60, seed: int = 1):
        self.nodes, self.leaves = [], []
        rng = np.random.default_rng(seed)

        def grow(rows: np.ndarray, depth: int) -> int:
            if len(rows) > leaf and depth:
                for _ in range(3):
                    vantage = points[rows[rng.integers(len(rows))]]
                    d = distance(points[rows], vantage)
                    radius = int(np.partition(d, len(d) // 2)[len(d) // 2])
                    inside = d <= radius
                    if inside.all():
                        radius -= 1
                        inside = d <= radius
                    if inside.any():
                        at = len(self.nodes)
                        self.nodes.append(None)
                        self.nodes[at] = (vantage, radius, grow(rows[inside], depth - 1), grow(rows[~inside], depth - 1))
                        return at
            self.leaves.append(rows)
            return -len(self.leaves)

        self.root = grow(np.arange(len(points)), depth)

    def visit(self, queries: np.ndarray, reach: int):
        """(leaf, rows of queries) for all leaves that may hold a point within reach; reach 0 gives each its own leaf."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                yield -node - 1, rows
                continue
            vantage, radius, left, right = self.nodes[node]
            d = distance(queries[rows], vantage).astype(np.int16)
            for kid, some in ((left, rows[d - reach <= radius]), (right, rows[d + reach > radius])):
                if len(some):
                    stack.append((kid, some))


def groups(docs: DataFrame, radius: int, words: int, seed: int, shard: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, fp) of all rows; and (fp, part): a fingerprint of each one's component."""
    marked = materialise(fingerprints(docs, words, seed))
    distinct = marked.select("fp").distinct()
    edges = materialise(links(distinct, radius, shard, sample))
    parts = connected_components(edges).withColumnRenamed("id", "fp")
    return marked, distinct.join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("part"))


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Groups of documents whose fingerprints are linked by chains of at most radius differing bits.

    Returns a row per input row: doc_id, fp (long), component_id (least doc_id reachable, itself included). A null
    text counts as empty; texts without words have fingerprint zero and link like any other. Rows with a null doc_id
    link too; their component is the least id known, null if there is none. Rows that repeat an id are rows of their
    own. Extra columns are ignored; an empty table gives no rows.
    """
    marked, parts = groups(docs, radius, words, seed, shard, sample)
    grouped = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(parts, "fp")
    ids = grouped.groupBy("part").agg(F.min("least").alias("component_id"))
    known = grouped.join(ids, "part").select("fp", "component_id")
    return marked.join(known, "fp").select("doc_id", "fp", "component_id")


def links(distinct: DataFrame, radius: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that connect all pairs of distinct fingerprints (fp) within radius: a forest for each group of blocks."""
    n = distinct.count()
    some = distinct.where(f"pmod(xxhash64(fp), {max(1, -(-n // sample))}) = 0").toPandas().fp.to_numpy(np.int64)  # about sample rows
    shards = max(1, min(MAX_SHARDS, n // shard))
    top = VantageTree(some.view(np.uint64), max(1, -(-len(some) // shards)), depth=int(np.ceil(np.log2(shards))))

    def assign(batches):
        for pdf in batches:
            fp = pdf.fp.to_numpy(np.int64).view(np.uint64)
            home = np.zeros(len(fp), np.int32)
            for leaf, rows in top.visit(fp, 0):
                home[rows] = leaf
            probes = [[] for _ in fp]
            for leaf, rows in top.visit(fp, radius):
                for i in rows[home[rows] < leaf]:
                    probes[i].append(leaf)
            yield pd.DataFrame({"fp": pdf.fp, "cell": home, "probes": probes})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, a, b = sides(pdf, "fp")
        bits = fp.view(np.uint64)
        union = Union(len(fp))
        if len(a) and len(b):
            tree = VantageTree(bits[a], LEAF)
            for leaf, rows in tree.visit(bits[b], radius):
                inside = a[tree.leaves[leaf]]
                for at in range(0, len(rows), 2048):
                    others = b[rows[at : at + 2048]]
                    i, j = np.nonzero(distance(bits[others][:, None], bits[inside][None, :]) <= radius)
                    union.link(others[i], inside[j])
        linked = np.flatnonzero(union.root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[linked], "b": fp[union.root[linked]]})

    dealt = distinct.mapInPandas(assign, "fp bigint, cell int, probes array<int>")
    return block_pairs(dealt, "fp", BLOCK).groupBy("cell", "x", "y").applyInPandas(search, "a bigint, b bigint")


def one_of_each(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """docs with one document of each near-duplicate group: that with the least (doc_id, content), null ids last.

    A document is a doc_id with its text: rows equal in both stay or go together, rows that share an id only are told apart.
    Null and empty texts have fingerprint zero, so one of them stays. All columns of docs come back; an empty table stays
    empty. A text of any length is read where it lies."""
    marked, parts = groups(docs, radius, words, seed, shard, sample)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    firsts = marked.groupBy("fp").agg(F.min(place).alias("first")).join(parts, "fp")
    stays = firsts.groupBy("part").agg(F.min("first").alias("stay"))
    stay = firsts.join(stays, "part").select("fp", F.col("stay.key").alias("stay"))
    drop = marked.join(stay, "fp").where("key <> stay").select(F.col("key").alias("__wl_drop")).distinct()
    return docs.join(drop, row_key("doc_id", "text") == F.col("__wl_drop"), "left_anti")
