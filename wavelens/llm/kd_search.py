"""Exact top-k by inner product: a KD-tree per shard, searched best box first.

Rows are dealt to shards by their id; each (shard, block of queries) is one group. A tree splits at medians of the
widest dimension and keeps tight bounding boxes; a box bounds the product with a query from above. Queries first
search the shard they live in; the k-th result found there is propagated, so other shards skip all boxes below it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF = 64


class Tree:
    """Vectors (rows of v, with ids) under nodes; node i's children are 2i + 1 and 2i + 2 in a dict-like layout."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order]
        self.rows, self.kids, low, high, first = [], [], [], [], []
        stack = [(np.arange(len(ids)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            at = len(self.rows)
            if parent >= 0:
                self.kids[parent][side] = at
            lo, hi = self.v[rows].min(0), self.v[rows].max(0)
            low.append(lo), high.append(hi), first.append(int(self.ids[rows[0]]))
            self.kids.append([-1, -1])
            self.rows.append(rows)
            d = int(np.argmax(hi - lo))
            if len(rows) > LEAF and hi[d] > lo[d]:
                x = self.v[rows, d]
                left = x <= np.partition(x, len(x) // 2)[len(x) // 2]
                if left.all():
                    left = x < hi[d]
                stack += [(rows[left], at, 0), (rows[~left], at, 1)]
                self.rows[at] = None
        self.low, self.high, self.first = np.array(low), np.array(high), first

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node, the largest product that its box allows."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, -id), ties to smaller ids, without the query's own id; only scores of floor or more."""
        best: list[tuple[float, int]] = []
        worst = (floor, -float("inf"))
        queue = [(-bound[0], self.first[0], 0)]
        while queue:
            b, first, node = heapq.heappop(queue)
            if (-b, -first) < worst:
                if -b < worst[0]:
                    break  # all other boxes are bounded by less
                continue  # a tie that no smaller id can win here
            left, right = self.kids[node]
            if left >= 0:
                for kid in (left, right):
                    if (bound[kid], -self.first[kid]) >= worst:
                        heapq.heappush(queue, (-bound[kid], self.first[kid], kid))
                continue
            rows = self.rows[node]
            score = self.v[rows] @ query
            for i in np.flatnonzero(score >= worst[0]):
                entry = (float(score[i]), -int(self.ids[rows[i]]))
                if -entry[1] != own and entry > worst:
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    else:
                        heapq.heapreplace(best, entry)
                    if len(best) == k:
                        worst = max(worst, best[0])
        return best


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, q array<double>): floor(scale * x) of each component; rows that take part only."""
    x = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    whole = "x IS NOT NULL AND vec_id IS NOT NULL AND size(x) > 0 AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
    return x.where(whole).select("vec_id", F.expr(f"transform(x, c -> double(floor({scale} * c)))").alias("q"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """For each row whose id is divisible by every, the k other rows of highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Vectors that are null or empty, hold
    null or non-finite components, or have a null id take no part. Rows that repeat an id are candidates each, but not of
    their own id; of query rows that repeat one the least vector asks. Extra columns are ignored.
    Vectors are compared only with those of their own length. Products are exact while components stay under 2**23 in
    magnitude. An empty table gives no rows. Rows cross the network once for each block of queries, queries once for
    each shard; the largest group is a shard and a block.
    """
    rows = quantised(vectors, id_column, vector_column, scale)
    n, queries = rows.agg(F.count("*"), F.count_if(F.expr(f"vec_id % {every} = 0"))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-queries // block_queries))
    rows = rows.withColumn("dim", F.size("q")).withColumn("home", F.expr(f"pmod(xxhash64(vec_id), {shards})"))
    asked = rows.where(f"vec_id % {every} = 0").withColumn("block", F.expr(f"pmod(xxhash64(vec_id, 7), {blocks})"))

    def search(first_round: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("vec_id", kind="stable")
            data, ask = group[~group.asks], group[group.asks]
            if not len(data) or not len(ask):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            if ask.vec_id.duplicated().any():
                ask = ask.assign(t=ask.q.map(tuple)).sort_values(["vec_id", "t"]).drop_duplicates("vec_id")
            tree = Tree(data.vec_id.to_numpy(), np.array(data.q.tolist()))
            ids, q, floor = ask.vec_id.to_numpy(), np.array(ask.q.tolist()), ask.floor.to_numpy()
            out = []
            for at in range(0, len(q), 512):
                bound = tree.bounds(q[at : at + 512])
                for i in range(at, min(at + 512, len(q))):
                    out += [(int(ids[i]), -v, s) for s, v in tree.search(q[i], int(ids[i]), bound[i - at], k, floor[i])]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        return run

    kind = "query_id bigint, vec_id bigint, score bigint"
    data = rows.select("dim", F.col("home").alias("shard"), F.expr(f"explode(sequence(0L, {blocks - 1}L))").alias("block"), "vec_id", "q", F.lit(float("-inf")).alias("floor"), F.lit(False).alias("asks"))
    at_home = asked.select("dim", F.col("home").alias("shard"), "block", "vec_id", "q", F.lit(float("-inf")).alias("floor"), F.lit(True).alias("asks"))
    first = data.unionByName(at_home).groupBy("dim", "shard", "block").applyInPandas(search(True), kind)
    if shards == 1:
        found = first
    else:
        first = materialise(first)  # k rows for each query
        reached = first.groupBy("query_id").agg(F.min("score").cast("double").alias("s"), F.count("*").alias("n"))
        floors = reached.select("query_id", F.expr(f"if(n >= {k}, s, double('-infinity'))").alias("floor"))
        away = asked.join(floors, asked.vec_id == floors.query_id, "left").withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)"))).where("shard <> home")
        away = away.select("dim", "shard", "block", "vec_id", "q", F.expr("coalesce(floor, double('-infinity'))").alias("floor"), F.lit(True).alias("asks"))
        found = first.unionByName(data.unionByName(away).groupBy("dim", "shard", "block").applyInPandas(search(False), kind))
    ranked = found.select("query_id", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)").alias("rank"), "vec_id", "score")
    return ranked.where(f"rank <= {k}")
