"""Blocks of cells, for pair searches within cells and across their borders.

Each row has a home cell and may probe higher-numbered cells (a cell pair is searched from one side only). Cells and
their probes are dealt to blocks by hash; a group is two blocks, so neither a hot cell nor a hot key makes a group
grow. Groups return counts and local components, never their pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def block_pairs(rows: DataFrame, id_column: str, block: int = BLOCK) -> DataFrame:
    """rows(cell int, probes array<int>, ...) as (cell, x, y, at, ...): each block once for each pair (x, y) of blocks of
    a cell that is to be searched, at telling which it is. A block is one row, its other columns lists of about block
    values. Block numbers of probes begin after those of members. Only the number of rows by cell reaches the driver,
    one row for each cell and side; the caller bounds the cells."""
    sides = rows.select("cell", F.lit(0).alias("side")).union(rows.select(F.explode("probes"), F.lit(1)))
    sizes = sides.groupBy("cell").agg(F.count_if(F.expr("side = 0")).alias("m"), F.count_if(F.expr("side = 1")).alias("p"))
    sizes = sizes.where("m > 0").selectExpr("cell AS c", f"int(ceil(m / {block})) AS mb", f"int(ceil(p / {block})) AS pb").collect()
    blocks = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in sizes], "c int, mb int, pb int"))
    others = [c for c in rows.columns if c not in ("cell", "probes")]
    member = rows.join(blocks, rows.cell == blocks.c).selectExpr("cell", f"int(pmod(xxhash64({id_column}, 11), mb)) AS at", "mb + pb - 1 AS last", *others)
    probe = rows.select(F.explode("probes").alias("cell"), *others)
    probe = probe.join(blocks, probe.cell == blocks.c).selectExpr("cell", f"int(mb + pmod(xxhash64({id_column}, 11), pb)) AS at", "mb - 1 AS last", *others)
    packed = member.union(probe).groupBy("cell", "at", "last").agg(*(F.collect_list(c).alias(c) for c in others))
    both = packed.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    return both.select("cell", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), "at", *others)


def sides(pdf, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column's values of a pair of blocks in one array, and where those of block x and of block y lie (the same
    places if the pair is a block with itself; none for a block that has no rows)."""
    lists = {int(at): np.array(list(values)) for at, values in zip(pdf["at"], pdf[column], strict=True)}
    x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
    n = len(lists.get(x, ()))
    if x == y:
        return lists[x], np.arange(n), np.arange(n)
    m = len(lists.get(y, ()))
    return np.concatenate([lists[k] for k in (x, y) if k in lists]), np.arange(n), np.arange(n, n + m)


class Union:
    """Least-index components under links that come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]
