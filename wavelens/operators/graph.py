"""Reachability over an edge table by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialise


def reach(edges: DataFrame, roots: DataFrame, directed: bool = True, most: int | None = None) -> DataFrame:
    """(root, node, hops): least number of edges (a, b) from each root to each node it reaches, itself included.

    Each round joins only the newest nodes with the edges and drops those already seen, until there are no new ones.
    Rounds are written tables, so lineage stays short. With most, it raises if that many rounds do not suffice."""
    if not directed:
        edges = edges.union(edges.select("b", "a"))
    edges = materialise(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    new = materialise(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct())
    found, hops = [new], 0
    while True:
        hops += 1
        if most is not None and hops > most + 1:
            raise RuntimeError(f"nodes lie farther than {most} edges away")
        seen = found[0]
        for part in found[1:]:
            seen = seen.union(part)
        step = new.join(edges, new.node == edges.a).select("root", F.col("b").alias("node")).distinct()
        new = materialise(step.join(seen, ["root", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if new.isEmpty():
            return seen
        found.append(new)
        if len(found) > 8:  # the union is one table again
            found = [materialise(seen.union(new))]
