"""Connected components by alternating stars, as joins and aggregates of Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbmark.llm.scratch import drop, keep

MOST_ROUNDS = 60


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that link the same nodes, fewer of them: each Arrow batch keeps one for each pair of trees that it joins."""

    def run(batches):
        for batch in batches:
            parent: dict[int, int] = {}

            def root(x):
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            used = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                used.append(x != y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            yield batch.filter(pa.array(np.array(used, bool)))

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, path: str, name: str) -> DataFrame:
    """node, component (the least node reachable) of each node in edges (a, b). Each round is written, so that lineage stays short.

    A large star links every neighbour above a node to the least neighbour, a small star those below it; the two in
    turn make each component a star around its least node, in a number of rounds that is logarithmic in its size.
    """
    own = keep(forest(edges.where("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path, f"{name}-0")
    mark = None
    for i in range(1, MOST_ROUNDS):
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        own = keep(small, path, f"{name}-{i}")
        drop(edges.sparkSession, path, f"{name}-{i - 1}")
        now = own.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    found = own.groupBy("a").agg(F.min("b").alias("component"))
    nodes = found.select(F.col("a").alias("node"), "component")
    return nodes.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
