"""Connected components in rounds of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.plans.storage import drop_path, new_path, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def joined(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of the nodes 0 .. n - 1, given edges (x, y): roots hook on smaller ones and paths halve."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while ((up := root[root]) != root).any():
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return root


def _small(batches):
    """All edges, in one task -> node and root."""
    import pandas as pd

    frames = [f for f in batches if len(f)]
    if frames:
        e = pd.concat(frames)
        nodes, at = np.unique(np.concatenate([e["u"], e["v"]]), return_inverse=True)
        yield pd.DataFrame({"node": nodes, "root": nodes[joined(at[: len(e)], at[len(e) :], len(nodes))]})


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """Connected components of edges(u, v): node, root, with root the smallest node of the component.

    Alternates large-star and small-star steps until the edge set is a set of stars.  Each round is stored; only two
    numbers reach the driver.  Nodes without edges don't appear.  So many edges at most are left to one task.
    """
    spark = edges.sparkSession
    now = new_path(spark, "edges")
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", now)
    if small and e.count() <= small:
        return e.coalesce(1).mapInPandas(_small, "node long, root long")
    seen = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        hops = large.join(low, "u").select(F.explode(pair).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        path = new_path(spark, "edges")
        e = stored(hops, "edges", path)
        drop_path(spark, now)
        now, was, seen = path, seen, _state(e)
        if was == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
