"""Measures of classes: area, perimeter, adjacency, contrast, and labels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.core import GridFrame, operator
from gridframe.operators.stencil import QUEEN, ROOK, Kernel, sent


def _gid(v):
    return F.col(v).cast("int").alias("gid")


def _whole(g: GridFrame, layer: str) -> None:
    if g.values(layer).filter("v <> floor(v)").limit(1).count():
        raise ValueError("classes have whole numbers")


@operator
def area(g: GridFrame, unit: str = "map", layer: str | None = None) -> GridFrame:
    """Cells of each class, times the cell size for unit "map"."""
    layer = g.pick(layer)
    _whole(g, layer)
    rx, ry = g.meta.res
    size = rx * ry if unit == "map" else 1.0
    return g.measured(layer, "area", g.values(layer).filter("v is not null").groupBy("v").count().select(_gid("v"), (F.col("count") * size).alias("v")))


def neighbour_pairs(g: GridFrame, layer: str, kernel: Kernel) -> DataFrame:
    """r, c, v of each cell with ov, the value of each neighbour in the grid, and w, which neighbour it is."""
    kernel = [(i, j, float(k)) for k, (i, j, _) in enumerate(kernel)]
    near = sent(g, g.values(layer).withColumnRenamed("v", "ov"), kernel)
    return near.join(g.values(layer), ["r", "c"])


@operator
def perimeter(g: GridFrame, unit: str = "map", layer: str | None = None) -> GridFrame:
    """Edges of each class with another class or null inside the map; the map's border doesn't count."""
    layer = g.pick(layer)
    _whole(g, layer)
    rx, ry = g.meta.res
    side = F.when(F.col("w").isin(1.0, 2.0), ry).otherwise(rx) if unit == "map" else F.lit(1.0)  # left and right edges run along y
    edges = neighbour_pairs(g, layer, ROOK).filter("v is not null").withColumn("e", F.when(~F.col("ov").eqNullSafe(F.col("v")), side).otherwise(0.0))
    some = g.values(layer).filter("v is not null").select("v").distinct()
    total = some.join(edges.groupBy("v").agg(F.sum("e").alias("e")), "v", "left")
    return g.measured(layer, "perimeter", total.select(_gid("v"), F.coalesce("e", F.lit(0.0)).alias("v")))


@operator
def adjacency(g: GridFrame, connect: int = 4, layer: str | None = None, name: str = "adjacency") -> GridFrame:
    """Neighbour pairs of each two classes, counted from both sides; every pair of classes has a row."""
    layer = g.pick(layer)
    _whole(g, layer)
    ids = g.values(layer).filter("v is not null").select("v").distinct()
    met = neighbour_pairs(g, layer, ROOK if connect == 4 else QUEEN).filter("v is not null and ov is not null").groupBy(F.col("v").alias("a"), F.col("ov").alias("b")).count()
    every = ids.select(F.col("v").alias("a")).crossJoin(ids.select(F.col("v").alias("b")))  # the table is dense: classes squared
    table = every.join(met, ["a", "b"], "left").select("a", "b", F.coalesce(F.col("count"), F.lit(0)).cast("double").alias("value"))
    return replace(g, pairs=g.pairs | {(layer, name): table})


@operator
def dissimilarity(g: GridFrame, contrast: dict[tuple, float], unit: str = "map", layer: str | None = None) -> GridFrame:
    """Each class's edges weighted by the contrast of the two classes, {(a, b): weight}, which has to be symmetric."""
    layer = g.pick(layer)
    _whole(g, layer)
    rx, ry = g.meta.res
    if unit == "map" and abs(rx - ry) > 1e-12:
        raise ValueError("map units need square cells")
    if any(contrast.get((b, a)) != w for (a, b), w in contrast.items()):
        raise ValueError("the contrast isn't symmetric")
    weights = g.cells.sparkSession.createDataFrame([(float(a), float(b), float(w)) for (a, b), w in contrast.items()], "v double, ov double, k double")
    met = neighbour_pairs(g, layer, ROOK).filter("v is not null and ov is not null").groupBy("v", "ov").count().join(weights, ["v", "ov"], "left")
    if met.filter("k is null and v <> ov").limit(1).count():
        raise ValueError("a pair of classes has no contrast")
    size = rx if unit == "map" else 1.0
    return g.measured(layer, "dissimilarity", met.groupBy("v").agg((F.sum(F.col("count") * F.coalesce("k", F.lit(0.0))) * size).alias("s")).select(_gid("v"), F.col("s").alias("v")))


@operator
def label(g: GridFrame, labels: dict, layer: str | None = None) -> GridFrame:
    """Names of classes; those without one are called by their number."""
    layer = g.pick(layer)
    known = g.classes.get(layer)
    if known is None:
        known = g.values(layer).filter("v is not null").select(_gid("v")).distinct()
    if len(set(labels.values())) < len(labels) or None in labels.values() or None in labels:
        raise ValueError("labels are single and not null")
    names = g.cells.sparkSession.createDataFrame([(int(k), str(v)) for k, v in labels.items()], "gid int, val string")
    if names.join(known, "gid", "left_anti").limit(1).count():
        raise ValueError("a label is of no class")
    table = known.drop("val").join(names, "gid", "left").withColumn("val", F.coalesce("val", F.col("gid").cast("string")))
    return replace(g, classes=g.classes | {layer: table})
