"""Patches and zones: connected components, holes, summaries by zone, centroids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.core import GridFrame, GridMeta, blank, operator
from gridframe.functions.arithmetic import summary
from gridframe.operators.stencil import QUEEN, ROOK, sent
from gridframe.plans.graph import components, joined
from gridframe.plans.storage import numbered, stored


#: Sides of a tile that a task labels on its own, and edges between tiles that are left to one task.
TILE, FEW_EDGES = 256, 100_000


def labelled(f: pd.DataFrame, ncol: int, connectivity: int) -> pd.DataFrame:
    """A tile's cells(r, c, v) with root: the number of the first cell of the patch that they are in, within the tile."""
    r, c = f["r"].to_numpy(), f["c"].to_numpy()
    r0, c0 = r.min(), c.min()
    shape = (r.max() - r0 + 1, c.max() - c0 + 1)
    value, cell = np.full(shape, np.nan), np.arange(shape[0] * shape[1]).reshape(shape)
    value[r - r0, c - c0] = f["v"].to_numpy(float)
    x, y = [], []
    for i, j in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else []):
        here = (slice(0, shape[0] - i), slice(max(0, -j), shape[1] - max(0, j)))
        there = (slice(i, shape[0]), slice(max(0, j), shape[1] - max(0, -j)))
        same = value[here] == value[there]
        x.append(cell[here][same])
        y.append(cell[there][same])
    root = joined(np.concatenate(x), np.concatenate(y), cell.size)[cell[r - r0, c - c0]]
    return f[["r", "c", "v"]].assign(root=(root // shape[1] + r0).astype(np.int64) * ncol + root % shape[1] + c0)


def patches(g: GridFrame, rows: DataFrame, connectivity: int) -> DataFrame:
    """r, c, root of rows(r, c, v): cells of equal value that touch have one root, the number of their first cell.

    Tiles are labelled side by side; only cells along their borders are joined, and rounds of joins run on the labels
    that meet there.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    ncol, tile = g.meta.ncol, [F.floor(F.col(x) / TILE).cast("int") for x in ("r", "c")]
    one = rows.select("r", "c", F.col("v").cast("double").alias("v"), *[t.alias(n) for t, n in zip(tile, ("ti", "tj"))])
    tiles = stored(one.groupBy("ti", "tj").applyInPandas(lambda f: labelled(f, ncol, connectivity), "r int, c int, v double, root long"), "tiles")
    below = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    hops = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in below])).alias("k")
    rim = lambda x: (F.col(x) % TILE).isin(0, TILE - 1)
    border = tiles.filter(rim("r") | rim("c"))
    over = border.select(F.col("r").alias("r0"), F.col("c").alias("c0"), "v", F.col("root").alias("u"), hops).select("r0", "c0", (F.col("r0") + F.col("k.i")).alias("r"), (F.col("c0") + F.col("k.j")).alias("c"), "v", "u")
    over = over.filter((F.floor(F.col("r0") / TILE) != F.floor(F.col("r") / TILE)) | (F.floor(F.col("c0") / TILE) != F.floor(F.col("c") / TILE)))
    edges = over.join(border.select("r", "c", "v", F.col("root").alias("w")), ["r", "c", "v"]).select("u", F.col("w").alias("v")).distinct()
    roots = components(edges, FEW_EDGES).withColumnRenamed("root", "whole")
    return tiles.join(roots, tiles["root"] == roots["node"], "left").select("r", "c", F.coalesce("whole", "root").alias("root"))


@operator
def componentise(g: GridFrame, connectivity: int = 4, background: float | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Numbers the patches of equal value from 1 in the order of their first cell by rows; 0 and null form none."""
    layer = g.pick(layer)
    found = stored(patches(g, g.values(layer).filter("v is not null and v <> 0"), connectivity), "patches")
    ids = numbered(found.select("root").distinct(), "root", "id")
    out = g.put_from(add or layer, found.join(ids, "root").select("r", "c", F.col("id").cast("double").alias("v")))
    return out if background is None else out.put(add or layer, F.coalesce(F.col(add or layer), F.lit(float(background))))


@operator
def fill(g: GridFrame, connectivity: int = 4, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Fills the holes of a binary layer: parts of its background that don't reach the edge become 1."""
    layer = g.pick(layer)
    v = g.values(layer)
    if v.filter("v not in (0, 1)").limit(1).count():
        raise ValueError("holes are filled in a layer of 0 and 1")
    found = stored(patches(g, v.filter("v is null or v = 0").select("r", "c", F.lit(0.0).alias("v")), connectivity), "holes")
    edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == g.meta.nrow - 1) | (F.col("c") == g.meta.ncol - 1)
    holes = found.groupBy("root").agg(F.max(edge).alias("open")).filter("not open")
    inside = found.join(holes, "root").select("r", "c", F.lit(1.0).alias("_in"))
    joined = g.cells.join(inside, ["r", "c"], "left")
    return g._changed(add or layer, joined.withColumn(add or layer, F.coalesce("_in", layer)).drop("_in"))._grown()


@operator
def summarise(g: GridFrame, by: str, fun: str = "mean", neighbours: bool = False, connectivity: int = 8, background: float | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """A summary of the layer over each zone of `by`, or over the cells next to it, written into the zone's cells.

    With neighbours a cell counts once for each zone cell that it touches; a zone without neighbours gets null.
    Cells outside all zones become background.
    """
    layer = g.pick(layer)
    cells = g.cells.select("r", "c", F.col(by).alias("z"), F.col(layer).cast("double").alias("v"))
    zone = (F.col("z") != 0) & F.col("z").isNotNull()
    if neighbours:
        near = sent(g, cells.select("r", "c", F.col("z").alias("oz"), "v"), ROOK if connectivity == 4 else QUEEN)
        met = near.join(cells.filter(zone).select("r", "c", "z"), ["r", "c"]).filter(~F.col("oz").eqNullSafe(F.col("z")))
        values = met.groupBy("z").agg(summary(fun, F.col("v")).alias("s"))
    else:
        values = cells.filter(zone).groupBy("z").agg(summary(fun, F.col("v")).alias("s"))
    out = cells.join(values, "z", "left").select("r", "c", F.when(zone, F.col("s")).otherwise(F.lit(background).cast("double")).alias("v"))
    return g.put_from(add or layer, out)


def _centres(g: GridFrame, layer: str) -> DataFrame:
    return g.values(layer).filter("v is not null and v <> 0").groupBy(F.col("v").alias("id")).agg(F.avg("r").alias("y"), F.avg("c").alias("x"))


def _lattice(mean, low: float, size: float, n: int):
    """The index nearest to a mean index rounded, half to even, in cells counted from the coordinate 0."""
    at = F.rint(mean + low / size) - low / size
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil(at - 0.5))).cast("int")


@operator
def centroid(g: GridFrame, background: float | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Each value at the cell of its mean position; where two meet, the larger one.

    Positions are rounded, half to even, to the lattice of cells that begins at the coordinate 0, then the nearest cell is
    taken (of two the lower index).
    """
    layer = g.pick(layer)
    m, (rx, ry) = g.meta, g.meta.res
    means = g.values(layer).filter("v is not null").groupBy(F.col("v").alias("id")).agg(F.avg("r").alias("y"), F.avg("c").alias("x"))
    at = means.select(_lattice(F.col("y"), m.ymin, ry, m.nrow).alias("r"), _lattice(F.col("x"), m.xmin, rx, m.ncol).alias("c"), "id").groupBy("r", "c").agg(F.max("id").alias("v"))
    out = g.put_from(add or layer, at)
    return out if background is None else out.put(add or layer, F.coalesce(F.col(add or layer), F.lit(float(background))))


#: Centres that the driver takes in and sends to the cells; more are found by buckets.
FEW_CENTRES = 1000


@operator
def nearest_class(g: GridFrame, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Every cell gets the class whose mean position is nearest; of equals the smallest id."""
    layer = g.pick(layer)
    centres = stored(_centres(g, layer), "centres")
    few = centres.limit(FEW_CENTRES + 1).collect()
    if len(few) < 2:
        raise ValueError("needs two classes or more")
    cells = blank(g.cells.sparkSession, g.meta)
    return g.put_from(add or layer, nearest_of_many(cells, centres, g.meta) if len(few) > FEW_CENTRES else nearest(cells, [(x["id"], x["y"], x["x"]) for x in few]))


def nearest_of_many(cells: DataFrame, centres: DataFrame, meta: GridMeta) -> DataFrame:
    """r, c, v: the id of the nearest of centres(id, y, x), like nearest(), by buckets.

    A cell meets the centres of its bucket and the eight around it; it is settled if the nearest is no farther than a
    bucket's side, else it goes on to buckets twice as large.  Of a bucket's centres each costs a row a cell, so that the
    first buckets hold a few.
    """
    size = max(1.0, 2 * (meta.ncells / max(centres.count(), 1)) ** 0.5)
    left, done = stored(cells.select("r", "c"), "cells"), None
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    while True:
        last = size >= max(meta.nrow, meta.ncol)
        bucket = lambda x, side=size: F.floor((F.col(x) + 0.5) / side)
        spread = centres.select("id", "y", "x", around).select("id", "y", "x", (bucket("y") + F.col("o.i")).alias("bi"), (bucket("x") + F.col("o.j")).alias("bj"))
        met = left.select("r", "c", bucket("r").alias("bi"), bucket("c").alias("bj")).join(spread, ["bi", "bj"])
        d = F.round(F.pow(F.col("r") - F.col("y"), 2) + F.pow(F.col("c") - F.col("x"), 2), 9)
        best = met.groupBy("r", "c").agg(F.min(F.struct(d.alias("d"), "id")).alias("b")).select("r", "c", F.col("b.d").alias("d"), F.col("b.id").alias("v"))
        best = stored(best if last else best.filter(F.col("d") <= size * size), "nearest")
        done = best.select("r", "c", "v") if done is None else done.unionByName(best.select("r", "c", "v"))
        if last:
            return done
        left = stored(left.join(best, ["r", "c"], "left_anti"), "unsettled")
        if not left.limit(1).count():
            return done
        size *= 2


def nearest(cells: DataFrame, centres: list[tuple[float, float, float]]) -> DataFrame:
    """r, c, v: the id of the nearest of centres(id, row, column) by squared distance, ties to the smallest id."""
    ids, ys, xs = (np.array(x, float) for x in zip(*sorted(centres)))

    def run(frames):
        for f in frames:
            r, c, best = f["r"].to_numpy(float), f["c"].to_numpy(float), np.full(len(f), np.inf)
            out = np.zeros(len(f))
            for i, y, x in zip(ids, ys, xs):
                d = np.round((r - y) ** 2 + (c - x) ** 2, 9)
                out[d < best] = i
                best = np.minimum(best, d)
            yield f[["r", "c"]].assign(v=out)

    return cells.select("r", "c").mapInPandas(run, "r int, c int, v double")
