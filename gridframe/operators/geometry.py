"""Operators on the grid itself: cropping, padding, turning, resizing, and choosing layers."""

from __future__ import annotations

import math
import warnings
from dataclasses import replace

from pyspark.sql import functions as F

from gridframe.core import GridFrame, GridMeta, blank, operator


def _warn(g: GridFrame) -> None:
    if g.classes or g.pairs:
        warnings.warn("measures were taken on the grid as it was before", stacklevel=3)


@operator
def crop(g: GridFrame, extent: tuple) -> GridFrame:
    """Cuts to an extent (xmin, xmax, ymin, ymax), widened to whole cells."""
    m, (rx, ry) = g.meta, g.meta.res
    c0, c1 = max(0, math.floor((extent[0] - m.xmin) / rx + 1e-9)), min(m.ncol, math.ceil((extent[1] - m.xmin) / rx - 1e-9))
    r0, r1 = max(0, math.floor((m.ymax - extent[3]) / ry + 1e-9)), min(m.nrow, math.ceil((m.ymax - extent[2]) / ry - 1e-9))
    if c0 >= c1 or r0 >= r1:
        raise ValueError("the extent lies outside the grid")
    _warn(g)
    meta = GridMeta(m.xmin + c0 * rx, m.xmin + c1 * rx, m.ymax - r1 * ry, m.ymax - r0 * ry, c1 - c0, r1 - r0, m.crs)
    inside = F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)
    return replace(g, meta=meta, cells=g.cells.filter(inside).withColumn("r", F.col("r") - r0).withColumn("c", F.col("c") - c0))


@operator
def pad(g: GridFrame, width: int, sides: str = "all", value: float | None = None) -> GridFrame:
    """Adds (or, if negative, takes) cells at all sides or those named ("left top ..")."""
    if width == 0:
        return g
    at = {s: width if sides == "all" or s in sides.split() else 0 for s in ("left", "right", "top", "bottom")}
    m, (rx, ry) = g.meta, g.meta.res
    ncol, nrow = m.ncol + at["left"] + at["right"], m.nrow + at["top"] + at["bottom"]
    if ncol < 1 or nrow < 1:
        raise ValueError("nothing would be left")
    _warn(g)
    meta = GridMeta(m.xmin - at["left"] * rx, m.xmax + at["right"] * rx, m.ymin - at["bottom"] * ry, m.ymax + at["top"] * ry, ncol, nrow, m.crs)
    old = g.cells.withColumn("r", F.col("r") + at["top"]).withColumn("c", F.col("c") + at["left"])
    if width < 0:
        return replace(g, meta=meta, cells=old.filter((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < nrow) & (F.col("c") < ncol)))
    joined = blank(g.cells.sparkSession, meta).join(old.withColumn("_old", F.lit(True)), ["r", "c"], "left")
    return replace(g, meta=meta, cells=joined.select("r", "c", *[F.when(F.col("_old"), F.col(n)).otherwise(F.lit(value).cast("double")).alias(n) for n in g.names]))


def _turned(g: GridFrame, r, c, swap: bool) -> GridFrame:
    m = g.meta
    if swap:
        x, y, a, b = (m.xmin + m.xmax) / 2, (m.ymin + m.ymax) / 2, (m.xmax - m.xmin) / 2, (m.ymax - m.ymin) / 2
        m = GridMeta(x - b, x + b, y - a, y + a, m.nrow, m.ncol, m.crs)
    return replace(g, meta=m, globals={}, cells=g.cells.select(r.alias("r"), c.alias("c"), *g.names))


@operator
def rotate(g: GridFrame, angle: int = 90) -> GridFrame:
    """Turns all layers clockwise by 90, 180 or 270 degrees about the middle; whole-layer values go."""
    r, c, m = F.col("r"), F.col("c"), g.meta
    if angle not in (90, 180, 270):
        raise ValueError("angle is 90, 180 or 270")
    to = {90: (c, m.nrow - 1 - r), 180: (m.nrow - 1 - r, m.ncol - 1 - c), 270: (m.ncol - 1 - c, r)}[angle]
    return _turned(g, *to, angle != 180)


@operator
def transpose(g: GridFrame) -> GridFrame:
    """Swaps rows and columns."""
    return _turned(g, F.col("c"), F.col("r"), True)


@operator
def resize(g: GridFrame, factor: float) -> GridFrame:
    """Changes the number of cells; a new cell takes the old cell at its index divided by the factor."""
    m = g.meta
    ncol, nrow = int(m.ncol * factor), int(m.nrow * factor)
    if ncol < 1 or nrow < 1:
        raise ValueError("nothing would be left")
    _warn(g)
    meta = replace(m, ncol=ncol, nrow=nrow)
    new = blank(g.cells.sparkSession, meta).select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c"))
    return replace(g, meta=meta, cells=new.join(g.cells, ["r", "c"], "left").select(F.col("nr").alias("r"), F.col("nc").alias("c"), *g.names))


def _only(g: GridFrame, names: list[str]) -> GridFrame:
    return replace(
        g, cells=g.cells.select("r", "c", *names), classes={k: v for k, v in g.classes.items() if k in names},
        pairs={k: v for k, v in g.pairs.items() if k[0] in names}, globals={k: v for k, v in g.globals.items() if k in names},
    )


@operator
def select(g: GridFrame, *names: str) -> GridFrame:
    """Keeps layers; unknown names are passed over unless none is left."""
    kept = [n for n in names if n in g.names]
    if not kept:
        raise ValueError("no such layers")
    return _only(g, kept)


@operator
def remove(g: GridFrame, *names: str) -> GridFrame:
    """Drops layers."""
    kept = [n for n in g.names if n not in names]
    if not kept:
        raise ValueError("no layer would be left")
    return _only(g, kept)


@operator
def add_layers(g: GridFrame, other: GridFrame, *names: str, rename: dict | None = None) -> GridFrame:
    """Takes over layers of a grid of the same extent, size and reference system, with what was measured on them."""
    a, b = g.meta, other.meta
    if (a.ncol, a.nrow, a.crs) != (b.ncol, b.nrow, b.crs) or any(abs(x - y) > 1e-8 * max(1, abs(x)) for x, y in ((a.xmin, b.xmin), (a.xmax, b.xmax), (a.ymin, b.ymin), (a.ymax, b.ymax))):
        raise ValueError("the grids differ")
    to = {n: (rename or {}).get(n, n) for n in (names or other.names)}
    if clash := [x for x in to.values() if x in g.names]:
        raise ValueError(f"there already are layers {clash}")
    rows = other.cells.select("r", "c", *[F.col(n).alias(t) for n, t in to.items()])
    return replace(
        g, cells=g.cells.join(rows, ["r", "c"]), classes=g.classes | {to[k]: v for k, v in other.classes.items() if k in to},
        pairs=g.pairs | {(to[k], n): v for (k, n), v in other.pairs.items() if k in to}, globals=g.globals | {to[k]: v for k, v in other.globals.items() if k in to}, history=g.history + other.history,
    )
