"""Analyses composed of operators: the morphological pattern of a binary layer."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from gridframe import operators as o
from gridframe.core import GridFrame, Recipe, operator
from gridframe.plans.loop import loop

#: Codes of the classes, in the order in which they give way to one another: a later one wins.
CODES = {"branch": 7, "edge": 6, "perforation": 3, "islet": 4, "core": 1, "bridge": 5, "loop": 2}


def _numbered(g: GridFrame, layer: str, add: str) -> GridFrame:
    """The 8-connected parts of a binary layer, 0 elsewhere."""
    return o.componentise(g, 8, background=0, layer=layer, add=add)


def _outlines(g: GridFrame, width: float) -> GridFrame:
    """Layers edge and perforation: the cells around the core that lie outside its outermost border, and inside its holes.

    The core is filled and its rim is edge; then what is left of the core within the holes is filled in turn, until
    nothing is left.
    """
    g = o.mask_filter(o.distance(g, "foreground", layer="core", add="off"), f"off > 0 AND off <= {width!r}", add="near")
    g = o.fill(g.put("work", F.col("core")), 4, layer="work", add="full")
    g = o.mask_filter(o.mask_filter(g, "full = 1 AND work = 0", add="hole"), "core < 0", add="edge")
    peel = o.distance(Recipe(), "foreground", layer="full", add="out")
    peel = o.mask_filter(peel, f"edge = 1 OR (full = 0 AND out > 0 AND out <= {width!r})", add="edge")
    peel = o.mask_filter(o.fill(peel, 8, layer="hole", add="inner"), "full = 1 AND inner = 0", add="full")
    peel = o.fill(o.mask_filter(peel, "work = 1 AND full = 0", add="work"), 4, layer="work", add="full")
    g = loop(g, o.mask_filter(peel, "full = 1 AND work = 0", add="hole"), until="sum(full) = 0")
    g = o.mask_filter(g, "edge = 1 AND core = 0", add="edge")
    return o.mask_filter(g, "near = 1 AND core = 0 AND edge = 0", add="perforation")


def _connectors(g: GridFrame) -> GridFrame:
    """Layers bridge and loop: what thinning leaves of the cells beside the core, by the cores that it touches."""
    g = o.mask_filter(g, "x0 = 1 AND core = 0 AND islet = 0 AND perforation = 0 AND edge = 0", add="rest")
    g = o.mask_filter(g, "core = 1 OR near = 1 OR rest = 1", add="skin")
    g = o.mask_filter(o.skeletonise(g, 0, "core", "homotopic", layer="skin", add="thin"), "thin = 1 AND core = 0", add="thin")
    g = o.mask_filter(g, "(near = 1 AND core = 0) OR rest = 1", add="room")
    grow = o.mask_filter(o.dilate(Recipe(), o.structure("square", 3), layer="reach"), "reach = 1 AND room = 1", add="reach")
    g = loop(g.put("reach", F.col("thin")), grow, stable=True, layer="reach")
    g = _numbered(o.mask_filter(g, "thin = 1 AND room = 1 AND reach = 1", add="strand"), "strand", "strand_id")
    g = _numbered(g, "core", "core_id")
    g = o.summarise(g, "strand_id", "n_distinct", neighbours=True, background=0, layer="core_id", add="cores")
    g = o.summarise(g, "strand_id", "n", background=0, layer="strand_id", add="size")
    g = o.mask_filter(g, "strand = 1 AND cores >= 2 AND size >= 2", add="bridge")
    return o.mask_filter(g, "strand = 1 AND bridge = 0", add="loop")


@operator
def pattern_classes(g: GridFrame, size: float = 1, layer: str | None = None, add: str = "pattern") -> GridFrame:
    """Classes of a binary layer by shape: core, islet, edge, perforation, bridge, loop, branch (see CODES), 0 elsewhere.

    Core cells are farther than size times the square root of 2 from the background; islets are parts without core; edges and
    perforations run around the core, outside and in its holes; bridges connect cores, loops a core with itself; the rest are branches.
    """
    layer, width = g.pick(layer), size * math.sqrt(2)
    w = o.select(GridFrame(g.meta, g.cells.select("r", "c", F.coalesce(F.col(layer).cast("double"), F.lit(0.0)).alias("x0")), scans=g.scans), "x0")
    w = o.mask_filter(o.distance(w, "background", layer="x0", add="depth"), f"x0 = 1 AND depth > {width!r}", add="core")
    w = o.summarise(_numbered(w, "x0", "part"), "part", "any", background=0, layer="core", add="cored")
    w = _connectors(_outlines(o.mask_filter(w, "x0 = 1 AND cored = 0", add="islet"), width))
    w = o.mask_filter(w, " AND ".join(["x0 = 1", *(f"{x} = 0" for x in CODES if x != "branch")]), add="branch")
    code = reduce(lambda a, x: F.when(F.col(x) == 1, float(CODES[x])).otherwise(a), CODES, F.lit(0.0))
    return g.put_from(add, w.cells.select("r", "c", F.when(F.col("x0") == 1, code).otherwise(0.0).alias("v")))
