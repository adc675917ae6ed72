"""Neighbourhood operators.  A cell's value is sent to every cell whose kernel covers it; one shuffle by cell merges them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.core import GridFrame, operator

Kernel = list[tuple[int, int, float]]


@dataclass(frozen=True)
class Structure:
    """A structuring element: its cells as (rows down, columns right, weight), and what operators do with it unless told otherwise."""

    cells: tuple
    rotate: bool = False
    background: float | None = None

    def __iter__(self):
        return iter(self.cells)

    def __len__(self):
        return len(self.cells)


def structure(kind: str = "disc", width: int = 3, height: int | None = None, custom: list | None = None, rotate: bool = False, background: float | None = None) -> Structure:
    """A structuring element.  Sizes are odd; a cell counts when the shape covers half of it or more.

    kinds: disc, box (rectangle, square) and diamond, the balls of the Euclidean, maximum and Manhattan norms, stretched
    to the sizes, and cross, the middle row and column.  A cell reaches from its near to its far corner, and the share
    of that way in the norm that lies inside is what is covered.  custom: a matrix with None outside.
    """
    if custom is not None:
        h, w = len(custom), len(custom[0])
        return Structure(tuple((i - h // 2, j - w // 2, float(v)) for i, row in enumerate(custom) for j, v in enumerate(row) if v is not None), rotate, background)
    height = height or width
    if width % 2 == 0 or height % 2 == 0 or width < 1 or height < 1:
        raise ValueError("sizes of a structuring element are odd")
    most = max(width, height)
    norms = {"disc": math.hypot, "diamond": lambda a, b: a + b} | dict.fromkeys(("box", "rectangle", "square"), max)
    if kind not in norms and kind != "cross":
        raise ValueError(f"no structuring element {kind!r}")

    def covered(i: int, j: int) -> bool:
        if kind == "cross":
            return i == 0 or j == 0
        # the corner nearest to the middle and the one farthest from it; the middle row and column are taken as lines
        corner = lambda side: norms[kind](*(most / n * (abs(d) + side * (d != 0)) for d, n in ((j, width), (i, height))))
        near, far = corner(-0.5), corner(0.5)
        return near < most / 2 and (far <= most / 2 or (most / 2 - near) / (far - near) >= 0.5)

    a, b = width // 2, height // 2
    return Structure(tuple((i, j, 1.0) for i in range(-b, b + 1) for j in range(-a, a + 1) if covered(i, j)), rotate, background)


def turned(kernel: Kernel | Structure) -> Kernel:
    """A quarter turn clockwise."""
    return [(j, -i, w) for i, j, w in kernel]


ROOK: Kernel = [(-1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0), (1, 0, 1.0)]
QUEEN: Kernel = ROOK + [(-1, -1, 1.0), (-1, 1, 1.0), (1, -1, 1.0), (1, 1, 1.0)]


def sent(g: GridFrame, rows: DataFrame, kernel: Kernel) -> DataFrame:
    """r, c, w and the other columns of rows(r, c, ..): every row at each cell whose kernel covers it."""
    hops = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in kernel])).alias("k")
    rest = [x for x in rows.columns if x not in ("r", "c")]
    out = rows.select("r", "c", *rest, hops).select((F.col("r") - F.col("k.i")).alias("r"), (F.col("c") - F.col("k.j")).alias("c"), *rest, F.col("k.w").alias("w"))
    return out.filter((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < g.meta.nrow) & (F.col("c") < g.meta.ncol))


def _blended(kind: str) -> Column:
    v, w = F.col("v"), F.col("w")
    known = {
        "identity": v, "plus": v + w, "minus": v - w, "product": v * w, "equal": F.when(v == w, 1.0).when(v.isNotNull(), 0.0),
        "lower": F.when(v > w, 0.0).otherwise(v), "greater": F.when(v < w, 0.0).otherwise(v),
    }
    if kind not in known:
        raise ValueError(f"no blend {kind!r}; there are {', '.join(known)}")
    return known[kind]


def _merged(kind: str, b: Column) -> Column:
    on = (b != 0).cast("double")
    known = {
        "min": F.min(b), "max": F.max(b), "sum": F.sum(b), "mean": F.avg(b), "median": F.median(b), "sd": F.stddev_samp(b),
        "cv": F.try_divide(F.stddev_samp(b), F.avg(b)), "all": F.min(on), "any": F.max(on), "!all": 1 - F.min(on), "!any": 1 - F.max(on),
        "sumNa": F.when(F.sum(b) != 0, F.sum(b)),
    }
    if kind not in known:
        raise ValueError(f"no merge {kind!r}; there are {', '.join(known)}")
    return known[kind].cast("double")


def stencil(g: GridFrame, layer: str, kernels: list[Kernel], blend: str, merge: str, strict: bool = False, sends: Column | None = None) -> tuple[DataFrame, str]:
    """The cells with a further column, and its name: the merged blend of each cell's neighbourhood, of several kernels the first that gives a value.

    strict: null where the kernel leaves the grid.  A match of all cells ("equal") fails on a null neighbour; every other
    merge skips nulls.  Each cell also sends its layers to itself, so that one shuffle by cell does it all.
    sends: which cells send their value at all, if not every one counts.
    """
    spot = lambda t, i, j, w: F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).cast("double").alias("w"))
    itself, hops = spot(-1, 0, 0, None), [spot(t, i, j, w) for t, kernel in enumerate(kernels) for i, j, w in kernel]
    hops = F.array(itself, *hops) if sends is None else F.when(sends, F.array(itself, *hops)).otherwise(F.array(itself))
    names = {f"_own{i}": n for i, n in enumerate(g.names)}
    out = next(x for x in (f"_merged{i}" for i in range(len(names) + 1)) if x not in g.names)
    value_of = next(a for a, n in names.items() if n == layer)
    own = F.col("k.t") == -1
    rows = g.cells.select(F.col("r").alias("r0"), F.col("c").alias("c0"), *[F.col(f"`{n}`").alias(a) for a, n in names.items()], F.explode(hops).alias("k"))
    sent_ = rows.select(
        (F.col("r0") - F.col("k.i")).alias("r"), (F.col("c0") - F.col("k.j")).alias("c"), F.col("k.t").alias("t"), F.when(~own, F.col(value_of).cast("double")).alias("v"), F.col("k.w").alias("w"),
        *[F.when(own, F.col(a)).alias(a) for a in names],
    )
    inside = (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < g.meta.nrow) & (F.col("c") < g.meta.ncol)
    blended = sent_.filter(inside).withColumn("b", _blended(blend))
    values = []
    for t, kernel in enumerate(kernels):
        mine = F.col("t") == t
        b = F.when(mine, F.col("b"))
        if blend == "equal":
            value = F.when((F.count(b) == F.count(F.when(mine, 1))) & (F.min(b) == 1), 1.0).otherwise(0.0)
            value = F.when(value != 0, value) if merge == "sumNa" else value
        else:
            value = _merged(merge, b)
        values.append((F.when(F.count(F.when(mine, 1)) == len(kernel), value) if strict else value).alias(f"_val{t}"))
    there = F.max(F.when(F.col("t") == -1, 1)).alias("_there")
    merged = blended.groupBy("r", "c").agg(there, *values, *[F.max(a).alias(a) for a in names]).filter("_there = 1")
    return merged.select("r", "c", *[F.col(a).alias(n) for a, n in names.items()], F.coalesce(*[F.col(f"_val{t}") for t in range(len(kernels))]).alias(out)), out


@operator
def morph(g: GridFrame, struct: Kernel | Structure, blend: str = "identity", merge: str = "max", rotate: bool | None = None, strict: bool = False, background: float | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Blends a kernel with each neighbourhood and merges the results; null cells stay null and then become background.

    Kernel zeros are outside unless blend is "equal".  rotate: the first of four quarter turns that gives a value; it and
    background are the structuring element's own unless given.
    """
    layer = g.pick(layer)
    rotate = getattr(struct, "rotate", False) if rotate is None else rotate
    background = getattr(struct, "background", None) if background is None else background
    turns = [[k for k in struct if blend == "equal" or k[2] != 0]]
    while rotate and len(turns) < 4 and sorted(turned(turns[-1])) not in [sorted(t) for t in turns]:
        turns.append(turned(turns[-1]))
    cells, merged = stencil(g, layer, turns, blend, merge, strict)
    v = F.when(F.col(layer).isNotNull(), F.col(merged))
    return g._changed(add or layer, cells.withColumn(add or layer, v if background is None else F.coalesce(v, F.lit(float(background)))).drop(merged))


def is_binary(g: GridFrame, layer: str) -> bool:
    """Whether the layer holds 0, 1 and null alone: known from the step that wrote it, else read."""
    v = F.col(layer)
    return layer in g.binary or bool(g.cells.agg(F.coalesce(F.min(v.isin(0, 1) | v.isNull()), F.lit(True))).first()[0])


def _gated(g: GridFrame, layer: str, add: str | None, kernel: Kernel | Structure, merge: str, gate: float, weighted: str) -> GridFrame:
    binary, kernel = is_binary(g, layer), list(kernel)
    blend = "identity" if binary or all(w == 1 for *_, w in kernel) else weighted
    v = F.col(layer)
    # a cell that meets itself keeps its value unless one of the other value is near, so that only those send theirs
    few = binary and any((i, j) == (0, 0) for i, j, _ in kernel)
    cells, merged = stencil(g, layer, [kernel], blend, merge, sends=v != gate if few else None)
    chosen = F.when((v == gate) if binary else (v != 0), F.coalesce(F.col(merged), F.lit(gate)) if few else F.col(merged)).otherwise(v)
    out = g._changed(add or layer, cells.withColumn(add or layer, chosen).drop(merged))
    return replace(out, binary=out.binary | {add or layer}) if binary else out


@operator
def dilate(g: GridFrame, struct: Kernel | Structure | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Zeros of a binary layer take the largest value of their neighbourhood; of another layer, the cells that aren't zero do."""
    return _gated(g, g.pick(layer), add, struct or structure("diamond", 3), "max", 0.0, "plus")


@operator
def erode(g: GridFrame, struct: Kernel | Structure | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Ones of a binary layer take the smallest value of their neighbourhood; the map's border doesn't erode."""
    return _gated(g, g.pick(layer), add, struct or structure("diamond", 3), "min", 1.0, "minus")


@operator
def match(g: GridFrame, struct: Kernel | Structure, rotate: bool = True, background: float | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Hit or miss: 1 where the whole kernel equals the neighbourhood, in one of its quarter turns; else background."""
    return morph(g, struct, "equal", "sumNa", rotate, True, background, layer, add)


@operator
def interpolate(g: GridFrame, struct: Kernel | Structure | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Fills and smooths: the sum of value times weight over the neighbourhood, divided by its number of values."""
    layer = g.pick(layer)
    cells, merged = stencil(g, layer, [list(struct or structure("diamond", 3))], "product", "mean")
    return g._changed(add or layer, cells.withColumn(add or layer, F.col(merged)).drop(merged))


def eight(g: GridFrame, rows: DataFrame, fill: float = 0.0) -> DataFrame:
    """rows(r, c, v, ..) with n0..n7, the neighbours' values clockwise from the north; `fill` outside and for null."""
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    got = sent(g, rows.select("r", "c", "v"), [(i, j, float(k)) for k, (i, j) in enumerate(ring)])
    wide = got.groupBy("r", "c").agg(*[F.coalesce(F.max(F.when(F.col("w") == k, F.col("v"))), F.lit(fill)).alias(f"n{k}") for k in range(8)])
    return rows.join(wide, ["r", "c"], "left").fillna(fill, [f"n{k}" for k in range(8)])


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)
