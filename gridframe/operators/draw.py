"""Generators: noise, textures, gradients, patterns, clusters and tessellations as column expressions where they can be."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.core import GridFrame, operator
from gridframe.functions.random import normal, uniform
from gridframe.operators.stencil import ROOK, sent
from gridframe.operators.zonal import nearest, patches
from gridframe.plans.storage import numbered, stored


def _unit(g: GridFrame, name: str, constant: float) -> GridFrame:
    low, high = g.cells.agg(F.min(name), F.max(name)).first()
    return g.put(name, F.lit(constant) if low == high else (F.col(name) - low) / (high - low))


def _lattice(seed: int, x: Column, y: Column) -> Column:
    """Gradient noise: at the corners of a unit square random directions, between them a smooth blend."""
    i, j = F.floor(x), F.floor(y)
    u, v = x - i, y - j
    fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)

    def corner(a: int, b: int) -> Column:
        angle = 2 * math.pi * uniform(seed, i + a, j + b)
        return F.cos(angle) * (u - a) + F.sin(angle) * (v - b)

    top = corner(0, 0) + fade(u) * (corner(1, 0) - corner(0, 0))
    low = corner(0, 1) + fade(u) * (corner(1, 1) - corner(0, 1))
    return top + fade(v) * (low - top)


def _simplex(seed: int, x: Column, y: Column) -> Column:
    """The same on a lattice of triangles: three corners, each with a fading weight."""
    skew, back = (math.sqrt(3) - 1) / 2, (3 - math.sqrt(3)) / 6
    i, j = F.floor(x + (x + y) * skew), F.floor(y + (x + y) * skew)
    x0, y0 = x - i + (i + j) * back, y - j + (i + j) * back
    a = F.when(x0 > y0, 1).otherwise(0)
    total = F.lit(0.0)
    for da, db in ((F.lit(0), F.lit(0)), (a, 1 - a), (F.lit(1), F.lit(1))):
        dx, dy = x0 - da + (da + db) * back, y0 - db + (da + db) * back
        angle = 2 * math.pi * uniform(seed, i + da, j + db)
        w = F.greatest(F.lit(0.0), 0.5 - dx * dx - dy * dy)
        total = total + F.pow(w, 4) * (F.cos(angle) * dx + F.sin(angle) * dy)
    return 70 * total


def _field(kind: str, seed: int, g: GridFrame, frequency: float) -> Column:
    if kind == "white":
        return uniform(seed, F.col("r"), F.col("c"))
    ox, oy = (random_offset(seed, k) for k in (1, 2))
    x, y = F.col("c") / g.meta.ncol * frequency + ox, F.col("r") / g.meta.nrow * frequency + oy
    return {"perlin": _lattice, "simplex": _simplex}[kind](seed, x, y)


def random_offset(seed: int, k: int) -> float:
    return float(np.random.default_rng([seed, k]).random() * 1000)


@operator
def noise(g: GridFrame, kind: str = "white", frequency: float = 4, name: str = "noise", seed: int = 1) -> GridFrame:
    """White, perlin or simplex noise in [0, 1]."""
    out = g.put(name, _field(kind, seed, g, frequency))
    return out if kind == "white" else _unit(out, name, 0.5)


@operator
def texture(g: GridFrame, kind: str = "fbm", base: str = "perlin", hurst: float = 0.7, octaves: int = 6, lacunarity: float = 2, frequency: float = 4, start_dev: float = 1, name: str = "texture", seed: int = 1) -> GridFrame:
    """Octaves of noise (fbm; billow of absolute values; ridged of 1 minus those), or midpoint displacement (diamondSquare)."""
    if kind == "diamondSquare":
        return _unit(g.put_from(name, displaced(g, hurst, start_dev, seed)), name, 0.5)
    total, amp = F.lit(0.0), 1.0
    for k in range(octaves):
        v = _field(base, seed * 1000 + k, g, frequency * lacunarity**k)
        total = total + amp * {"fbm": v, "billow": F.abs(v), "ridged": 1 - F.abs(v)}[kind]
        amp *= 2.0**-hurst
    return _unit(g.put(name, total), name, 0.5)


def displaced(g: GridFrame, hurst: float, dev: float, seed: int) -> DataFrame:
    """r, c, v by midpoint displacement: from the corners of a square of 2^k cells that covers the grid, step by step to single cells.

    A point halfway between known ones takes their mean and a random part that shrinks with each step; it depends on
    seed, step and place alone.  Only points are kept that a cell of the grid goes back to, and each step is one table.
    """
    rows, cols = g.meta.nrow, g.meta.ncol
    step = 1 << max(1, (max(rows, cols) - 2).bit_length())
    side, spark = step, g.cells.sparkSession
    corners = spark.createDataFrame([(r, c) for r in (0, side) for c in (0, side)], "r int, c int")
    known = corners.select("r", "c", (dev * normal(seed, F.lit(0), F.col("r"), F.col("c"))).alias("v"))
    rounds = 0
    while step > 1:
        half, rounds = step // 2, rounds + 1
        for k, ways in enumerate(([(-half, -half), (-half, half), (half, -half), (half, half)], [(-half, 0), (half, 0), (0, -half), (0, half)])):
            hops = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for w, (i, j) in enumerate(ways)])).alias("k")
            sent_ = known.select("r", "c", "v", hops).select((F.col("r") + F.col("k.i")).alias("r"), (F.col("c") + F.col("k.j")).alias("c"), "v", "k.w")
            inside = F.col("r").between(0, min(side, rows - 1 + step)) & F.col("c").between(0, min(side, cols - 1 + step))
            between = (F.col("r") % step != 0) & (F.col("c") % step != 0) if k == 0 else (F.col("r") % step != 0) != (F.col("c") % step != 0)
            # added up in one order, so that the sum doesn't depend on the order in which rows come
            sides = [F.max(F.when(F.col("w") == w, F.col("v"))) for w in range(4)]
            total = sum((F.coalesce(x, F.lit(0.0)) for x in sides[1:]), F.coalesce(sides[0], F.lit(0.0)))
            mean = sent_.filter(inside & between).groupBy("r", "c").agg((total / F.count("v")).alias("v"))
            new = mean.select("r", "c", (F.col("v") + dev * normal(seed, F.lit(2 * rounds + k), F.col("r"), F.col("c"))).alias("v"))
            known = known.unionByName(new)
        known = stored(known, "displaced")
        step, dev = half, dev * 0.5**hurst
    return known.filter((F.col("r") < rows) & (F.col("c") < cols))


@operator
def gradient(g: GridFrame, kind: str = "planar", angle: float = 0, position: tuple | None = None, size: float = 0, origin: str | None = None, invert: bool = False, name: str = "gradient") -> GridFrame:
    """A ramp in [0, 1]: planar at an angle, or distance from a point, a line, a circle, a square or a binary layer (origin).

    Rows count from the bottom here; position is (column, row), the middle by default.
    """
    m = g.meta
    x, y = F.col("c").cast("double"), (m.nrow - 1 - F.col("r")).cast("double")
    px, py = position or ((m.ncol - 1) / 2, (m.nrow - 1) / 2)
    a = math.radians(angle)
    if origin is not None:
        from gridframe.operators.distance import to_sources

        out = g.put_from(name, to_sources(g, g.values(origin).filter("v = 1"), "euclidean"))
    else:
        away = F.sqrt((x - px) * (x - px) + (y - py) * (y - py))
        known = {
            "planar": x * math.cos(a) + y * math.sin(a), "point": away, "line": F.abs(-(x - px) * math.sin(a) + (y - py) * math.cos(a)),
            "circle": F.abs(away - size), "square": F.abs(F.greatest(F.abs(x - px), F.abs(y - py)) - size),
        }
        if kind not in known:
            raise ValueError(f"no gradient {kind!r}")
        out = g.put(name, known[kind])
    out = _unit(out, name, 0.0)
    return out.put(name, 1 - F.col(name)) if invert else out


@operator
def pattern(g: GridFrame, kind: str = "checkerboard", frequency: float = 4, n: int | None = None, angle: float = 0, name: str = "pattern") -> GridFrame:
    """checkerboard, stripes, rings, waves, grid or hexagonal tiles; n classes, 0 for a number for each tile."""
    m, a = g.meta, math.radians(angle)
    x, y = F.col("c") / m.ncol * frequency, F.col("r") / m.nrow * frequency
    i, j = F.floor(x), F.floor(y)
    across = (x - frequency / 2) * math.cos(a) + (y - frequency / 2) * math.sin(a)
    around = F.sqrt(F.pow(x - frequency / 2, 2) + F.pow(y - frequency / 2, 2))
    if kind == "checkerboard":
        k = 2 if n is None else n
        return g.put(name, ((i + j) % k + 1 if k else j * math.ceil(frequency) + i + 1).cast("double"))
    if kind == "stripes":
        k = 2 if n is None else n
        v = F.floor(across + frequency)
        return g.put(name, (F.pmod(v, F.lit(k)) + 1 if k else v + 1).cast("double"))
    if kind == "rings":
        k = 2 if n is None else n
        v = F.floor(2 * around)
        return g.put(name, (F.pmod(v, F.lit(k)) + 1 if k else v + 1).cast("double"))
    if kind == "waves":
        return g.put(name, (F.sin(2 * math.pi * across) + 1) / 2)
    if kind == "grid":
        return g.put(name, F.when((F.floor(x) != F.floor((F.col("c") - 1) / m.ncol * frequency)) | (F.floor(y) != F.floor((F.col("r") - 1) / m.nrow * frequency)), 1.0).otherwise(0.0))
    if kind != "hexagonal":
        raise ValueError(f"no pattern {kind!r}")
    # nearest hexagon centre: axial coordinates, rounded half to even where the cube sum allows
    q, s = (math.sqrt(3) / 3 * x - y / 3) * 2, 2 * y * 2 / 3
    t = -q - s
    rq, rs, rt = F.rint(q), F.rint(s), F.rint(t)
    dq, ds, dt = F.abs(rq - q), F.abs(rs - s), F.abs(rt - t)
    hq = F.when((dq > ds) & (dq > dt), -rs - rt).otherwise(rq)
    hs = F.when((dq > ds) & (dq > dt), rs).when(ds > dt, -rq - rt).otherwise(rs)
    k = 3 if n is None else n
    if k:
        return g.put(name, F.pmod(hq.cast("long") - hs.cast("long"), F.lit(k)).cast("double") + 1)
    keyed = g.cells.select("r", "c", hq.alias("q"), hs.alias("s"))
    first = keyed.groupBy("q", "s").agg(F.min(F.col("r").cast("long") * m.ncol + F.col("c")).alias("first"))
    ids = numbered(first, "first", "v")
    return g.put_from(name, keyed.join(ids, ["q", "s"]).select("r", "c", F.col("v").cast("double").alias("v")))


@operator
def cluster(g: GridFrame, kind: str = "percolation", p: float = 0.5, n: int = 3, name: str = "cluster", seed: int = 1) -> GridFrame:
    """percolation: 1 with probability p.  randomCluster: its patches get random classes, gaps fill from labelled neighbours round by round."""
    on = g.put(name, F.when(uniform(seed, F.col("r"), F.col("c")) < p, 1.0).otherwise(0.0))
    if kind == "percolation":
        return on
    if kind != "randomCluster":
        raise ValueError(f"no cluster {kind!r}")
    found = patches(on, on.values(name).filter("v = 1"), 4)
    known = stored(found.select("r", "c", (F.floor(uniform(seed + 1, F.col("root")) * n) + 1).cast("double").alias("v"), F.lit(0).alias("since")), "clusters")
    total, rounds = known.count(), 0
    while 0 < total < g.meta.ncells:
        rounds += 1
        # only cells labelled in the last round lie beside gaps; one shuffle by cell merges what they send with the cells that are known
        luck = uniform(seed + 2, F.lit(rounds), F.col("r"), F.col("c"), F.col("v"))
        none = F.lit(None)
        near = sent(g, known.filter(F.col("since") == rounds - 1).select("r", "c", "v"), ROOK).select("r", "c", "v", none.cast("double").alias("own"), none.cast("int").alias("since"))
        both = near.unionByName(known.select("r", "c", none.cast("double").alias("v"), F.col("v").alias("own"), "since"))
        merged = both.groupBy("r", "c").agg(F.max("own").alias("own"), F.max("since").alias("since"), F.min_by("v", F.when(F.col("v").isNotNull(), luck)).alias("v"))
        known = stored(merged.select("r", "c", F.coalesce("own", "v").alias("v"), F.coalesce("since", F.lit(rounds)).alias("since")), "clusters")
        total = known.count()
    return on.put_from(name, known)


def dropped(g: GridFrame, size: tuple, seed: int) -> DataFrame:
    """r, c, k: the last of the rectangles that lie on a cell, dropped one after the other until all cells are covered.

    A rectangle's sides and place depend on seed and number alone, so that any number of them can be looked at at once:
    enough for each cell to be covered.  The last one needed is the largest of the cells' first ones.
    """
    m = g.meta
    low, high = (int(x) for x in size)
    number, bucket = F.col("id"), 4 * high
    pick = lambda salt, n: F.floor(uniform(seed, F.lit(salt), number) * n).cast("int")
    many = math.ceil((m.nrow + high) * (m.ncol + high) / ((low + high) / 2) ** 2 * (math.log(m.ncells + 1) + 3))
    while True:
        sides = g.cells.sparkSession.range(many).select("id", (low + pick(1, high - low + 1)).alias("h"), (low + pick(2, high - low + 1)).alias("w"))
        rects = sides.select("id", "h", "w", (1 - F.col("h") + pick(3, m.nrow - 1 + F.col("h"))).alias("y"), (1 - F.col("w") + pick(4, m.ncol - 1 + F.col("w"))).alias("x"))
        over = lambda at, length: F.explode(F.sequence(F.floor(F.col(at) / bucket), F.floor((F.col(at) + F.col(length) - 1) / bucket)))
        placed = rects.withColumn("bi", over("y", "h")).withColumn("bj", over("x", "w"))
        cells = g.cells.select("r", "c", F.floor(F.col("r") / bucket).alias("bi"), F.floor(F.col("c") / bucket).alias("bj"))
        on = F.col("r").between(F.col("y"), F.col("y") + F.col("h") - 1) & F.col("c").between(F.col("x"), F.col("x") + F.col("w") - 1)
        met = stored(cells.join(placed, ["bi", "bj"]).filter(on).select("r", "c", "id"), "drops")
        first = met.groupBy("r", "c").agg(F.min("id").alias("first")).agg(F.count(F.lit(1)), F.max("first")).first()
        if first[0] == m.ncells:
            return stored(met.filter(F.col("id") <= first[1]).groupBy("r", "c").agg(F.max("id").alias("k")), "tiles")
        many *= 2


@operator
def tessellation(g: GridFrame, kind: str = "voronoi", n: int = 20, interaction: float = 0.1, size: tuple = (5, 20), name: str = "tiles", seed: int = 1) -> GridFrame:
    """voronoi: nearest of n random seeds.  gibbs: seeds keep their distance (share of the longer side).  rectangle: rectangles dropped until all is covered."""
    m, rng = g.meta, np.random.default_rng(seed)
    if kind == "rectangle":
        cells = dropped(g, size, seed)
        ids = numbered(cells.groupBy("k").agg(F.min(F.col("r").cast("long") * m.ncol + F.col("c")).alias("first")), "first", "v")
        return g.put_from(name, cells.join(ids, "k").select("r", "c", F.col("v").cast("double").alias("v")))
    seeds = []
    apart = interaction * max(m.nrow, m.ncol) if kind == "gibbs" else 0.0
    for _ in range(100 * n):
        y, x = rng.random() * m.nrow, rng.random() * m.ncol
        if all((y - b) ** 2 + (x - a) ** 2 >= apart**2 for _, b, a in seeds):
            seeds.append((len(seeds) + 1.0, y, x))
        if len(seeds) == n:
            break
    if len(seeds) < 2:
        raise ValueError("fewer than two seeds fit")
    return g.put_from(name, nearest(g.cells, seeds))
