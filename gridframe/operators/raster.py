"""Vector geometry into layers, and shaded relief."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.core import GridFrame, operator


def _cell(g: GridFrame, x, y):
    m, (rx, ry) = g.meta, g.meta.res
    c = F.when(x == m.xmax, m.ncol - 1).otherwise(F.floor((x - m.xmin) / rx)).cast("int")
    r = F.when(y == m.ymin, m.nrow - 1).otherwise(F.floor((m.ymax - y) / ry)).cast("int")
    inside = (x >= m.xmin) & (x <= m.xmax) & (y >= m.ymin) & (y <= m.ymax)
    return r, c, inside


#: Least sides of a tile that a task burns geometry into, most tiles along a side, edges that one task takes in and samples that it looks at together.
TILE, MOST_TILES, MOST_EDGES, SAMPLES = 256, 256, 250_000, 500_000


def _sides(g: GridFrame) -> tuple[int, int]:
    return tuple(max(TILE, -(-n // MOST_TILES)) for n in (g.meta.nrow, g.meta.ncol))


def _burned(g: GridFrame, edges: DataFrame, burn) -> DataFrame:
    """r, c, v from edges(ti, tj, id, ..), tile by tile; burn gives a tile's ids, nan where none.  A tile of very many edges is dealt out by id."""
    high, wide = _sides(g)
    nrow, ncol = g.meta.nrow, g.meta.ncol
    edges = edges.withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.lit(edges.count()) / MOST_EDGES)))
    names = [x for x in edges.columns if x != "part"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        top, left = int(f["ti"].iloc[0]) * high, int(f["tj"].iloc[0]) * wide
        v = burn(f[names].sort_values("id", ascending=False, kind="stable"), top, left, min(high, nrow - top), min(wide, ncol - left))
        r, c = np.nonzero(~np.isnan(v))
        return pd.DataFrame({"r": r + top, "c": c + left, "v": v[r, c]})

    return edges.groupBy("ti", "tj", "part").applyInPandas(run, "r int, c int, v double").groupBy("r", "c").agg(F.max("v").alias("v"))


def _lines(g: GridFrame, segments: DataFrame) -> DataFrame:
    """r, c, v of segments(id, x, y, x2, y2, n), sampled n times: the largest id on each cell.

    A tile takes lines from the largest id down, and of those left only lines whose samples can meet an empty cell.
    """
    m, (rx, ry) = g.meta, g.meta.res
    high, wide = _sides(g)
    row = lambda y: F.floor((m.ymax - y) / ry)
    a, b = F.greatest(F.lit(0), row(F.greatest("y", "y2")) - 1), F.least(F.lit(m.nrow - 1), row(F.least("y", "y2")) + 1)
    tall = segments.withColumn("a", a).withColumn("b", b).filter("a <= b").withColumn("ti", F.explode(F.sequence(F.floor(F.col("a") / high), F.floor(F.col("b") / high))))
    # the part of the line in the tile's rows, and a cell more on either side
    share = lambda r: F.coalesce(F.try_divide(F.lit(m.ymax) - r * ry - F.col("y"), F.col("y2") - F.col("y")), F.lit(0.0))
    flat = F.col("y") == F.col("y2")
    one, two = share(F.col("ti") * high - 1), share((F.col("ti") + 1) * high + 1)
    low = F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(one, two))))
    top = F.when(flat, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(one, two))))
    at = lambda u: F.floor((F.col("x") + u * (F.col("x2") - F.col("x")) - m.xmin) / rx)
    left, right = F.greatest(F.lit(0), F.least(at(low), at(top)) - 1), F.least(F.lit(m.ncol - 1), F.greatest(at(low), at(top)) + 1)
    tiles = tall.withColumn("left", left).withColumn("right", right).filter("left <= right").withColumn("tj", F.explode(F.sequence(F.floor(F.col("left") / wide), F.floor(F.col("right") / wide))))

    def cell(x: np.ndarray, y: np.ndarray):
        c = np.where(x == m.xmax, m.ncol - 1, np.floor((x - m.xmin) / rx))
        r = np.where(y == m.ymin, m.nrow - 1, np.floor((m.ymax - y) / ry))
        return r, c, (x >= m.xmin) & (x <= m.xmax) & (y >= m.ymin) & (y <= m.ymax)

    def burn(f: pd.DataFrame, top: int, left: int, h: int, w: int) -> np.ndarray:
        ids, x, y, x2, y2 = (f[k].to_numpy(float) for k in ("id", "x", "y", "x2", "y2"))
        n = f["n"].to_numpy(np.int64)
        low, up = np.zeros(len(f)), np.ones(len(f))
        with np.errstate(divide="ignore", invalid="ignore"):
            for start, end, one, two in ((y, y2, m.ymax - (top + h) * ry, m.ymax - top * ry), (x, x2, m.xmin + left * rx, m.xmin + (left + w) * rx)):
                u, v = (one - start) / (end - start), (two - start) / (end - start)
                low = np.where(end == start, low, np.fmax(low, np.fmin(u, v)))
                up = np.where(end == start, up, np.fmin(up, np.fmax(u, v)))
        first = np.maximum(0, np.floor(low * (n - 1)) - 1).astype(np.int64)
        last = np.minimum(n - 1, np.ceil(up * (n - 1)) + 1).astype(np.int64)
        along = lambda k, i: (x[k] + i / (n[k] - 1) * (x2[k] - x[k]), y[k] + i / (n[k] - 1) * (y2[k] - y[k]))
        left_over = np.flatnonzero(first <= last)
        (ra, ca, _), (rb, cb, _) = (cell(*along(slice(None), i)) for i in (first, last))
        box = [np.clip(z, 0, e).astype(np.int64) for z, e in ((np.minimum(ra, rb) - top, h - 1), (np.maximum(ra, rb) - top, h - 1), (np.minimum(ca, cb) - left, w - 1), (np.maximum(ca, cb) - left, w - 1))]
        out = np.full(h * w, np.nan)
        while len(left_over):
            empty = np.zeros((h + 1, w + 1), np.int64)
            empty[1:, 1:] = np.isnan(out).reshape(h, w).cumsum(0).cumsum(1)
            t, u, l, r = (z[left_over] for z in box)
            left_over = left_over[empty[u + 1, r + 1] - empty[t, r + 1] - empty[u + 1, l] + empty[t, l] > 0]
            if not len(left_over):
                break
            count = last[left_over] - first[left_over] + 1
            some = max(1, int(np.searchsorted(count.cumsum(), SAMPLES)))
            now, count, left_over = left_over[:some], count[:some], left_over[some:]
            # a line of very many samples is looked at piece by piece
            for skip in range(0, int(count.max()), SAMPLES):
                size = np.clip(count - skip, 0, SAMPLES)
                k = np.repeat(now, size)
                i = np.arange(len(k)) - np.repeat(size.cumsum() - size, size) + first[k] + skip
                rows, cols, inside = cell(*along(k, i))
                ok = inside & (rows >= top) & (rows < top + h) & (cols >= left) & (cols < left + w)
                np.fmax.at(out, ((rows[ok] - top) * w + cols[ok] - left).astype(np.int64), ids[k[ok]])
        return out.reshape(h, w)

    return _burned(g, tiles.select("ti", "tj", "id", "x", "y", "x2", "y2", "n"), burn)


def _polygons(g: GridFrame, edges: DataFrame) -> DataFrame:
    """r, c, v of edges(id, x, y, x2, y2, top, bottom): the largest id whose edges hold the cell's centre.  An edge matters to its rows, as far as its right end."""
    m, (rx, ry) = g.meta, g.meta.res
    high, wide = _sides(g)
    reach = F.least(F.lit(m.ncol - 1), F.floor((F.greatest("x", "x2") - m.xmin) / rx) + 1)
    tiles = edges.withColumn("reach", reach).filter("reach >= 0")
    tiles = tiles.withColumn("ti", F.explode(F.sequence(F.floor(F.col("top") / high), F.floor(F.col("bottom") / high)))).withColumn("tj", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("reach") / wide))))

    def burn(f: pd.DataFrame, top: int, left: int, h: int, w: int) -> np.ndarray:
        out = np.full((h, w), np.nan)
        px = m.xmin + (np.arange(left, left + w) + 0.5) * rx
        for i, own in f.groupby("id", sort=False):
            if not np.isnan(out).any():
                break
            on, odd = np.zeros((h, w), bool), np.zeros((h, w), bool)
            for x1, y1, x2, y2, a, b in own[["x", "y", "x2", "y2", "top", "bottom"]].itertuples(index=False):
                rows = slice(max(int(a), top) - top, min(int(b), top + h - 1) - top + 1)
                py = (m.ymax - (np.arange(top, top + h)[rows] + 0.5) * ry)[:, None]
                cross = np.abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) < 1e-9
                on[rows] |= cross & (px >= min(x1, x2) - 1e-9) & (px <= max(x1, x2) + 1e-9) & (py >= min(y1, y2) - 1e-9) & (py <= max(y1, y2) + 1e-9)
                if y1 != y2:
                    odd[rows] ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
            out[np.isnan(out) & (on | odd)] = i
        return out

    return _burned(g, tiles.select("ti", "tj", "id", "x", "y", "x2", "y2", "top", "bottom"), burn)


@operator
def rasterise(g: GridFrame, geometry: DataFrame, kind: str, name: str = "geometry") -> GridFrame:
    """Ids of points, lines or polygons, from geometry(id, part, seq, x, y); where they meet, the later one.

    Lines are sampled every tenth of a cell.  A cell is in a polygon if its centre is, by the even-odd rule over the
    rings; a centre on an edge is inside.
    """
    if kind == "point":
        r, c, inside = _cell(g, F.col("x"), F.col("y"))
        return g.put_from(name, geometry.filter(inside).select(r.alias("r"), c.alias("c"), "id", "seq").groupBy("r", "c").agg(F.max_by("id", F.struct("seq", "id")).cast("double").alias("v")))
    w = Window.partitionBy("id", "part").orderBy("seq")
    if kind == "line":
        if geometry.groupBy("id", "part").count().filter("count < 2").limit(1).count():
            raise ValueError("a line needs two vertices")
        step = min(g.meta.res) / 10
        segments = geometry.select("id", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter("x2 is not null")
        length = F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2))
        n = F.greatest(F.lit(2), (F.ceil(length / step) + 1).cast("int"))
        return g.put_from(name, _lines(g, segments.withColumn("n", n)))
    if kind != "polygon":
        raise ValueError("kind is point, line or polygon")
    if geometry.groupBy("id", "part").agg(F.count_distinct("x", "y").alias("n")).filter("n < 3").limit(1).count():
        raise ValueError("a ring needs three vertices")
    first = F.first("x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.first("y").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = geometry.select("id", "x", "y", F.coalesce(F.lead("x").over(w), first[0]).alias("x2"), F.coalesce(F.lead("y").over(w), first[1]).alias("y2")).filter("x <> x2 or y <> y2")
    # an edge meets the rows of its own height alone
    m, (_, ry) = g.meta, g.meta.res
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    top = F.greatest(F.lit(0), F.ceil((m.ymax - high) / ry - 0.5 - 1e-9).cast("int"))
    bottom = F.least(F.lit(m.nrow - 1), F.floor((m.ymax - low) / ry - 0.5 + 1e-9).cast("int"))
    return g.put_from(name, _polygons(g, edges.withColumn("top", top).withColumn("bottom", bottom).filter("top <= bottom")))


def spaghetti(rows: DataFrame) -> DataFrame:
    """geometry(id, part, seq, x, y) from rows(id, rings array<array<struct<x,y>>>)."""
    parts = rows.select("id", F.posexplode("rings").alias("part", "ring"))
    return parts.select("id", "part", F.posexplode("ring").alias("seq", "p")).select("id", "part", "seq", "p.x", "p.y")


_KINDS = {"POINT": "point", "MULTIPOINT": "point", "LINESTRING": "line", "MULTILINESTRING": "line", "POLYGON": "polygon", "MULTIPOLYGON": "polygon"}


def from_wkt(rows: DataFrame) -> tuple[DataFrame, str]:
    """geometry(id, part, seq, x, y) and its kind, from rows(id, wkt): well-known text of points, lines or polygons, single or multiple, all of one kind.

    Rings and lines are parts; a ring's last vertex, which repeats the first, goes.  Further ordinates are left out.
    """
    text = F.upper(F.trim("wkt"))
    named = rows.select("id", F.regexp_extract(text, "^(?:SRID=\\d+;)?\\s*([A-Z]+)", 1).alias("name"), text.alias("wkt"))
    names = [r["name"] for r in named.select("name").distinct().limit(20).collect()]
    kinds = {_KINDS.get(n) for n in names}
    if None in kinds:
        raise ValueError(f"can't read {sorted(n for n in names if n not in _KINDS)}")
    if len(kinds) != 1:
        raise ValueError(f"geometries of different kinds: {', '.join(sorted(kinds))}")
    kind = kinds.pop()
    # the innermost brackets hold the vertices; points in brackets of their own are one part each
    rings = named.select("id", F.posexplode(F.regexp_extract_all("wkt", F.lit("\\(([^()]+)\\)"), F.lit(1))).alias("part", "ring"))
    vertices = rings.select("id", "part", F.posexplode(F.split(F.trim("ring"), "\\s*,\\s*")).alias("seq", "p"), F.size(F.split("ring", ",")).alias("n"))
    at = vertices.select("id", "part", "seq", "n", F.split("p", "\\s+").alias("p")).select("id", "part", "seq", "n", F.col("p")[0].cast("double").alias("x"), F.col("p")[1].cast("double").alias("y"))
    return (at.filter("seq < n - 1") if kind == "polygon" else at).select("id", "part", "seq", "x", "y"), kind


@operator
def hillshade(g: GridFrame, azimuth: tuple = (315,), altitude: float = 45, exaggeration: float = 1, layer: str | None = None, add: str = "shade") -> GridFrame:
    """Light on a surface from 3x3 differences (weights 1, 2, 1; edges repeat), averaged over the azimuths, not below 0."""
    layer = g.pick(layer)
    rx, ry = g.meta.res
    down, across = Window.partitionBy("c").orderBy("r"), Window.partitionBy("r").orderBy("c")
    v = F.col("v") * float(exaggeration)
    one = g.values(layer).withColumn("v", v)
    one = one.withColumn("u", F.coalesce(F.lag("v").over(down), F.col("v"))).withColumn("d", F.coalesce(F.lead("v").over(down), F.col("v")))
    side = lambda k, f: F.coalesce(f(k).over(across), F.col(k))
    for k in ("u", "v", "d"):
        one = one.withColumn(f"{k}w", side(k, F.lag)).withColumn(f"{k}e", side(k, F.lead))
    dx = ((F.col("ue") + 2 * F.col("ve") + F.col("de")) - (F.col("uw") + 2 * F.col("vw") + F.col("dw"))) / (8 * rx)
    dy = ((F.col("dw") + 2 * F.col("d") + F.col("de")) - (F.col("uw") + 2 * F.col("u") + F.col("ue"))) / (8 * ry)
    slope = F.atan(F.sqrt(dx * dx + dy * dy))
    aspect = F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.pmod(F.atan2(-dx, dy) + 2 * math.pi, F.lit(2 * math.pi)))
    high = math.radians(altitude)
    shades = [F.greatest(F.lit(0.0), math.sin(high) * F.cos(slope) + math.cos(high) * F.sin(slope) * F.cos(math.radians(a) - aspect)) for a in azimuth]
    return g.put_from(add, one.select("r", "c", (sum(shades[1:], shades[0]) / len(shades)).alias("v")))
