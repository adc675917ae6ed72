"""Distances in cells: to the nearest source in three metrics, to the own class's target, over a cost surface, between classes."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.core import GridFrame, operator
from gridframe.operators.stencil import ROOK, sent
from gridframe.plans.storage import stored

METRICS = ("euclidean", "manhattan", "chessboard")
TILE = 256


def along_row(gap: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the cells of a row, given each column's distance to its nearest source (inf: none)."""
    n = len(gap)
    cols = np.arange(n, dtype=float)
    if metric == "manhattan":
        left = np.minimum.accumulate(gap - cols) + cols
        return np.minimum(left, (np.minimum.accumulate((gap + cols)[::-1])[::-1]) - cols)
    if metric in ("chessboard", "octile"):
        out = np.full(n, np.inf)
        for shift in range(n):  # a source at column offset `shift` can't give less than that
            if shift and (out <= shift).all():
                break
            d = np.maximum(gap, shift)
            if metric == "octile":
                d = d + (math.sqrt(2) - 1) * np.minimum(gap, shift)
            out[shift:] = np.minimum(out[shift:], d[: n - shift])
            out[: n - shift] = np.minimum(out[: n - shift], d[shift:])
        return out
    at = np.flatnonzero(np.isfinite(gap))
    if not len(at):
        return np.full(n, np.inf)
    # lower envelope of the parabolas gap[j]^2 + (x - j)^2
    keep, start, f = [], [], gap * gap
    for j in at:
        while keep:
            i = keep[-1]
            x = (f[j] + j * j - f[i] - i * i) / (2.0 * (j - i))
            if x > start[-1]:
                break
            keep.pop(), start.pop()
        start.append(x if keep else -np.inf)
        keep.append(j)
    own = np.array(keep)[np.searchsorted(np.array(start), cols, side="right") - 1]
    return np.sqrt(f[own] + (cols - own) ** 2)


def to_sources(g: GridFrame, source: DataFrame, metric: str) -> DataFrame:
    """r, c, v: distance to the nearest row of source(r, c); without any source rows + columns + own row."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    marked = g.cells.select("r", "c").join(source.select("r", "c").distinct().withColumn("s", F.lit(1)), ["r", "c"], "left")
    # both ways down a column by running frames; one that ends with the column would look at the rest of it for every cell
    hit = F.when(F.col("s").isNotNull(), F.col("r"))
    last = lambda order: F.last(hit, ignorenulls=True).over(Window.partitionBy("c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    gap = F.least(F.col("r") - last(F.col("r")), last(F.col("r").desc()) - F.col("r"))
    gaps = marked.select("r", "c", gap.cast("double").alias("gap"))
    none, ncol = float(g.meta.nrow + g.meta.ncol), g.meta.ncol
    band = max(1, TILE * TILE // ncol)

    def rows(f: pd.DataFrame) -> pd.DataFrame:
        r, c = f["r"].to_numpy(), f["c"].to_numpy()
        gap = np.full((r.max() - r.min() + 1, ncol), np.inf)
        gap[r - r.min(), c] = f["gap"].fillna(np.inf).to_numpy()
        d = np.array([along_row(x, metric) for x in gap])[r - r.min(), c]
        return pd.DataFrame({"r": r, "c": c, "v": np.where(np.isfinite(d), d, none + r)})

    return gaps.groupBy(F.floor(F.col("r") / band)).applyInPandas(rows, "r int, c int, v double")


@operator
def distance(g: GridFrame, source: str = "foreground", method: str = "euclidean", cost: str | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Distance in cells to the nearest 1 ("foreground"), the nearest 0 ("background"), or, given a layer's name, from the
    cells of each class to the cell of that layer with the same id.  With a cost layer: the cheapest path's cost over
    eight neighbours (a step costs the mean of its two cells, times the square root of 2 on the diagonal).
    """
    layer = g.pick(layer)
    v = g.values(layer)
    if source not in ("foreground", "background"):
        if cost:
            raise ValueError("cost goes with foreground or background")
        target = g.values(source).filter("v is not null and v <> 0").select(F.col("r").alias("tr"), F.col("c").alias("tc"), "v")
        if not target.limit(1).count():
            raise ValueError("no targets")
        d = F.sqrt(F.pow(F.col("r") - F.col("tr"), 2) + F.pow(F.col("c") - F.col("tc"), 2))
        return g.put_from(add or layer, v.join(target, "v").groupBy("r", "c").agg(F.min(d).alias("v")))
    seeds = v.filter(F.col("v") == (1 if source == "foreground" else 0)).select("r", "c")
    return g.put_from(add or layer, to_cost(g, seeds, cost) if cost else to_sources(g, seeds, method))


_AROUND = [(a, b, math.sqrt(2) if a and b else 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def relaxed(cost: np.ndarray, dist: np.ndarray, start: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Dijkstra on one tile: the cheapest way to each cell, given distances (inf: none) and the cells whose distance is new; nan costs are walls."""
    dist = np.where(np.isnan(cost), np.inf, dist)
    start = list(zip(*np.nonzero(np.isfinite(dist)))) if start is None else start
    heap = [(dist[i, j], i, j) for i, j in start if dist[i, j] < np.inf]
    heapq.heapify(heap)
    (h, w), k, d = cost.shape, cost.tolist(), dist.tolist()
    while heap:
        here, i, j = heapq.heappop(heap)
        if here > d[i][j]:
            continue
        own = k[i][j]
        for a, b, length in _AROUND:
            y, x = i + a, j + b
            if 0 <= y < h and 0 <= x < w and (other := k[y][x]) == other:
                new = here + (own + other) / 2 * length
                if new < d[y][x] - 1e-12:
                    d[y][x] = new
                    heapq.heappush(heap, (new, y, x))
    return np.array(d).reshape(cost.shape)


def _edge(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A tile's cells along the side towards (a, b): a row, a column or a corner."""
    return np.atleast_1d(x[0 if a < 0 else -1 if a > 0 else slice(None), 0 if b < 0 else -1 if b > 0 else slice(None)])


def _entered(cost: np.ndarray, dist: np.ndarray, news: list[tuple]) -> list[tuple[int, int]]:
    """Lowers a tile's border cells, in place, by what the neighbours say of theirs: (a, b, distances, costs); the cells that changed."""
    h, w = cost.shape
    changed = []
    for a, b, far, price in news:
        for n, (f, p) in enumerate(zip(far, price)):
            if not f < np.inf:
                continue
            # the neighbour's cell lies one step beyond this tile
            y0 = -1 if a < 0 else h if a > 0 else n
            x0 = -1 if b < 0 else w if b > 0 else n
            for i, j, length in _AROUND:
                y, x = y0 + i, x0 + j
                if 0 <= y < h and 0 <= x < w and cost[y, x] == cost[y, x]:
                    new = f + (p + cost[y, x]) / 2 * length
                    if new < dist[y, x] - 1e-12:
                        dist[y, x] = new
                        changed.append((y, x))
    return changed


_NEWS = "news array<struct<ti:int,tj:int,a:int,b:int,d:array<double>,k:array<double>>>"


def to_cost(g: GridFrame, seeds: DataFrame, cost: str) -> DataFrame:
    """r, c, v: the cheapest cost from seeds(r, c).

    A tile is a row, its costs stored once.  In a round the tiles that heard of a neighbour's border go on from the cells
    that it lowers, and tell their neighbours what changed along their own; the others rest.
    """
    cells = g.values(cost).withColumnRenamed("v", "k").join(seeds.select("r", "c").distinct().withColumn("d", F.lit(0.0)), ["r", "c"], "left")
    side = TILE
    laid = cells.select(F.floor(F.col("r") / side).cast("int").alias("ti"), F.floor(F.col("c") / side).cast("int").alias("tj"), "r", "c", F.col("k").cast("double"), "d")

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        r, c = f["r"].to_numpy(), f["c"].to_numpy()
        h, w = int(r.max() - r.min()) + 1, int(c.max() - c.min()) + 1
        k, d = np.full((h, w), np.nan), np.full((h, w), np.inf)
        at = r - r.min(), c - c.min()
        k[at], d[at] = f["k"].to_numpy(float), f["d"].fillna(np.inf).to_numpy(float)
        return pd.DataFrame({"ti": f["ti"].iloc[:1], "tj": f["tj"].iloc[:1], "h": h, "w": w, "k": [k.tobytes()], "d": [d.tobytes()], "busy": bool(np.isfinite(d).any())})

    def told(ti: int, tj: int, k: np.ndarray, old: np.ndarray, new: np.ndarray) -> list:
        out = []
        for a, b, _ in _AROUND:
            if (_edge(new, a, b) < _edge(old, a, b)).any():
                out.append((ti + a, tj + b, -a, -b, _edge(new, a, b).tolist(), _edge(k, a, b).tolist()))
        return out

    def go(frames):
        for f in frames:
            rows = []
            for ti, tj, h, w, kept, was, news in f.itertuples(index=False):
                k, old = (np.frombuffer(x).reshape(h, w) for x in (kept, was))
                if news is None:  # the first round starts from the seeds
                    new = relaxed(k, old)
                    old = np.full((h, w), np.inf)
                else:
                    new = old.copy()
                    new = relaxed(k, new, _entered(k, new, [(x["a"], x["b"], x["d"], x["k"]) for x in news]))
                rows.append((ti, tj, h, w, new.tobytes(), told(ti, tj, k, old, new)))
            yield pd.DataFrame(rows, columns=["ti", "tj", "h", "w", "d", "news"])

    tiles = stored(laid.groupBy("ti", "tj").applyInPandas(tile, "ti int, tj int, h int, w int, k binary, d binary, busy boolean"), "tiles")
    prices, state = tiles.select("ti", "tj", "k"), tiles.select("ti", "tj", "h", "w", "d")
    active = tiles.filter("busy").select("ti", "tj", "h", "w", "k", "d", F.lit(None).cast(_NEWS.split(" ", 1)[1]).alias("news"))
    while True:
        gone = stored(active.mapInPandas(go, f"ti int, tj int, h int, w int, d binary, {_NEWS}"), "gone")
        now = state.join(gone.select("ti", "tj"), ["ti", "tj"], "left_anti").unionByName(gone.select("ti", "tj", "h", "w", "d"))
        state = stored(now, "state")
        heard = gone.select(F.explode("news").alias("n")).select("n.ti", "n.tj", F.struct("n.ti", "n.tj", "n.a", "n.b", "n.d", "n.k").alias("n")).groupBy("ti", "tj").agg(F.collect_list("n").alias("news"))  # eight at most
        active = stored(state.join(heard, ["ti", "tj"]).join(prices, ["ti", "tj"]).select("ti", "tj", "h", "w", "k", "d", "news"), "active")
        if not active.limit(1).count():
            break

    def back(frames):
        for f in frames:
            for ti, tj, h, w, d in f.itertuples(index=False):
                v = np.frombuffer(d)
                yield pd.DataFrame({"r": ti * side + np.repeat(np.arange(h), w), "c": tj * side + np.tile(np.arange(w), h), "v": v})

    return state.mapInPandas(back, "r int, c int, v double").select("r", "c", F.when(F.col("v") < float("inf"), F.col("v")).alias("v"))


def border_cells(g: GridFrame, v: DataFrame) -> DataFrame:
    """r, c, v of those of rows(r, c, v) next to something else: the nearest cells of two classes are among them."""
    near = sent(g, v, ROOK).groupBy("r", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    return v.join(near, ["r", "c", "v"], "left").filter(F.coalesce("n", F.lit(0)) < 4).select("r", "c", "v")


#: Cells up to which classes are met by looking around each cell; classes farther apart are met by boxes.
REACH = 4
_MET = "a double, b double, d double, r0 int, c0 int, r1 int, c1 int"


def _norm(y: np.ndarray, x: np.ndarray, metric: str):
    return np.sqrt(y * y + x * x) if metric == "euclidean" else np.maximum(y, x) + (math.sqrt(2) - 1) * np.minimum(y, x)


def _norm_of(y, x, metric: str):
    y, x = y.cast("double"), x.cast("double")
    return F.sqrt(y * y + x * x) if metric == "euclidean" else F.greatest(y, x) + (math.sqrt(2) - 1) * F.least(y, x)


def _close(f: pd.DataFrame, side: int, reach: int, metric: str) -> pd.DataFrame:
    """Of a tile's cells, with those around it, the nearest two cells of each two classes that are within reach, the first by rows and columns."""
    top, left = int(f["ti"].iloc[0]) * side, int(f["tj"].iloc[0]) * side
    ids, code = np.unique(f["v"].to_numpy(float), return_inverse=True)
    k, at = len(ids), np.full((side + 2 * reach, side + 2 * reach), -1)
    at[f["r"].to_numpy() - top + reach, f["c"].to_numpy() - left + reach] = code
    own = at[reach : reach + side, reach : reach + side]
    ways: dict[float, list] = {}
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            d = float(_norm(abs(i), abs(j), metric))
            if 0 < d <= reach:
                ways.setdefault(d, []).append((i, j))
    known, out = np.zeros(k * k if k * k <= 1 << 24 else 0, bool), []
    many = np.zeros(0, np.int64)
    for d in sorted(ways):
        new = []
        for i, j in ways[d]:
            there = at[reach + i : reach + i + side, reach + j : reach + j + side]
            y, x = np.nonzero((own >= 0) & (own < there))
            key = own[y, x].astype(np.int64) * k + there[y, x]
            fresh = ~known[key] if len(known) else ~np.isin(key, many)
            key, first = np.unique(key[fresh], return_index=True)
            y, x = y[fresh][first], x[fresh][first]
            new.append(pd.DataFrame({"key": key, "d": d, "r0": top + y, "c0": left + x, "r1": top + y + i, "c1": left + x + j}))
        level = pd.concat(new).sort_values(["key", "r0", "c0", "r1", "c1"]).drop_duplicates("key")
        if len(known):
            known[level["key"]] = True
        else:
            many = np.union1d(many, level["key"])
        out.append(level)
    met = pd.concat(out)
    return met.assign(a=ids[met["key"] // k], b=ids[met["key"] % k])[["a", "b", "d", "r0", "c0", "r1", "c1"]]


def _far(g: GridFrame, cells: DataFrame, apart: DataFrame, metric: str) -> DataFrame:
    """The nearest two cells of the pairs apart(a, b) of classes: boxes around their border cells are halved twice at a
    time, and of each pair only boxes go on that can hold something as near as the nearest two boxes are sure to."""
    few = apart.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    border = stored(border_cells(g, cells.join(few, "v").select("r", "c", "v")), "border")
    level = 2 * math.ceil(math.log2(max(g.meta.nrow, g.meta.ncol, 2)) / 2)
    pairs = apart.select("a", "b", *[F.lit(0).alias(x) for x in ("ia", "ja", "ib", "jb")])
    while True:
        level -= 2
        cut = lambda x, by=level: F.shiftright(x, by)
        boxes = stored(border.groupBy("v", cut("r").alias("i"), cut("c").alias("j")).agg(F.min("r").alias("t"), F.max("r").alias("u"), F.min("c").alias("l"), F.max("c").alias("m")), "boxes")
        of = lambda k: boxes.select(F.col("v").alias(k), F.shiftright("i", 2).alias(f"i{k}"), F.shiftright("j", 2).alias(f"j{k}"), *[F.col(x).alias(f"{x}{k}") for x in ("i", "j", "t", "u", "l", "m")][2:], F.col("i").alias(f"_i{k}"), F.col("j").alias(f"_j{k}"))
        both = pairs.join(of("a"), ["a", "ia", "ja"]).join(of("b"), ["b", "ib", "jb"])
        gap = lambda low, high: F.greatest(F.lit(0), F.col(f"{low}b") - F.col(f"{high}a"), F.col(f"{low}a") - F.col(f"{high}b"))
        span = lambda low, high: F.greatest(F.col(f"{high}b") - F.col(f"{low}a"), F.col(f"{high}a") - F.col(f"{low}b"))
        least, most = _norm_of(gap("t", "u"), gap("l", "m"), metric), _norm_of(span("t", "u"), span("l", "m"), metric)
        both = stored(both.select("a", "b", *[F.col(f"_{x}").alias(x) for x in ("ia", "ja", "ib", "jb")], "ta", "la", "tb", "lb", least.alias("least"), most.alias("most")), "boxes")
        best = both.groupBy("a", "b").agg(F.min("most").alias("best"))
        kept = both.join(best, ["a", "b"]).filter("least <= best")
        if level == 0:  # boxes are cells now
            first = kept.groupBy("a", "b").agg(F.min(F.struct(F.col("least").alias("d"), F.col("ta").alias("r0"), F.col("la").alias("c0"), F.col("tb").alias("r1"), F.col("lb").alias("c1"))).alias("e"))
            return first.select("a", "b", "e.*")
        pairs = kept.select("a", "b", "ia", "ja", "ib", "jb")


def nearest_cells(g: GridFrame, layer: str, metric: str = "euclidean") -> DataFrame:
    """a, b, d, r0, c0, r1, c1: the nearest cells of each two classes a < b, of several pairs the first by rows and columns.

    Tiles are looked through side by side for classes that are a few cells apart, which settles all that are mixed; the
    others are met by boxes.
    """
    side, reach = TILE, REACH
    cells = stored(g.values(layer).filter("v is not null and v <> 0").select("r", "c", F.col("v").cast("double").alias("v")), "classed")
    tile = lambda x, by: F.floor((F.col(x) + by) / side).cast("int")
    around = F.array_distinct(F.array(*[F.struct(tile("r", i).alias("ti"), tile("c", j).alias("tj")) for i in (-reach, reach) for j in (-reach, reach)]))
    near = cells.select("r", "c", "v", F.explode(around).alias("k")).select("r", "c", "v", "k.ti", "k.tj")
    close = near.groupBy("ti", "tj").applyInPandas(lambda f: _close(f, side, reach, metric), _MET)
    met = stored(close.groupBy("a", "b").agg(F.min(F.struct("d", "r0", "c0", "r1", "c1")).alias("e")).select("a", "b", "e.*"), "near")
    ids = stored(cells.select("v").distinct(), "ids")
    every = ids.select(F.col("v").alias("a")).join(ids.select(F.col("v").alias("b")), F.col("a") < F.col("b"))
    apart = stored(every.join(met.select("a", "b"), ["a", "b"], "left_anti"), "apart")
    return met.unionByName(_far(g, cells, apart, metric)) if apart.limit(1).count() else met


def between(g: GridFrame, layer: str, metric: str) -> DataFrame:
    """a, b, d for each two classes a < b."""
    return nearest_cells(g, layer, metric).select("a", "b", "d")


def along_lines(g: GridFrame, layer: str, cost: str) -> DataFrame:
    """a, b, d: costs summed along the straight line between the nearest cells of each two classes, rounded half to even."""
    met = nearest_cells(g, layer)
    steps = met.withColumn("n", F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda x, y: F.rint(F.col(x) + (F.col(y) - F.col(x)) * F.col("t") / F.col("n")).cast("int")
    line = steps.select("a", "b", at("r0", "r1").alias("r"), at("c0", "c1").alias("c")).join(g.values(cost), ["r", "c"], "left")
    found = line.groupBy("a", "b").agg(F.when(F.count("v") == F.count(F.lit(1)), F.sum("v")).alias("d"))
    ids = g.values(layer).filter("v is not null and v <> 0").select(F.col("v").alias("a")).distinct()
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).unionByName(ids.select("a", F.col("a").alias("b"), F.lit(float("inf")).alias("d")))


@operator
def class_distance(g: GridFrame, routing: str = "cheapest", cost: str | None = None, unit: str = "map", name: str = "distance", layer: str | None = None) -> GridFrame:
    """The smallest distance between the cells of each two classes; infinite on the diagonal, null where no path is.

    straight: between centres; with a cost layer the sum of the costs of the cells on the line between the nearest two,
    both ends included, null if one is impassable.  cheapest: over eight neighbours, with a cost layer the cheapest path's cost (one
    relaxation a class).  unit "map" multiplies by the cell size, which has to be square.
    """
    layer = g.pick(layer)
    rx, ry = g.meta.res
    if unit == "map" and abs(rx - ry) > 1e-12:
        raise ValueError("map units need square cells")
    size = rx if unit == "map" else 1.0
    if cost and routing == "straight":
        pairs = along_lines(g, layer, cost)
    elif cost:
        parts = None
        ids = [x[0] for x in g.values(layer).filter("v is not null and v <> 0").select("v").distinct().orderBy("v").collect()]
        for i in ids:
            reach = to_cost(g, g.values(layer).filter(F.col("v") == i), cost).withColumnRenamed("v", "d")
            one = g.values(layer).filter("v is not null and v <> 0").join(reach, ["r", "c"]).groupBy(F.col("v").alias("b")).agg(F.min("d").alias("d"))
            one = stored(one.select(F.lit(i).alias("a"), "b", F.when(F.col("b") == i, float("inf")).otherwise(F.col("d")).alias("d")), "reach")
            parts = one if parts is None else parts.unionByName(one)
        pairs = parts
    else:
        met = between(g, layer, "euclidean" if routing == "straight" else "octile")
        ids = g.values(layer).filter("v is not null and v <> 0").select(F.col("v").alias("a")).distinct()
        pairs = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).unionByName(ids.select("a", F.col("a").alias("b"), F.lit(float("inf")).alias("d")))
    from dataclasses import replace

    return replace(g, pairs=g.pairs | {(layer, name): pairs.select("a", "b", (F.col("d") * size).alias("value"))})


