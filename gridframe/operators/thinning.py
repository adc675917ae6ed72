"""Skeletons by rounds of synchronous 3x3 tests, tile by tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.core import GridFrame, operator
from gridframe.plans.storage import stored


#: Sides of a tile that a task thins on its own, and cells around it that go along: each round needs two of them.
TILE, HALO = 256, 16
_RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _around(v: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each cell, clockwise from the north, 0 outside."""
    p = np.pad(v, 1)
    return [p[1 + i : 1 + i + v.shape[0], 1 + j : 1 + j + v.shape[1]] for i, j in _RING]


def _simple(n: list[np.ndarray]) -> np.ndarray:
    """One 8-connected object and one 4-connected background part (with an edge neighbour) around the cell: Yokoi's number is 1."""
    out = [1 - x for x in n]
    return sum(out[k] - out[k] * out[(k + 1) % 8] * out[(k + 2) % 8] for k in (0, 2, 4, 6)) == 1


#: Of each neighbour (clockwise from the north) the cells beside the way to it: on either side of an edge neighbour the cell's own and
#: the corner, of a corner neighbour the two edge neighbours.
_BESIDE = {0: ((6, 7), (2, 1)), 2: ((0, 1), (4, 3)), 4: ((2, 3), (6, 5)), 6: ((4, 5), (0, 7)), 1: (0, 2), 3: (2, 4), 5: (4, 6), 7: (6, 0)}
#: The order in which neighbours are looked at: west, east, north, south, then the corners north-west, south-west, north-east, south-east.
_ORDER = (6, 2, 0, 4, 7, 5, 1, 3)


def independent(code: np.ndarray) -> np.ndarray:
    """Whether simple cells can go together with all their simple neighbours, from the neighbours' codes (eight columns): 1 set, plus 2 simple, plus 4 for each cell set around it.

    A cell may with an edge neighbour if cells are set on one side of the pair alone, with a corner neighbour if one of
    the two cells beside the pair is.  Two or three simple neighbours can still form a triple or a square with the cell
    that mustn't go at once: then each of them has as many neighbours as there are of them, and the cells beside the
    last pair are those of such a group.
    """
    on, simple, count = code > 0, code // 2 % 2 == 1, code // 4
    fine, two, three = np.ones(len(code), bool), np.zeros(len(code), bool), np.zeros(len(code), bool)
    for k in _ORDER:
        if k % 2:
            a, b = (on[:, x] for x in _BESIDE[k])
            pair, alone, both = a | b, a != b, a & b
        else:
            (a, b), (c, d) = ([on[:, x] for x in side] for side in _BESIDE[k])
            pair = (a | b) != (c | d)
            n = a.astype(int) + b + c + d
            alone, both = n == 1, (n == 2) & ((a & b) | (c & d))
        fine &= ~simple[:, k] | pair
        # of the last simple neighbour in this order
        two, three = np.where(simple[:, k], alone, two), np.where(simple[:, k], both, three)
    many = simple.sum(axis=1)
    alike = (~simple | (count == many[:, None])).all(axis=1)
    return fine & ~((((many == 2) & two) | ((many == 3) & three)) & alike)


def _homotopic(v: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """A round: cells that go."""
    n = _around(v)
    # a first look at the neighbours codes each cell: set, simple and free to go, and the cells set around it
    free = (v == 1) & _simple(n) & ~keep
    code = np.where(v == 1, 1 + 2 * free + 4 * sum(n), 0)
    y, x = np.nonzero(free)
    gone = np.zeros(v.shape, bool)
    gone[y, x] = independent(np.stack([k[y, x] for k in _around(code)], axis=1))
    return gone


def _zhang_suen(v: np.ndarray, keep: np.ndarray, second: bool) -> np.ndarray:
    """A pass: cells that go."""
    n = _around(v)
    count, turns = sum(n), sum(((n[k] == 0) & (n[(k + 1) % 8] == 1)).astype(np.int8) for k in range(8))
    a, b = (n[0] * n[2] * n[6], n[0] * n[4] * n[6]) if second else (n[0] * n[2] * n[4], n[2] * n[4] * n[6])
    return (v == 1) & ~keep & (count >= 2) & (count <= 6) & (turns == 1) & (a == 0) & (b == 0)


_TILE = "ti int, tj int, h int, w int, v binary, keep binary, hot boolean"


def _thinned(tiles: DataFrame, method: str, rows: int, cols: int, halo: int) -> DataFrame:
    """Tiles after a few rounds: as many as the cells around them allow.  hot: whether a tile changed."""

    def spread(frames):
        for f in frames:
            out = []
            for ti, tj, h, w, v, keep, hot in f.itertuples(index=False):
                v, keep = (np.frombuffer(x, np.int8).reshape(h, w) for x in (v, keep))
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        if 0 <= ti + a < rows and 0 <= tj + b < cols:
                            # the side towards the tile at (a, b), which gets it from (-a, -b)
                            cut = tuple(slice(None) if d == 0 else slice(0, halo) if d < 0 else slice(-halo, None) for d in (a, b))
                            out.append((ti + a, tj + b, -a, -b, *v[cut].shape, v[cut].tobytes(), keep[cut].tobytes(), hot))
            yield pd.DataFrame(out, columns=["ti", "tj", "a", "b", "h", "w", "v", "keep", "hot"])

    def go(f: pd.DataFrame) -> pd.DataFrame:
        own = f[(f["a"] == 0) & (f["b"] == 0)].iloc[0]
        h, w = int(own["h"]), int(own["w"])
        if not f["hot"].any():  # nothing changed here or around
            return own.to_frame().T[["ti", "tj", "h", "w", "v", "keep", "hot"]]
        v, keep = (np.zeros((h + 2 * halo, w + 2 * halo), t) for t in (np.int8, bool))
        at = lambda d, k, n: halo - k if d < 0 else halo if d == 0 else halo + n
        for a, b, y, x, part, stay in f[["a", "b", "h", "w", "v", "keep"]].itertuples(index=False):
            spot = slice(at(a, y, h), at(a, y, h) + y), slice(at(b, x, w), at(b, x, w) + x)
            v[spot], keep[spot] = np.frombuffer(part, np.int8).reshape(y, x), np.frombuffer(stay, np.int8).reshape(y, x)
        for _ in range(halo // 2):
            before = v.copy()
            if method == "homotopic":
                v[_homotopic(v, keep)] = 0
            else:
                v[_zhang_suen(v, keep, False)] = 0
                v[_zhang_suen(v, keep, True)] = 0
            if (v == before).all():
                break
        new = v[halo : halo + h, halo : halo + w].tobytes()
        return pd.DataFrame({"ti": own["ti"], "tj": own["tj"], "h": h, "w": w, "v": [new], "keep": [own["keep"]], "hot": new != own["v"]})

    parts = tiles.mapInPandas(spread, "ti int, tj int, a int, b int, h int, w int, v binary, keep binary, hot boolean")
    return stored(parts.groupBy("ti", "tj").applyInPandas(go, _TILE), "thin")


@operator
def skeletonise(g: GridFrame, background: float | None = None, anchor: str | None = None, method: str = "zhangSuen", layer: str | None = None, add: str | None = None) -> GridFrame:
    """Thins a binary layer to lines.  Cells where the anchor layer isn't 0 or null stay.

    zhangSuen: two alternating sub-passes.  homotopic: in each round all cells go that are simple (their removal keeps
    the number of parts and holes) and independent of their simple neighbours, whatever the order.  Zeros and nulls
    become background.  A tile is a row of bytes; it runs several rounds with the cells around it before it hears of
    its neighbours again, and rests where nothing changes.
    """
    layer = g.pick(layer)
    keep = F.coalesce(F.col(anchor) != 0, F.lit(False)) if anchor else F.lit(False)
    if method not in ("zhangSuen", "homotopic"):
        raise ValueError(f"no method {method!r}")
    side, halo, m = TILE, min(HALO, TILE), g.meta
    cells = g.cells.select(F.floor(F.col("r") / side).cast("int").alias("ti"), F.floor(F.col("c") / side).cast("int").alias("tj"), "r", "c", F.coalesce(F.col(layer).cast("double"), F.lit(0.0)).alias("v"), keep.alias("keep"))

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(f["ti"].iloc[0]), int(f["tj"].iloc[0])
        h, w = min(side, m.nrow - ti * side), min(side, m.ncol - tj * side)
        v, stay = np.zeros((h, w), np.int8), np.zeros((h, w), np.int8)
        at = f["r"].to_numpy() - ti * side, f["c"].to_numpy() - tj * side
        v[at], stay[at] = np.where(f["v"].isin((0, 1)), f["v"], 2), f["keep"]
        return pd.DataFrame({"ti": ti, "tj": tj, "h": h, "w": w, "v": [v.tobytes()], "keep": [stay.tobytes()], "hot": bool((v == 2).any())})

    now = stored(cells.groupBy("ti", "tj").applyInPandas(tile, _TILE), "thin")
    if now.filter("hot").limit(1).count():
        raise ValueError("a skeleton needs a layer of 0 and 1")
    now = now.withColumn("hot", F.lit(True))
    while True:
        now = _thinned(now, method, -(-m.nrow // side), -(-m.ncol // side), halo)
        if not now.filter("hot").limit(1).count():
            break

    def back(frames):
        for f in frames:
            for ti, tj, h, w, v in f.itertuples(index=False):
                yield pd.DataFrame({"r": ti * side + np.repeat(np.arange(h), w), "c": tj * side + np.tile(np.arange(w), h), "v": np.frombuffer(v, np.int8)})

    cells = now.select("ti", "tj", "h", "w", "v").mapInPandas(back, "r int, c int, v int")
    return g.put_from(add or layer, cells.select("r", "c", F.when(F.col("v") == 1, 1.0).otherwise(F.lit(background).cast("double")).alias("v")))
