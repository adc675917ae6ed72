"""Rounds of dilations, erosions and predicates on one binary layer, tile by tile: many between exchanges."""

from __future__ import annotations

import inspect
import math
import re
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.core import OPERATORS, GridFrame, Recipe
from gridframe.operators.stencil import is_binary, structure
from gridframe.plans.storage import stored

#: Sides of a tile that a task runs on its own, and cells around it that go along: each round needs as many as its kernels reach.
TILE, HALO = 256, 32
#: Tiles of a task, about.
TILES = 16
#: A cell's state, besides 0 and 1.
NULL, OUTSIDE = 2, 3


def local_steps(g: GridFrame, recipe: Recipe, name: str) -> list | None:
    """A recipe's steps as (operator, kernel or predicate), if all read and write cells of the layer and their neighbours alone; else None.

    Predicates read the other layers too, cell by cell.  Those with a call may look at whole layers or be random, those with
    a division may fail on values that no cell has; they aren't taken.
    """
    out = []
    for s in recipe.steps:
        if s.fn not in ("dilate", "erode", "mask_filter"):
            return None
        try:
            at = inspect.signature(OPERATORS[s.fn].__wrapped__).bind(g, *s.args, **s.kwargs)
        except TypeError:
            return None
        at.apply_defaults()
        a = at.arguments
        layer = g.names[0] if a["layer"] is None else a["layer"]
        if (a["add"] or layer) != name or layer not in g.names:
            return None
        if s.fn == "mask_filter":
            words = [w.lower() for w in re.findall(r"(\w+)\s*\(", a["expr"])] if isinstance(a["expr"], str) else ["?"]
            if a["value"] or set(words) - {"and", "or", "not", "in"} or re.search(r"(?i)\b(select|over|div|current_\w+)\b|[/%:\[]", a["expr"]):
                return None
            out.append((s.fn, a["expr"]))
        elif layer != name:
            return None
        else:
            out.append((s.fn, [(i, j) for i, j, _ in a["struct"] or structure("diamond", 3)]))
    return out if 0 < _reach(out) <= TILE else None


def _reach(steps: list) -> int:
    return sum(max((max(abs(i), abs(j)) for i, j in k), default=0) for fn, k in steps if fn != "mask_filter")


def _round(v: np.ndarray, tables: np.ndarray, steps: list) -> np.ndarray:
    """The states after all steps.  tables: for each predicate a bit for 0, 1 and null: whether it is true of such a cell."""
    nth = 0
    for fn, arg in steps:
        if fn == "mask_filter":
            v = np.where(v == OUTSIDE, v, (tables[nth] >> v) & 1)
            nth += 1
            continue
        far = max((max(abs(i), abs(j)) for i, j in arg), default=0)
        p = np.pad(v, far, constant_values=OUTSIDE)
        some = {x: np.zeros(v.shape, bool) for x in (0, 1)}
        for x, any_ in some.items():
            at = p == x
            for i, j in arg:
                any_ |= at[far + i : far + i + v.shape[0], far + j : far + j + v.shape[1]]
        first, gate = (1, 0) if fn == "dilate" else (0, 1)
        v = np.where(v == gate, np.where(some[first], first, np.where(some[gate], gate, NULL)), v)
    return v.astype(np.uint8)


_TILE = "ti int, tj int, h int, w int, planes binary, last int, hot boolean"


def _run(tiles: DataFrame, steps: list, many: int, rounds: int, rows: int, cols: int, halo: int) -> DataFrame:
    """Tiles after so many rounds.  last: the last of them that changed the tile, 0 if none; hot: whether that was the last of all."""

    def spread(frames):
        for f in frames:
            out = []
            for ti, tj, h, w, planes, _, hot in f.itertuples(index=False):
                p = np.frombuffer(planes, np.uint8).reshape(many, h, w)
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        if 0 <= ti + a < rows and 0 <= tj + b < cols:
                            # the side towards the tile at (a, b), which gets it from (-a, -b)
                            part = p[(slice(None), *(slice(None) if d == 0 else slice(0, halo) if d < 0 else slice(-halo, None) for d in (a, b)))]
                            out.append((ti + a, tj + b, -a, -b, *part.shape[1:], part.tobytes(), hot))
            yield pd.DataFrame(out, columns=["ti", "tj", "a", "b", "h", "w", "planes", "hot"])

    def go(f: pd.DataFrame) -> pd.DataFrame:
        own = f[(f["a"] == 0) & (f["b"] == 0)].iloc[0]
        h, w, last, planes = int(own["h"]), int(own["w"]), 0, own["planes"]
        if f["hot"].any():  # else the last round changed nothing here or around, so that further ones don't either
            p = np.zeros((many, h + 2 * halo, w + 2 * halo), np.uint8)
            p[0] = OUTSIDE
            at = lambda d, k, n: halo - k if d < 0 else halo if d == 0 else halo + n
            for a, b, y, x, part in f[["a", "b", "h", "w", "planes"]].itertuples(index=False):
                p[:, at(a, y, h) : at(a, y, h) + y, at(b, x, w) : at(b, x, w) + x] = np.frombuffer(part, np.uint8).reshape(many, y, x)
            inner = slice(halo, halo + h), slice(halo, halo + w)
            for k in range(1, rounds + 1):
                new = _round(p[0], p[1:], steps)
                if (new == p[0]).all():
                    break
                last = k if (new[inner] != p[0][inner]).any() else last
                p[0] = new
            planes = p[(slice(None), *inner)].tobytes()
        return pd.DataFrame({"ti": own["ti"], "tj": own["tj"], "h": h, "w": w, "planes": [planes], "last": last, "hot": last == rounds})

    parts = tiles.mapInPandas(spread, "ti int, tj int, a int, b int, h int, w int, planes binary, hot boolean")
    # a number of tasks of our own: tiles of few bytes (runs of one value) hold as much work as others, but Spark would run them all in one task
    parts = parts.repartition(-(-rows * cols // TILES), "ti", "tj")
    return stored(parts.groupBy("ti", "tj").applyInPandas(go, _TILE), "rounds")


def tiled(g: GridFrame, recipe: Recipe, name: str, times: float, stable: bool) -> tuple[GridFrame, int] | None:
    """The grid after the rounds of a loop and how many there were, or None where they can't run in tiles.

    A tile holds the layer and, for each predicate, what it says of the cell for each value that the layer can have.
    """
    steps = local_steps(g, recipe, name)
    if steps is None or not is_binary(g, name):
        return None
    g = replace(g, cells=stored(g.cells, "loop"), scans=1)
    side, m, names = TILE, g.meta, g.names
    halo = min(side, max(HALO, _reach(steps)))
    predicates = [arg for fn, arg in steps if fn == "mask_filter"]
    many, free = 1 + len(predicates), next(x for x in (f"_at{i}_" for i in range(len(names) + 1)) if not any(n.startswith(x) for n in names))
    said = [f"{free}{k}" for k in range(many)]
    cells = g.cells.withColumn(said[0], F.coalesce(F.col(name).cast("int"), F.lit(NULL)))
    for k, p in enumerate(predicates, 1):
        cells = cells.withColumn(said[k], F.lit(0))
        for i, x in enumerate((0.0, 1.0, None)):
            cells = cells.withColumn(name, F.lit(x).cast("double")).withColumn(said[k], F.col(said[k]) + F.when(F.coalesce(F.expr(p), F.lit(False)), 1 << i).otherwise(0))
    cells = cells.select(F.floor(F.col("r") / side).cast("int").alias("ti"), F.floor(F.col("c") / side).cast("int").alias("tj"), "r", "c", *[F.col(x).cast("byte").alias(f"p{k}") for k, x in enumerate(said)])

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(f["ti"].iloc[0]), int(f["tj"].iloc[0])
        h, w = min(side, m.nrow - ti * side), min(side, m.ncol - tj * side)
        p = np.zeros((many, h, w), np.uint8)
        p[0] = OUTSIDE
        for k in range(many):
            p[k, f["r"].to_numpy() - ti * side, f["c"].to_numpy() - tj * side] = f[f"p{k}"]
        return pd.DataFrame({"ti": ti, "tj": tj, "h": h, "w": w, "planes": [p.tobytes()], "last": 0, "hot": True})

    now, done, still = stored(cells.groupBy("ti", "tj").applyInPandas(tile, _TILE), "rounds"), 0, False
    times = times if times == float("inf") else math.ceil(times)
    while done < times and not still:
        rounds = int(min(halo // max(1, _reach(steps)), times - done))
        now = _run(now, steps, many, rounds, -(-m.nrow // side), -(-m.ncol // side), halo)
        last = now.agg(F.max("last")).first()[0]
        still = last < rounds
        # the round after the last change is the one that finds none
        done += last + 1 if still else rounds
    if not stable:
        done = times

    def back(frames):
        for f in frames:
            for ti, tj, h, w, planes in f.itertuples(index=False):
                yield pd.DataFrame({"r": ti * side + np.repeat(np.arange(h), w), "c": tj * side + np.tile(np.arange(w), h), "v": np.frombuffer(planes, np.uint8, h * w)})

    values = now.select("ti", "tj", "h", "w", "planes").mapInPandas(back, "r int, c int, v int")
    out = g.put_from(name, values.select("r", "c", F.when(F.col("v") < NULL, F.col("v").cast("double")).alias("v")))
    return replace(out, cells=out.cells.select("r", "c", *[F.col(f"`{n}`") for n in names]), binary=out.binary | {name}), done
