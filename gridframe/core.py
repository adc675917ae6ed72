"""The value that operators take and give: a grid's geometry, its cells as a DataFrame, and what was measured on it."""

from __future__ import annotations

import functools
import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridMeta:
    """Extent and size.  Rows count from the top; cell (r, c) has its centre at (x, y)."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    ncol: int
    nrow: int
    crs: str | None = None

    def __post_init__(self):
        if not (self.xmax > self.xmin and self.ymax > self.ymin and self.ncol >= 1 and self.nrow >= 1):
            raise ValueError("an extent needs xmin < xmax, ymin < ymax and at least one cell")

    @property
    def res(self) -> tuple[float, float]:
        return (self.xmax - self.xmin) / self.ncol, (self.ymax - self.ymin) / self.nrow

    @property
    def ncells(self) -> int:
        return self.ncol * self.nrow

    def x(self, c: Column) -> Column:
        return F.lit(self.xmin) + (c + 0.5) * self.res[0]

    def y(self, r: Column) -> Column:
        return F.lit(self.ymax) - (r + 0.5) * self.res[1]


#: Scans that the plan of a grid's cells may hold.
MOST_SCANS = 4


@dataclass(frozen=True)
class GridFrame:
    """cells(r, c, <layer> ..) with one row a cell.  classes: layer -> (gid, val, measures ..); pairs: (layer, name) -> (a, b, value)."""

    meta: GridMeta
    cells: DataFrame
    classes: dict[str, DataFrame] = field(default_factory=dict)
    pairs: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    globals: dict[str, dict[str, float]] = field(default_factory=dict)
    history: tuple = ()
    #: Layers known to hold 0, 1 and null alone; what the last step has to say for its history; scans that the cells' plan holds, about.
    binary: frozenset = frozenset()
    activity: dict = field(default_factory=dict)
    scans: int = 1

    @property
    def names(self) -> list[str]:
        return [c for c in self.cells.columns if c not in ("r", "c")]

    def pick(self, layer: str | None) -> str:
        if layer is None:
            return self.names[0]
        if layer not in self.names:
            raise ValueError(f"no layer {layer!r}; there are {self.names}")
        return layer

    def values(self, layer: str | None = None) -> DataFrame:
        """r, c, v of a layer."""
        return self.cells.select("r", "c", F.col(self.pick(layer)).alias("v"))

    def put(self, name: str, value: Column) -> GridFrame:
        """Writes a layer from an expression over the cells; what was measured on a layer of that name goes."""
        return self._changed(name, self.cells.withColumn(name, value))

    def put_from(self, name: str, rows: DataFrame) -> GridFrame:
        """Writes a layer from rows(r, c, v), made from the cells; cells without a row get null.

        The plan then holds the cells twice; before such plans grow by doubling, the cells are stored.  Rows are as many as
        cells but their files may be small (runs of one value), so that Spark would send them all to the driver: they are shuffled.
        """
        cells = self.cells.drop(name) if name in self.names else self.cells
        return self._changed(name, cells.join(rows.select("r", "c", F.col("v").alias(name)).hint("merge"), ["r", "c"], "left"))._grown()

    def _grown(self) -> GridFrame:
        """After a step whose plan holds the cells twice: stored before they are held too often."""
        if 2 * self.scans <= MOST_SCANS:
            return replace(self, scans=2 * self.scans)
        from gridframe.plans.storage import stored

        return replace(self, cells=stored(self.cells, "cells"), scans=1)

    def _changed(self, name: str, cells: DataFrame) -> GridFrame:
        if name in ("r", "c"):
            raise ValueError("r and c are the cells' rows and columns; a layer has another name")
        return replace(
            self, cells=cells, classes={k: v for k, v in self.classes.items() if k != name},
            pairs={k: v for k, v in self.pairs.items() if k[0] != name}, globals={k: v for k, v in self.globals.items() if k != name}, binary=self.binary - {name},
        )

    def measured(self, layer: str, name: str, values: DataFrame) -> GridFrame:
        """Adds values(gid, v) as a measure of the layer's classes."""
        new = values.select("gid", F.col("v").alias(name))
        old = self.classes.get(layer)
        table = new if old is None else old.drop(name).join(new, "gid", "full")
        return replace(self, classes=self.classes | {layer: table})

    def table(self, layer: str | None = None, overall: bool = False) -> DataFrame:
        """What is known of a layer's classes: gid, names, measures; with overall also the values of the whole layer, one row."""
        layer = self.pick(layer)
        known = self.globals.get(layer, {})
        if overall:
            if not known:
                raise ValueError(f"nothing is known of {layer!r} as a whole")
            spark = self.cells.sparkSession
            return spark.createDataFrame([tuple(None if v is None else float(v) for v in known.values())], ", ".join(f"`{k}` double" for k in known))
        if layer not in self.classes:
            raise ValueError(f"nothing is measured on {layer!r}")
        return self.classes[layer]

    def show(self, layer: str | None = None, n: int = 10) -> str:
        """A layer's class table as text, n classes at most and how many more there are, pairs by name, and its values as a whole."""
        layer = self.pick(layer)
        out = []
        if layer in self.classes:
            table = self.classes[layer].orderBy("gid")
            rows = table.limit(n + 1).collect()
            names = table.columns
            cut = [names] + [["-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in rows[:n]]
            widths = [max(len(r[i]) for r in cut) for i in range(len(names))]
            out += ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in cut]
            if len(rows) > n:
                out.append(f".. and {table.count() - n} more classes")
        out += [f"pairs of classes: {name}" for at, name in self.pairs if at == layer]
        out += [f"{k}: {v:.6g}" if v is not None else f"{k}: -" for k, v in self.globals.get(layer, {}).items()]
        return "\n".join([f"layer {layer}", *(out or ["nothing is measured"])])

    @property
    def provenance(self) -> list[dict]:
        """The steps that led here, oldest first: number, operator, arguments, layers it used and wrote, when, and what it had to say."""
        return [{"step": i + 1} | {k: v for k, v in h.items() if k != "step"} for i, h in enumerate(self.history)]

    def pull(self, layer: str | None = None) -> list:
        """A layer's values in row-major order, on the driver: for small grids."""
        return [x[0] for x in self.values(layer).orderBy("r", "c").select("v").collect()]

    def __repr__(self) -> str:
        m = self.meta
        steps = "".join(f"\n  {h['step']}. {h['fn']}({', '.join(map(str, h['args']))})" + "".join(f" [{k}: {v}]" for k, v in h.get("activity", {}).items()) for h in self.provenance)
        return f"GridFrame {m.nrow} x {m.ncol}, cells of {m.res[0]:g} x {m.res[1]:g}{f', {m.crs}' if m.crs else ''}, layers {', '.join(self.names)}{steps}"


@dataclass(frozen=True)
class Step:
    fn: str
    args: tuple
    kwargs: dict


@dataclass(frozen=True)
class Recipe:
    """Steps without a grid; run(grid) replays them."""

    steps: tuple = ()


OPERATORS: dict[str, Callable] = {}


#: Functions of a user's own, by name: of one Column (equations) or several (blend), and aggregates of one Column.
FUNCTIONS: dict[str, Callable] = {}
AGGREGATE_FUNCTIONS: dict[str, Callable] = {}


def register(name: str, fn: Callable, aggregate: bool = False) -> None:
    """Makes a function usable by name: of one Column in equations, of several in blends; an aggregate in equations, summaries and merges."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} can't be a name")
    (AGGREGATE_FUNCTIONS if aggregate else FUNCTIONS)[name] = fn


#: Characters of an argument from which the history holds a digest of it.
LARGE = 10_000


def _plain(x):
    """An argument for the history: as it is, as text, or if that is large its digest and length."""
    if isinstance(x, GridFrame):
        return f"<grid {x.meta.nrow} x {x.meta.ncol}: {', '.join(x.names)}>"
    try:
        text = json.dumps(x)
    except TypeError:
        x = text = getattr(x, "__name__", None) or str(x)
    if len(text) < LARGE:
        return x
    return f"<sha256 {hashlib.sha256(text.encode()).hexdigest()} of {len(text)} characters>"


def operator(fn: Callable) -> Callable:
    """Without a grid (None or a Recipe first) the call is recorded; else it runs and goes into the history."""

    @functools.wraps(fn)
    def run(g: GridFrame | Recipe | None = None, *args, **kwargs):
        step = Step(fn.__name__, args, kwargs)
        if g is None or isinstance(g, Recipe):
            return Recipe((g.steps if g else ()) + (step,))
        out = fn(g, *args, **kwargs)
        if out is g:
            return g
        entry = {"fn": step.fn, "args": [_plain(a) for a in args] + [f"{k}={_plain(v)}" for k, v in kwargs.items()], "step": step, "used": g.names, "made": [n for n in out.names if n not in g.names], "atTime": time.time()}
        if out.activity:
            entry["activity"] = out.activity
        return replace(out, history=g.history + (entry,), activity={})

    OPERATORS[fn.__name__] = run
    return run


def replay(g: GridFrame, recipe: Recipe | GridFrame) -> GridFrame:
    """Runs a recipe's steps, or the history of another grid, on g."""
    steps = recipe.steps if isinstance(recipe, Recipe) else tuple(h.get("step") for h in recipe.history)
    if None in steps:
        raise ValueError("a history that was read from files can be looked at but not run")
    if not steps:
        raise ValueError("the recipe has no steps")
    for s in steps:
        g = OPERATORS[s.fn](g, *s.args, **s.kwargs)
    return g


def blank(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """r, c of all cells."""
    cell = F.col("id")
    return spark.range(meta.ncells).select(F.floor(cell / meta.ncol).cast("int").alias("r"), (cell % meta.ncol).cast("int").alias("c"))


def grid(spark: SparkSession, extent: tuple, res, values=None, crs: str | None = None) -> GridFrame:
    """A grid from an extent (xmin, xmax, ymin, ymax), a resolution and matrices (one, or a dict by layer name)."""
    rx, ry = res if isinstance(res, (tuple, list)) else (res, res)
    meta = GridMeta(*map(float, extent), round((extent[1] - extent[0]) / rx), round((extent[3] - extent[2]) / ry), crs)
    layers = values if isinstance(values, dict) else {} if values is None else {"values": values}
    for name, m in layers.items():
        if len(m) != meta.nrow or any(len(row) != meta.ncol for row in m):
            raise ValueError(f"layer {name!r} isn't {meta.nrow} x {meta.ncol}")
    if not layers:
        return GridFrame(meta, blank(spark, meta))
    rows = [(r, c, *[None if m[r][c] is None or m[r][c] != m[r][c] else float(m[r][c]) for m in layers.values()]) for r in range(meta.nrow) for c in range(meta.ncol)]
    return GridFrame(meta, spark.createDataFrame(rows, "r int, c int, " + ", ".join(f"`{n}` double" for n in layers)))


def drawn(spark: SparkSession, text: str, extent: tuple | None = None) -> GridFrame:
    """A grid from rows of digits parted by "/", "." for null: for tests and examples."""
    m = [[None if ch == "." else float(ch) for ch in row] for row in text.split("/")]
    return grid(spark, extent or (0, len(m[0]), 0, len(m)), (((extent[1] - extent[0]) / len(m[0])), ((extent[3] - extent[2]) / len(m))) if extent else 1, m)
