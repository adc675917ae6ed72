"""Cell by cell: predicates, ranges, recoding, scaling and blending of layers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.core import FUNCTIONS, GridFrame, operator
from gridframe.functions.arithmetic import BINARY, summary_of_array


@operator
def mask_filter(g: GridFrame, expr: str | Column, value: bool = False, layer: str | None = None, add: str | None = None) -> GridFrame:
    """1 where a predicate over the layers holds, else 0; with value=True the layer's value there, else null."""
    layer = g.pick(layer)
    p = F.coalesce(F.expr(expr) if isinstance(expr, str) else expr, F.lit(False))
    out = g.put(add or layer, F.when(p, F.col(layer)) if value else F.when(p, 1.0).otherwise(0.0))
    return out if value else replace(out, binary=out.binary | {add or layer})


def _bounds(g: GridFrame, layer: str) -> tuple:
    return tuple(g.cells.agg(F.min(layer), F.max(layer)).first())


@operator
def value_range(g: GridFrame, lower: float | None = None, upper: float | None = None, background: float | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Values from lower to upper, others become background; bounds have to lie inside the layer's range."""
    layer = g.pick(layer)
    low, high = _bounds(g, layer)
    for b in (lower, upper):
        if b is not None and not low < b < high:
            raise ValueError(f"{b} isn't inside ({low}, {high})")
    v = F.col(layer)
    inside = (v >= (low if lower is None else lower)) & (v <= (high if upper is None else upper))
    return g.put(add or layer, F.when(inside, v).otherwise(F.lit(background).cast("double")))


@operator
def replace_values(g: GridFrame, old: list, new, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Maps old values to new ones all at once; None stands for null and the first match wins."""
    layer = g.pick(layer)
    new = new if isinstance(new, list) else [new]
    to = {}
    for i, a in enumerate(old):
        to.setdefault(None if a is None else float(a), new[i % len(new)])
    v, value = F.col(layer).cast("double"), lambda x: F.lit(x).cast("double")
    known = [(a, b) for a, b in to.items() if a is not None]
    out = v
    if known:
        table = F.create_map(*[x for a, b in known for x in (F.lit(a), value(b))])
        out = F.when(F.map_contains_key(table, v), F.try_element_at(table, v)).otherwise(v)
    return g.put(add or layer, F.when(v.isNull(), value(to[None])).otherwise(out) if None in to else F.when(v.isNotNull(), out))


def _labelled(g: GridFrame, layer: str, names: DataFrame) -> GridFrame:
    """The grid with names(gid, val) as the layer's class table."""
    return replace(g, classes=g.classes | {layer: names})


def _span(low, high) -> Column:
    """"low-high", both rounded to four places and without trailing zeros."""
    digits = lambda x: F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.bround(x, 4) + 0.0), "0+$", ""), "\\.$", "")
    return F.concat(digits(low), F.lit("-"), digits(high))


@operator
def categorise(g: GridFrame, breaks: list | None = None, n: int | None = None, shares: list | None = None, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Classes 1.. by break points or n equal bins (closed on the left, the last on both sides), or by shares of the cells.

    The layer's class table names each class that occurs by its bounds, "low-high".
    """
    if sum(x is not None for x in (breaks, n, shares)) != 1:
        raise ValueError("give one of breaks, n and shares")
    layer, spark = g.pick(layer), g.cells.sparkSession
    v = F.col(layer)
    low, high = _bounds(g, layer)
    if shares is not None:
        if abs(sum(shares) - 1) > 1e-8:
            raise ValueError("shares have to sum to 1")
        from gridframe.plans.storage import running, stored

        counts = stored(g.cells.filter(v.isNotNull()).groupBy(v.alias("v")).count(), "counts")  # one row a value
        total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        cuts = [round(sum(shares[: i + 1]) * total) for i in range(len(shares) - 1)]
        ranks = stored(running(counts, "v", "count", "upto").withColumn("before", F.col("upto") - F.col("count")), "ranks")
        split = reduce(lambda a, b: a | b, [(F.col("before") < k) & (F.col("upto") > k) for k in cuts], F.lit(False))
        if ranks.filter(split).limit(1).count():
            raise ValueError("a share cuts through equal values")
        cls = reduce(lambda a, b: a + b, [(F.col("before") >= k).cast("double") for k in cuts], F.lit(1.0))
        known = ranks.select("v", cls.alias("k"))
        out = g.put_from(add or layer, g.values(layer).join(known, "v").select("r", "c", F.col("k").alias("v")))
        return _labelled(out, add or layer, known.groupBy(F.col("k").cast("int").alias("gid")).agg(_span(F.min("v"), F.max("v")).alias("val")))
    if n is not None:
        breaks = [low + (high - low) * i / n for i in range(n + 1)]
    breaks = sorted({float(b) for b in breaks})
    if breaks[0] > low:
        breaks = [low, *breaks]
    if breaks[-1] < high:
        breaks = [*breaks, high]
    last = len(breaks) - 2
    cls = reduce(lambda a, b: a + b, [(v >= b).cast("double") for b in breaks[1:-1]], F.lit(1.0))
    out = g.put(add or layer, F.when((v >= breaks[0]) & (v <= breaks[last + 1]), cls))
    bounds = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(breaks, breaks[1:]))], "gid int, a double, b double")
    held = out.values(add or layer).filter("v is not null").select(F.col("v").cast("int").alias("gid")).distinct()
    return _labelled(out, add or layer, held.join(bounds, "gid").select("gid", _span(F.col("a"), F.col("b")).alias("val")))


@operator
def scale(g: GridFrame, to: tuple = (0, 1), layer: str | None = None, add: str | None = None) -> GridFrame:
    """Stretches the layer to a range; a constant layer becomes null."""
    layer = g.pick(layer)
    low, high = _bounds(g, layer)
    if low is None or low == high:
        return g.put(add or layer, F.lit(None).cast("double"))
    return g.put(add or layer, (F.col(layer) - low) / (high - low) * (to[1] - to[0]) + to[0])


@operator
def offset(g: GridFrame, fun: str, value: float, layer: str | None = None, add: str | None = None) -> GridFrame:
    """layer <fun> value, with fun one of + - * / %% %/% ^."""
    layer = g.pick(layer)
    return g.put(add or layer, BINARY[fun](F.col(layer), F.lit(float(value))))


@operator
def permute(g: GridFrame, kind: str = "invert", by: int = 1, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Maps the distinct values: invert (largest minus value), revert or descending (order reversed), ascending (as is), cycle."""
    layer = g.pick(layer)
    v = F.col(layer)
    low, high = _bounds(g, layer)
    if kind == "ascending":
        return g.put(add or layer, v)
    if kind == "invert":
        return g.put(add or layer, F.lit(high) - v)
    if kind == "cycle":
        moved = v + by
        return g.put(add or layer, F.when(moved > high, moved - high).when(moved < low, moved + high).otherwise(moved))
    if kind not in ("revert", "descending"):
        raise ValueError(f"no permutation {kind!r}")
    from gridframe.plans.storage import numbered, stored

    distinct = stored(numbered(g.cells.filter(v.isNotNull()).select(v.alias("v")).distinct(), "v", "k"), "values")
    n = distinct.count()
    back = distinct.select("v", (F.lit(n + 1) - F.col("k")).alias("k")).join(distinct.select(F.col("v").alias("w"), "k"), "k").select("v", "w")
    rows = g.values(layer).join(back, "v").select("r", "c", F.col("w").alias("v"))
    return g.put_from(add or layer, rows)


@operator
def perturb(g: GridFrame, sd: float, seed: int = 1, layer: str | None = None, add: str | None = None) -> GridFrame:
    """Adds normal noise; each cell's is fixed by the seed and its place."""
    from gridframe.functions.random import normal

    layer = g.pick(layer)
    return g.put(add or layer, F.col(layer) + sd * normal(seed, F.col("r"), F.col("c")))


@operator
def blend(g: GridFrame, layers: list[str], fun: str | Callable = "mean", weights: list | None = None, add: str | None = None) -> GridFrame:
    """One layer from several: an arithmetic operator from left to right (null if any is), a summary that skips nulls, or a
    function of one's own (or its registered name) that takes a Column a layer and gives one.
    """
    if len(layers) < 2:
        raise ValueError("a blend needs two layers or more")
    cols = [F.col(g.pick(x)).cast("double") * float(w) for x, w in zip(layers, weights or [1.0] * len(layers))]
    own = fun if callable(fun) else FUNCTIONS.get(fun)
    out = own(*cols).cast("double") if own else reduce(BINARY[fun], cols) if fun in BINARY else summary_of_array(fun, F.array(*cols))
    return g.put(add or layers[0], out)
