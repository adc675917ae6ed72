"""Loops over recipes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridframe.core import GridFrame, Recipe, operator, replay
from gridframe.plans.rounds import tiled
from gridframe.plans.storage import stored


#: Steps after which cells are in other places, or layers gone.
_MOVES = {"crop", "pad", "rotate", "transpose", "resize", "select", "remove", "loop"}


def _holds(g: GridFrame, until: str) -> bool:
    """Whether a condition over whole layers, such as "sum(core) = 0", is true."""
    try:
        return g.cells.agg(F.expr(until).cast("boolean")).first()[0] is True
    except AnalysisException as e:
        raise ValueError(f"{until!r} isn't a single true or false over the layers") from e


@operator
def loop(g: GridFrame, recipe: Recipe, times: float = float("inf"), until: str | None = None, stable: bool = False, layer: str | None = None) -> GridFrame:
    """Runs a recipe again and again: so many times, until a condition over whole layers holds, or until the layer stays.

    until reduces the layers to one value, as in "sum(core) = 0" or "min(mask) = 1"; null counts as not true.  times caps
    the rounds of both conditions.  Values that differ by less than 1.5e-8 of their size are the same.  The cells are
    stored after each round, so that a plan never holds more than one; the history says how many there were.  Rounds of
    dilations, erosions and predicates on one binary layer run in tiles instead, many of them between exchanges.
    """
    if times == float("inf") and until is None and not stable:
        raise ValueError("a loop without end needs a condition")
    if times < 1:
        raise ValueError("a loop runs once at least")
    name, done = g.pick(layer), 0
    if until is None and (together := tiled(g, recipe, name, times, stable)):
        return replace(together[0], activity={"iterations": together[1]})
    was = next(x for x in (f"_was{i}" for i in range(len(g.names) + 1)) if x not in g.names)
    beside = stable and not _MOVES & {s.fn for s in recipe.steps}
    while done < times:
        # the layer as it was goes along as a layer of its own, where cells stay in their places
        new = replay(g.put(was, F.col(name)) if beside else g, recipe)
        new = replace(new, cells=stored(new.cells, "loop"), scans=1)
        done += 1
        same = False
        if stable:
            both = new.cells.select(F.col(name).alias("v"), F.col(was).alias("w")) if beside else new.values(name).join(g.values(name).withColumnRenamed("v", "w"), ["r", "c"])
            near = F.coalesce(F.abs(F.col("v") - F.col("w")) <= 1.5e-8 * F.greatest(F.lit(1.0), F.abs("w")), F.col("v").eqNullSafe(F.col("w")))
            same = not both.filter(~near).limit(1).count()
        if beside:
            new = replace(new, cells=new.cells.drop(was))
        g = replace(new, history=g.history)
        if same or (until is not None and _holds(g, until)):
            break
    return replace(g, activity={"iterations": done})
