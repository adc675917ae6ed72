"""Arithmetic with floored division and remainders, infinities for x / 0, and summaries of values with nulls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridframe.core import AGGREGATE_FUNCTIONS


def divide(a: Column, b: Column) -> Column:
    """a / b; an infinity of a's sign for b = 0, null for 0 / 0."""
    return F.when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf"))).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, divide(a, b)).otherwise(F.floor(F.try_divide(a, b)).cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null for b = 0."""
    return F.when(b != 0, a - F.floor(F.try_divide(a, b)) * b)


BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%%": modulo, "%/%": floor_divide, "^": F.pow, "**": F.pow}


def summary(fun: str | Callable, v: Column) -> Column:
    """An aggregate by name, or a function of one's own from a Column to an aggregate.  sum of none is 0, any of none 0, all of none 1; n counts nulls; unique is a single value besides 0, else null."""
    fun = AGGREGATE_FUNCTIONS.get(fun, fun) if isinstance(fun, str) else fun
    if callable(fun):
        return fun(v).cast("double")
    other = F.when(v != 0, v)
    known = {
        "max": F.max(v), "min": F.min(v), "sum": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "median": F.median(v),
        "any": F.coalesce(F.max((v != 0).cast("double")), F.lit(0.0)), "all": F.coalesce(F.min((v != 0).cast("double")), F.lit(1.0)),
        "n": F.count(F.lit(1)).cast("double"), "n_distinct": F.count_distinct(other).cast("double"), "unique": F.when(F.min(other) == F.max(other), F.max(other)),
    }
    if fun not in known:
        raise ValueError(f"no summary {fun!r}; there are {', '.join(known)}")
    return known[fun].cast("double")


def summary_of_array(fun: str, a: Column) -> Column:
    """The same summaries over the values of an array."""
    kept = F.filter(a, lambda x: x.isNotNull())
    n = F.size(kept)
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
    other = F.array_distinct(F.filter(kept, lambda x: x != 0))
    ordered = F.array_sort(kept)
    at = lambda i: F.get(ordered, i.cast("int"))
    known = {
        "max": F.array_max(kept), "min": F.array_min(kept), "sum": total, "mean": F.when(n > 0, total / n),
        "median": F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2),
        "any": F.exists(kept, lambda x: x != 0).cast("double"), "all": F.forall(kept, lambda x: x != 0).cast("double"),
        "n": F.size(a).cast("double"), "n_distinct": F.size(other).cast("double"), "unique": F.when(F.size(other) == 1, F.get(other, F.lit(0))),
    }
    if fun not in known:
        raise ValueError(f"no summary {fun!r}; there are {', '.join(known)}")
    return known[fun].cast("double")
