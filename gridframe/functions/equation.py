"""Metric equations: names with a focus, compiled to aggregates.

A name is `value.focus` or `value.focus_layer`; focus is self, others or all.  A value is a layer (or x, y) and means its
cells, or a measure of the layer's classes, or a table of pairs of classes.  An equation with a self or others has a
value for each class, any other one for the whole layer.  Precedence from low: |, &, !, comparisons, + -, * /, %% %/%,
unary minus, ^ (to the right).
"""

from __future__ import annotations

import math
import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.core import AGGREGATE_FUNCTIONS, FUNCTIONS, GridFrame, operator
from gridframe.functions.arithmetic import BINARY

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?)|([A-Za-z][A-Za-z0-9]*(?:\.(?:self|others|all)(?:_[A-Za-z0-9_]+)?)?)|(%%|%/%|<=|>=|==|!=|[-+*/^()<>!&|,\[\]]))")
_NAME = re.compile(r"^([^._]+)\.(self|others|all)(?:_(.+))?$")
AGGREGATES = ("sum", "mean", "max", "min", "median", "sd", "var", "prod", "length", "any", "all")
SCALARS = {
    "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)), "log": lambda v: F.when(v > 0, F.log(v)).when(v == 0, float("-inf")),
    "exp": F.exp, "abs": F.abs, "floor": lambda v: F.floor(v).cast("double"), "ceiling": lambda v: F.ceil(v).cast("double"), "round": F.rint,
}
_LEVELS = [["|"], ["&"], ["<", ">", "<=", ">=", "==", "!="], ["+", "-"], ["*", "/"], ["%%", "%/%"]]


def parse(text: str) -> tuple:
    """The equation as nested tuples: ("num", x), ("var", name, focus, layer), ("op", sign, ..), ("call", name, arg), ("index", base, mask)."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return (tokens[pos][3] or "") if pos < len(tokens) else None

    def take(sign: str) -> None:
        nonlocal pos
        if peek() != sign:
            raise ValueError(f"{sign!r} is missing in {text!r}")
        pos += 1

    def level(k: int) -> tuple:
        nonlocal pos
        if k == len(_LEVELS):
            return unary()
        left = level(k + 1)
        while peek() and peek() in _LEVELS[k]:
            sign = peek()
            pos += 1
            left = ("op", sign, left, level(k + 1))
        return left

    def unary() -> tuple:
        nonlocal pos
        if peek() in ("-", "!", "+"):
            sign = peek()
            pos += 1
            return ("neg" if sign == "-" else "not", unary()) if sign != "+" else unary()
        return power()

    def power() -> tuple:
        nonlocal pos
        base = atom()
        while peek() == "[":
            pos += 1
            base = ("index", base, level(0))
            take("]")
        if peek() == "^":
            pos += 1
            return ("op", "^", base, unary())
        return base

    def atom() -> tuple:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError(f"{text!r} ends too early")
        m = tokens[pos]
        pos += 1
        if m[1]:
            return ("num", float(m[1]))
        if m[2]:
            if peek() == "(":
                pos += 1
                arg = level(0)
                take(")")
                return ("call", m[2], arg)
            if m[2] in ("pi", "T", "F"):
                return ("num", {"pi": math.pi, "T": 1.0, "F": 0.0}[m[2]])
            if not (v := _NAME.match(m[2])):
                raise ValueError(f"{m[2]!r} has no focus (self, others or all)")
            return ("var", *v.groups())
        if m[3] == "(":
            inner = level(0)
            take(")")
            return inner
        raise ValueError(f"{m[3]!r} can't stand there in {text!r}")

    tree = level(0)
    if pos < len(tokens):
        raise ValueError(f"{text!r} goes on after its end")
    return tree


def _reduces(name: str) -> bool:
    return name in AGGREGATES or name in AGGREGATE_FUNCTIONS


def _variables(tree: tuple) -> list[tuple]:
    return [tree] if tree[0] == "var" else [v for x in tree[1:] if isinstance(x, tuple) for v in _variables(x)]


def _aggregates(tree: tuple) -> list[tuple]:
    """The outermost calls of aggregates."""
    if tree[0] == "call" and _reduces(tree[1]):
        return [tree]
    return [a for x in tree[1:] if isinstance(x, tuple) for a in _aggregates(x)]


def _column(tree: tuple, known: dict[tuple, Column]) -> Column:
    if tree in known:
        return known[tree]
    kind = tree[0]
    if kind == "num":
        return F.lit(tree[1])
    if kind == "neg":
        return -_column(tree[1], known)
    if kind == "not":
        return (_column(tree[1], known) == 0).cast("double")
    if kind == "call":
        known_functions = SCALARS | FUNCTIONS
        if tree[1] not in known_functions:
            raise ValueError(f"no function {tree[1]!r}")
        return known_functions[tree[1]](_column(tree[2], known))
    if kind == "op":
        a, b = _column(tree[2], known), _column(tree[3], known)
        if tree[1] in BINARY:
            return BINARY[tree[1]](a, b)
        logic = {"<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b, "&": lambda: (a != 0) & (b != 0), "|": lambda: (a != 0) | (b != 0)}
        return logic[tree[1]]().cast("double")
    raise ValueError(f"{tree[1:]} needs an aggregate around it")


def _aggregate(fun: str, v: Column) -> Column:
    if fun in AGGREGATE_FUNCTIONS:
        return AGGREGATE_FUNCTIONS[fun](v).cast("double")
    on = (v != 0).cast("double")
    return {"sum": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "max": F.max(v), "min": F.min(v), "median": F.median(v), "sd": F.stddev_samp(v), "var": F.var_samp(v), "prod": F.coalesce(F.product(v), F.lit(1.0)), "length": F.count(F.lit(1)).cast("double"), "any": F.max(on), "all": F.min(on)}[fun]


class Compiler:
    def __init__(self, g: GridFrame, layer: str):
        self.g, self.layer = g, layer
        self.ids = g.values(layer).filter("v is not null").select(F.col("v").cast("int").alias("gid")).distinct()

    def kind(self, name: str, layer: str | None) -> str:
        layer = layer or self.layer
        if name in self.g.names or name in ("x", "y"):
            return "cell"
        if layer not in self.g.names:
            raise ValueError(f"no layer {layer!r}")
        if (layer, name) in self.g.pairs:
            return "pair"
        if name in ("gid", "complete") or (layer in self.g.classes and name in self.g.classes[layer].columns):
            return "class"
        if name in self.g.globals.get(layer, {}):
            return "global"
        raise ValueError(f"nothing is called {name!r} on {layer!r}")

    def class_values(self, name: str, layer: str | None) -> DataFrame:
        """gid, x of a measure."""
        layer = layer or self.layer
        v, m = self.g.values(layer).filter("v is not null"), self.g.meta
        gid = F.col("v").cast("int").alias("gid")
        if name == "gid":
            return v.select(gid).distinct().withColumn("x", F.col("gid").cast("double"))
        if name == "complete":
            edge = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == m.nrow - 1) | (F.col("c") == m.ncol - 1)
            return v.groupBy(gid).agg((~F.max(edge)).cast("double").alias("x"))
        return self.g.classes[layer].select("gid", F.col(name).cast("double").alias("x"))

    def rows(self, var: tuple) -> DataFrame:
        """The rows that a name means: own (the class they are for, null: all), key (what they are), x."""
        _, name, focus, layer = var
        kind = self.kind(name, layer)
        if kind == "cell":
            m = self.g.meta
            value = m.x(F.col("c")) if name == "x" else m.y(F.col("r")) if name == "y" else F.col(name)
            base = self.g.cells.select(F.col(self.layer).cast("int").alias("own"), (F.col("r").cast("long") * m.ncol + F.col("c")).alias("key"), value.cast("double").alias("x"))
            return base
        if kind == "pair":
            t = self.g.pairs[(layer or self.layer, name)].select(F.col("a").cast("int").alias("own"), F.col("b").cast("long").alias("key"), F.col("value").alias("x"))
            return t.filter("own <> key") if focus == "others" else t.filter("own = key") if focus == "self" else t
        if kind == "class":
            return self.class_values(name, layer).select(F.col("gid").alias("own"), F.col("gid").cast("long").alias("key"), "x")
        return None

    def aggregated(self, tree: tuple) -> tuple[DataFrame | None, object]:
        """(gid, x) of an aggregate by class, or (None, number)."""
        _, fun, arg = tree
        number = None
        if arg[0] == "index" and arg[2][0] == "num":
            number, arg = int(arg[2][1]), arg[1]
        mask = None
        if arg[0] == "index":
            arg, mask = arg[1], arg[2]
        inner = _aggregates(arg) + (_aggregates(mask) if mask else [])
        names = [v for v in dict.fromkeys(_variables(arg) + (_variables(mask) if mask else []))]
        direct = [v for v in names if not any(v in _variables(a) for a in inner) or v in _outside(arg) or (mask and v in _outside(mask))]
        if not direct:
            raise ValueError(f"{fun} is over nothing")
        focus = {v[2] for v in direct}
        kinds = {self.kind(v[1], v[3]) for v in direct}
        if len(kinds) > 1 or len(focus) > 1:
            raise ValueError("an aggregate is over one kind of rows and one focus")
        focus, kind = focus.pop(), kinds.pop()
        table, known = None, {}
        for i, v in enumerate(direct):
            one = self.rows(v).withColumnRenamed("x", f"x{i}")
            table = one if table is None else table.join(one.drop("own"), "key")
            known[v] = F.col(f"x{i}")
        for i, a in enumerate(inner):
            by, number_ = self.aggregated(a)
            if by is None:
                known[a] = F.lit(number_)
            else:
                table = table.join(by.select(F.col("gid").alias("own"), F.col("x").alias(f"a{i}")), "own", "left")
                known[a] = F.col(f"a{i}")
        value = table.select("own", "key", _column(arg, known).alias("x"), (_column(mask, known) if mask else F.lit(1.0)).alias("m")).filter("m <> 0")
        if number is not None:
            raise ValueError("an index is a condition")
        if focus == "all" and kind != "pair":
            return None, value.agg(_aggregate(fun, F.col("x"))).first()[0]
        if focus == "self" or kind == "pair":
            return value.filter("own is not null").groupBy(F.col("own").alias("gid")).agg(_aggregate(fun, F.col("x")).alias("x")), None
        return self.of_others(fun, value), None

    def of_others(self, fun: str, value: DataFrame) -> DataFrame:
        """An aggregate over the rows of all other classes, from each class's own: a total less its part, the best of the rest, a rank that skips its own."""
        value = value.filter("x is not null") if fun != "length" else value
        if fun == "median":
            return self.median_of_others(value)
        x = F.col("x")
        if fun in ("min", "max"):
            best = F.min(x) if fun == "min" else F.max(x)
            own = value.groupBy("own").agg(best.alias("best"))
            top = [(r["own"], r["best"]) for r in own.orderBy(F.col("best").asc() if fun == "min" else F.col("best").desc()).limit(2).collect()]
            first, second = (top + [(None, None), (None, None)])[:2]
            known = self.ids.withColumnRenamed("gid", "own")
            out = F.when(F.col("own").eqNullSafe(F.lit(first[0])), F.lit(second[1]).cast("double")).otherwise(F.lit(first[1]).cast("double"))
            return known.select(F.col("own").alias("gid"), out.alias("x"))
        middle = (value.agg(F.avg("x")).first()[0] or 0.0) if fun in ("sd", "var") else 0.0
        off, size = x - middle, F.abs(x)
        parts = {
            "n": F.count(F.lit(1)).cast("double"), "s": F.coalesce(F.sum(off), F.lit(0.0)), "q": F.coalesce(F.sum(off * off), F.lit(0.0)), "zero": F.count(F.when(x == 0, 1)).cast("double"),
            "less": F.count(F.when(x < 0, 1)).cast("double"), "log": F.coalesce(F.sum(F.when(x != 0, F.log(size))), F.lit(0.0)),
        }
        own = value.groupBy("own").agg(*[v.alias(k) for k, v in parts.items()])
        total = own.agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in parts]).first()
        rest = {k: F.lit(total[k]) - F.coalesce(k, F.lit(0.0)) for k in parts}
        n = rest["n"]
        spread = F.when(n > 1, F.greatest(F.lit(0.0), rest["q"] - F.try_divide(rest["s"] * rest["s"], n)) / (n - 1))
        known = {
            "sum": rest["s"], "length": n, "mean": F.when(n > 0, F.try_divide(rest["s"], n)), "var": spread, "sd": F.sqrt(spread), "any": F.when(n > 0, (rest["zero"] < n).cast("double")), "all": F.when(n > 0, (rest["zero"] == 0).cast("double")),
            "prod": F.when(rest["zero"] > 0, 0.0).otherwise(F.exp(rest["log"]) * F.when(rest["less"] % 2 == 1, -1.0).otherwise(1.0)),
        }
        if fun not in known:
            raise ValueError(f"{fun} of others isn't supported: it can't be had from a total and each class's part")
        return self.ids.join(own.withColumnRenamed("own", "gid"), "gid", "left").select("gid", known[fun].alias("x"))

    def median_of_others(self, value: DataFrame) -> DataFrame:
        """The median of the rows of all other classes.

        With all rows ranked, the m-th that isn't a class's own has rank m plus the number of its own rows that fewer
        than m others precede.
        """
        from gridframe.plans.storage import numbered, stored

        rows = value.select("own", "x", F.struct("x", "own", "key").alias("at"))
        every = stored(numbered(rows, "at", "rank"), "ranks")
        mine = every.filter("own is not null").withColumn("before", F.col("rank") - F.row_number().over(Window.partitionBy("own").orderBy("rank")))
        total = every.count()
        sizes = self.ids.join(every.filter("own is not null").groupBy(F.col("own").alias("gid")).agg(F.count(F.lit(1)).alias("k")), "gid", "left").select("gid", (F.lit(total) - F.coalesce("k", F.lit(0))).alias("n")).filter("n > 0")
        asked = sizes.select("gid", F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))).alias("m"))
        own = mine.select(F.col("own").alias("gid"), "before")
        skipped = asked.join(own, "gid", "left").groupBy("gid", "m").agg(F.count(F.when(F.col("before") < F.col("m"), 1)).alias("j"))
        met = skipped.select("gid", (F.col("m") + F.col("j")).alias("rank")).distinct().join(every.select("rank", "x"), "rank")
        return self.ids.join(met.groupBy("gid").agg(F.avg("x").alias("x")), "gid", "left")


def _outside(tree: tuple) -> list[tuple]:
    """Names outside all aggregates."""
    if tree[0] == "call" and _reduces(tree[1]):
        return []
    return [tree] if tree[0] == "var" else [v for x in tree[1:] if isinstance(x, tuple) for v in _outside(x)]


@operator
def metric(g: GridFrame, equation: str, label: str, layer: str | None = None) -> GridFrame:
    """Evaluates an equation: for each class (a new measure) if it has a self or others, else for the layer."""
    layer = g.pick(layer)
    if "." in label or "_" in label or label in ("gid", "val", "colour", "complete", "x", "y", "pi"):
        raise ValueError(f"{label!r} can't be a label")
    tree, compiler = parse(equation), Compiler(g, layer)
    for v in _variables(tree):
        compiler.kind(v[1], v[3])
    table, known = compiler.ids, {}
    per_class = any(v[2] != "all" for v in _variables(tree))
    for i, a in enumerate(dict.fromkeys(_aggregates(tree))):
        by, number = compiler.aggregated(a)
        if by is None:
            known[a] = F.lit(number).cast("double")
        else:
            per_class = True
            table = table.join(by.withColumnRenamed("x", f"a{i}"), "gid", "left")
            known[a] = F.col(f"a{i}")
    for i, v in enumerate(dict.fromkeys(_outside(tree))):
        kind = compiler.kind(v[1], v[3])
        if kind == "global" and v[2] == "all":
            known[v] = F.lit(g.globals[v[3] or layer][v[1]])
        elif kind == "class" and v[2] == "self" and (v[3] or layer) == layer:
            table = table.join(compiler.class_values(v[1], v[3]).withColumnRenamed("x", f"v{i}"), "gid", "left")
            known[v] = F.col(f"v{i}")
        elif kind == "pair" and v[2] == "self":
            table = table.join(compiler.rows(v).select(F.col("own").alias("gid"), F.col("x").alias(f"v{i}")), "gid", "left")
            known[v] = F.col(f"v{i}")
        else:
            raise ValueError(f"{v[1]}.{v[2]} is more than one value; put an aggregate around it")
    value = _column(tree, known).cast("double")
    if per_class:
        return g.measured(layer, label, table.select("gid", value.alias("v")))
    number = g.cells.sparkSession.range(1).select(value.alias("v")).first()[0]
    return replace(g, globals=g.globals | {layer: g.globals.get(layer, {}) | {label: number}})
