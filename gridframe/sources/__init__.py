"""Reading and writing grids."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridframe.core import GridFrame, GridMeta


def write(g: GridFrame, path: str) -> None:
    """Cells, class tables and tables of pairs as Parquet, geometry and history as one line of JSON, through Spark's writers."""
    spark = g.cells.sparkSession
    g.cells.write.mode("overwrite").parquet(f"{path}/cells")
    for i, t in enumerate(g.classes.values()):
        t.write.mode("overwrite").parquet(f"{path}/classes/{i}")
    for i, t in enumerate(g.pairs.values()):
        t.write.mode("overwrite").parquet(f"{path}/pairs/{i}")
    history = [{k: v for k, v in h.items() if k != "step"} for h in g.history]
    side = {"meta": asdict(g.meta), "classes": list(g.classes), "pairs": [list(k) for k in g.pairs], "globals": g.globals, "history": history, "binary": sorted(g.binary)}
    spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/grid")


def read(spark: SparkSession, path: str) -> GridFrame:
    """A written grid: layers, classes, pairs, values as a whole, and its history, which can be looked at."""
    side = json.loads(spark.read.text(f"{path}/grid").first()[0])
    classes = {n: spark.read.parquet(f"{path}/classes/{i}") for i, n in enumerate(side["classes"])}
    pairs = {tuple(k): spark.read.parquet(f"{path}/pairs/{i}") for i, k in enumerate(side["pairs"])}
    return GridFrame(GridMeta(**side["meta"]), spark.read.parquet(f"{path}/cells"), classes, pairs, side["globals"], tuple(side["history"]), frozenset(side["binary"]))


def read_ascii(spark: SparkSession, path: str, name: str = "values", group: bool = False) -> GridFrame:
    """An Arc/Info ASCII grid (header lines of key and value, then a line for each row), read whole: one file's text is a row.

    group: the layer gets a class table of its values.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.trim("value"), "\\r?\\n")).alias("k", "line")).select("k", F.split(F.trim("line"), "\\s+").alias("p")).filter("p[0] <> ''")
    named = F.col("p")[0].rlike("^[A-Za-z]")
    head = {r["p"][0].lower(): float(r["p"][1]) for r in lines.filter(named).limit(20).collect()}
    size, none = head["cellsize"], head.get("nodata_value")
    xmin, ymin = (head.get(f"{a}llcorner", head.get(f"{a}llcenter", 0) - size / 2) for a in "xy")
    ncol, nrow = int(head["ncols"]), int(head["nrows"])
    value = F.col("x").try_cast("double")
    cells = lines.filter(~named).select((F.col("k") - len(head)).cast("int").alias("r"), F.posexplode("p").alias("c", "x"))
    g = GridFrame(GridMeta(xmin, xmin + size * ncol, ymin, ymin + size * nrow, ncol, nrow), cells.select("r", "c", (F.nullif(value, F.lit(none)) if none is not None else value).alias(name)))
    return grouped(g, name) if group else g


def grouped(g: GridFrame, layer: str | None = None) -> GridFrame:
    """The layer's values as classes: a class table of each value and its name."""
    layer = g.pick(layer)
    v = g.values(layer).filter("v is not null").select("v").distinct()
    if v.filter("v <> floor(v)").limit(1).count():
        raise ValueError("classes have whole numbers")
    return replace(g, classes=g.classes | {layer: v.select(F.col("v").cast("int").alias("gid"), F.col("v").cast("long").cast("string").alias("val"))})


def from_table(spark: SparkSession, meta: GridMeta, cells, group: bool = False) -> GridFrame:
    """A grid from a DataFrame of r, c and layers, with rows for all cells.  group: its layers' values are classes."""
    g = GridFrame(meta, cells)
    for name in g.names if group else ():
        g = grouped(g, name)
    return g
