"""Shared pieces of the training-data operators: tables in the shared folder, row numbers, joins of hot keys, ranks and components."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.plans.graph import components
from gridframe.plans.storage import CLEANUP, drop_path, new_path, setting, shared_dir, stored

__all__ = ["CHUNKS", "CLEANUP", "components", "drop_path", "field_name", "new_path", "ranked", "setting", "shared_dir", "spread", "steady", "stored", "table", "with_row_id"]

#: Hash chunks that a group is dealt into when its rows are numbered.
CHUNKS = 1024
#: Files of a table whose rows are numbered, at most: their paths are broadcast.
MOST_FILES = 200_000
#: Keys that a join broadcasts at most, and the rows from which a key counts as hot.
MOST_HOT, LEAST_HOT = 50_000, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field_name(df: DataFrame, wanted: str) -> str:
    """A column name based on `wanted` that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def steady(df: DataFrame) -> DataFrame:
    """df if it is a plain scan of files (columns chosen, rows filtered), else its rows stored: what with_row_id numbers."""
    nodes = [df._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in ("LogicalRelation", "Project", "Filter", "SubqueryAlias") and not node.nodeName().startswith("Relation"):
            return stored(df, "rows")
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return df


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a unique long to a steady table, the same in every scan of it: the file's number in the order of their paths, and the row in the file.

    It doesn't depend on how a scan is cut into tasks.  The paths of at most MOST_FILES files are broadcast.
    """
    files = sorted(re.sub(r"^(\w+):///", r"\1:/", f) for f in df.inputFiles())  # as the scan writes them
    if len(files) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files; write the table in larger ones")
    file, number = field_name(df, "_file"), field_name(df, "_number")
    at = df.metadataColumn("_metadata")
    placed = df.select("*", at["file_path"].alias(file), at["row_index"].alias(name))
    numbers = df.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], f"`{file}` string, `{number}` long")
    known = F.coalesce(F.col(number), F.raise_error(F.concat(F.lit("unknown file "), F.col(file))).cast("long"))
    return placed.join(F.broadcast(numbers), file, "left").withColumn(name, known + F.col(name)).drop(file, number)


def spread(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined to table, which has one row a key and in `n` how many of the rows have it; no key gathers in one task.

    Keys of many rows are broadcast: each holds at least a MOST_HOT-th of all rows, so there are at most MOST_HOT.
    The others are joined by a shuffle.  Both inputs have to be stored.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    least = max(LEAST_HOT, -(-total // MOST_HOT))
    hot, other = table.filter(F.col(n) >= least), table.filter(F.col(n) < least)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(other, keys, how))


def ranked(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], out: str) -> DataFrame:
    """Numbers the rows of each group from 0 without gathering a group in one task.

    `chunk` deals a group's rows into pieces (at most CHUNKS of them); a row's number is the rows in lower
    chunks plus its place in its own chunk by `order`.  df has to be stored or deterministic.
    """
    cut_, place_, n_, start_ = (field_name(df, x) for x in ("_chunk", "_place", "_n", "_start"))
    cut = df.withColumn(cut_, chunk)
    counts = cut.groupBy(*keys, cut_).agg(F.count(F.lit(1)).alias(n_))
    before = Window.partitionBy(*keys).orderBy(cut_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, cut_, F.coalesce(F.sum(n_).over(before), F.lit(0)).alias(start_))
    place = F.row_number().over(Window.partitionBy(*keys, cut_).orderBy(*order)) - 1
    on = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys] + [F.col(f"l.{cut_}") == F.col(f"r.{cut_}")]
    joined = cut.withColumn(place_, place).alias("l").join(starts.alias("r"), on)
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col(f"r.{start_}") + F.col(f"l.{place_}")).cast("long").alias(out))
