"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: With it the shuffle files of a query go when the query ends, not when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if driver and executors are one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; Hadoop removes it when the application ends."""
    path = f"{shared_dir(spark)}/gridframe/{tag}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder: cuts lineage, survives lost executors and frees its shuffle files."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    with setting(spark, CLEANUP, "true"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _ranges(df: DataFrame, by: str) -> DataFrame:
    """df dealt out by ranges of a column, stored with each row's range: a driver-sized number of them, whatever their rows."""
    return stored(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """The sum of `value` up to each row in the order of a unique column: ranges of it are summed, then added up side by side."""
    cut = _ranges(df, by)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_range").agg(F.sum(value).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a range
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_inside", inside).join(starts, "_range").select(*df.columns, (F.col("_start") + F.col("_inside")).alias(out))


#: Rows that one task numbers.
FEW_ROWS = 100_000


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """Numbers rows from 1 in the order of a unique column.  Few rows are left to one task."""
    known = stored(df, "numbered")
    if known.count() <= FEW_ROWS:
        return known.withColumn(out, F.row_number().over(Window.orderBy(by)).cast("long"))
    return running(known.withColumn("_one", F.lit(1)), by, "_one", out).withColumn(out, F.col(out).cast("long")).drop("_one")
