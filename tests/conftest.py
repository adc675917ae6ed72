import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """compare(query, sql, sf_dir): the same columns and rows in Spark and DuckDB."""
    import glob
    import os

    import duckdb

    def norm(v):
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)

    def run(query, sql, sf_dir):
        con = duckdb.connect()
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
        df, rel = query(spark, sf_dir), con.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(rel.columns)
        at = [rel.columns.index(c) for c in names]
        assert sorted(tuple(norm(r[c]) for c in names) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())

    return run
