"""Registration helpers shared by the query catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame query and, when SQL-expressible, its DuckDB twin."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (and -0.0 -> 0.0) so engines agree on printed values."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), places) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def tbl(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(report: DataFrame, *held: DataFrame) -> DataFrame:
    """A report of a few rows for each cluster as a local table; the tables kept for it are released."""
    try:
        return report.sparkSession.createDataFrame(report.collect(), report.schema)
    finally:
        for df in held:
            df.unpersist()
