"""Records whose fields differ from row to row, as VARIANT (U-3, A-30): union, aggregation by type, fields back.

A search writes one record for each fit. Families and versions of models have different metrics, so a record is one
VARIANT value; what becomes of a field over several records follows from the type its values have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMERIC = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def as_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns and ``record``: all other columns as one VARIANT. NULL fields stay, as nulls."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return df.select(*[F.col(f"`{k}`") for k in keys],
                     F.parse_json(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("record"))


def from_dicts(spark: SparkSession, rows: list[tuple], key_schema: str) -> DataFrame:
    """Keys and JSON text of a record, as the driver has them after a fit."""
    return spark.createDataFrame(rows, f"{key_schema}, record string").withColumn("record", F.parse_json("record"))


def union_records(*parts: DataFrame) -> DataFrame:
    """U-3: records of different shapes under each other; a field that a part lacks is absent there, not null."""
    return reduce(DataFrame.unionByName, parts)


def fields(records: DataFrame) -> DataFrame:
    """Long form: all columns but ``record``, then ``key``, ``value`` (VARIANT) and ``kind`` (its type)."""
    keys = [F.col(f"`{c}`") for c in records.columns if c != "record"]
    spark = records.sparkSession
    return records.lateralJoin(spark.tvf.variant_explode(F.col("record").outer())).select(
        *keys, "key", "value", F.schema_of_variant("value").alias("kind"))


def _is_numeric(kind: Column) -> Column:
    return kind.isin(*_NUMERIC) | kind.startswith("DECIMAL")


def aggregate_records(records: DataFrame, by: list[str]) -> DataFrame:
    """A-30: one record for each ``by``: numbers become mean and ``<key>_std`` (population, if there are two or more),
    booleans their conjunction, other values stay if all are equal and go if they differ. A field that is null
    everywhere stays null; nulls among numbers are left out.
    """
    x = fields(records)
    kind = F.col("kind")
    void, flag = kind == "VOID", kind == "BOOLEAN"
    text = F.to_json("value")
    numeric = _is_numeric(kind) | flag | void
    number = F.when(_is_numeric(kind) | flag, F.try_variant_get("value", "$", "double"))
    found = x.groupBy(*by, "key").agg(
        F.bool_or(numeric).alias("numeric"), F.count_if(~void).alias("n"), F.count_if(flag).alias("flags"),
        F.bool_and(F.when(flag, F.try_variant_get("value", "$", "boolean"))).alias("all"), F.avg(number).alias("mean"),
        F.stddev_pop(number).alias("std"), F.min(text).alias("lo"), F.max(text).alias("hi"))
    name = F.to_json(F.array("key"))
    quoted = F.substr(name, F.lit(2), F.length(name) - 2)
    number_of = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    bare = lambda c: F.regexp_extract(number_of(c), r'^\{"v":(.*)\}$', 1)
    pair = lambda k, v: F.concat(k, F.lit(":"), v)
    std_name = F.concat(F.expr("substr(to_json(array(key)), 2, length(to_json(array(key))) - 3)"), F.lit('_std"'))
    parts = (F.when(F.col("numeric") & (F.col("n") == 0), F.array(pair(quoted, F.lit("null"))))
             .when(F.col("numeric") & (F.col("flags") == F.col("n")), F.array(pair(quoted, F.col("all").cast("string"))))
             .when(F.col("numeric") & (F.col("n") > 1), F.array(pair(quoted, bare("mean")), pair(std_name, bare("std"))))
             .when(F.col("numeric"), F.array(pair(quoted, bare("mean"))))
             .when(F.col("lo") == F.col("hi"), F.array(pair(quoted, F.col("lo")))).otherwise(F.array().cast("array<string>")))
    return found.groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list(parts))).alias("p")).select(
        *by, F.parse_json(F.concat(F.lit("{"), F.array_join("p", ","), F.lit("}"))).alias("record"))


def columns_of(records: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The other columns and the named fields as typed columns; NULL where a record lacks one or it has another type."""
    keys = [F.col(f"`{c}`") for c in records.columns if c != "record"]
    return records.select(*keys, *[F.try_variant_get("record", f"$['{k}']", t).alias(k) for k, t in schema.items()])
