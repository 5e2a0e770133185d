"""Sources and sinks (S-1..S-13).

CSV is read with an explicit all-string schema (no inference pass); values
are typed later by the clean step with ``try_cast``. Parquet is the matrix,
model and report format: a vector column keyed by id replaces ``.npy``
files and positional row mappings. ``write_stage`` makes a stage resumable: its
output is reused only if a commit mark says that it is whole and made from the
same files, schema and parameters.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.functions.text import collapse_ws, snake_case

__all__ = [
    "read_table", "read_csv", "read_any", "write_table", "write_stage", "fingerprint", "validate_columns", "rename_snake",
    "normalize_strings", "ingest", "schema_summary", "select_present", "PANDAS_NA_TOKENS",
]

SUPPORTED = ("csv", "parquet", "json")

# The words a pandas CSV reader turns into missing values by default.
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                    "nan", "null"]


def _fmt(path: str, fmt: str | None) -> str:
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in SUPPORTED:
        raise ValueError(f"Unsupported format {fmt!r} for {path}; expected one of {SUPPORTED}")
    return fmt


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one test table (column pruning / pushdown by Catalyst)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
             na_tokens=PANDAS_NA_TOKENS, multi_line: bool = True) -> DataFrame:
    """CSV with doubled-quote escapes, every column as string.

    ``columns`` gives the header; when omitted, only the header line is read to
    build the all-string schema (one small job, never ``inferSchema``). A file whose fields may hold line ends is one
    task; ``multi_line=False`` lets files without such fields be split.
    """
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"'}
    if columns is None:
        columns = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    df = spark.read.schema(schema).options(**options).csv(path)
    if na_tokens:
        toks = list(na_tokens)
        df = df.select(*[F.when(~F.col(c).isin(toks), F.col(c)).alias(c) for c in df.columns])
    return df


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = _fmt(path, fmt)
    return read_csv(spark, path) if fmt == "csv" else spark.read.json(path) if fmt == "json" else spark.read.parquet(path)


def _lookup(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _is_whole(spark: SparkSession, path: str) -> bool:
    """Whether the folder's last write ended well: writers leave ``_SUCCESS`` only then."""
    fs, p = _lookup(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(p)


def write_table(df: DataFrame, path: str, fmt: str | None = None, overwrite: bool = False) -> str:
    """Parquet / CSV / JSON-lines sink. ``overwrite=False`` leaves existing output alone (skip-if-exists); what a failed
    write left behind is no output and is written again."""
    fmt = _fmt(path, fmt)
    if not overwrite and _is_whole(df.sparkSession, path):
        return path
    if fmt == "csv":
        complex_cols = [f.name for f in df.schema.fields
                        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        df = df.select(*[F.to_json(c).alias(c) if c in complex_cols else F.col(c) for c in df.columns])
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def _files(spark: SparkSession, paths: list[str]) -> dict:
    """How many files there are and one digest of their names, lengths and times; the listing stays in Spark."""
    if not paths:
        return {"files": 0, "digest": "0"}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    row = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38, 0)")).alias("d")).first()
    return {"files": row["n"], "digest": str(row["d"] or 0)}


def fingerprint(df: DataFrame, params: dict | None = None, inputs: list[str] | None = None) -> str:
    """What a stage's output depends on: its input files (those of ``df`` unless given), its schema, its parameters."""
    paths = sorted(df.inputFiles()) if inputs is None else list(inputs)
    parts = {"inputs": _files(df.sparkSession, paths), "schema": json.loads(df.schema.json()), "params": params or {}}
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def write_stage(df: DataFrame, path: str, params: dict | None = None, inputs: list[str] | None = None,
                fmt: str | None = None, overwrite: bool = False) -> DataFrame:
    """S-13: write a stage's output unless it is there already, and return it as read back.

    Beside the output, ``<path>.commit`` holds a fingerprint of inputs, schema and parameters, and a digest of the
    files written. Output is reused only if both still agree: a write that failed, files that were lost or changed, new
    input or other parameters all lead to a new write. ``params`` must name what the plan itself does not show.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    mark = f"{path}.commit"
    wanted = fingerprint(df, params, inputs)
    if not overwrite and _is_whole(spark, mark) and _is_whole(spark, path):
        held = json.loads(spark.read.text(mark, wholetext=True).first()[0])
        if held == {"fingerprint": wanted, "output": _files(spark, [path])}:
            return read_any(spark, path, fmt)
    # no mark while the output is being replaced
    fs, p = _lookup(spark, mark)
    fs.delete(p, True)
    write_table(df, path, fmt, overwrite=True)
    done = json.dumps({"fingerprint": wanted, "output": _files(spark, [path])})
    spark.createDataFrame([(done,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return read_any(spark, path, fmt)


def validate_columns(df: DataFrame, required) -> None:
    """Every required name must be a column; the error lists those that are not, in order."""
    absent = sorted(set(required) - set(df.columns), key=list(required).index)
    if absent:
        raise ValueError("the table lacks the columns " + ", ".join(absent))


def rename_snake(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    mapping = {snake_case(c): c for c in df.columns}
    return df.toDF(*[snake_case(c) for c in df.columns]), mapping


def normalize_strings(df: DataFrame) -> DataFrame:
    """Collapse whitespace and trim on every string column, one projection."""
    return df.select(*[collapse_ws(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def ingest(df: DataFrame, required=()) -> tuple[DataFrame, dict[str, str]]:
    """Required-column check (original spelling), snake_case rename, string normalisation."""
    validate_columns(df, required)
    renamed, mapping = rename_snake(df)
    return normalize_strings(renamed), mapping


def schema_summary(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """S-10 / A-9: (column, original, dtype, rows) of each column; ``mapping`` is what ``ingest`` gives."""
    mapping = mapping or {}
    items = [F.struct(F.lit(c).alias("column"), F.lit(mapping.get(c, c)).alias("original"), F.lit(t).alias("dtype")) for c, t in df.dtypes]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(*items)), "rows")


def select_present(df: DataFrame, wanted) -> DataFrame:
    """S-12: the wanted columns that the table has, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])
