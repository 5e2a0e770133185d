"""Helpers shared by the text operators: column handling, stored intermediate tables, native span arithmetic."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in the contracts (space, tab to carriage return).
SPACE_CLASS = r"\x20\x09-\x0D"
_BLOCK = 256


def _once(df: DataFrame, keep: list[str], cols: dict[str, Column]) -> DataFrame:
    """Columns that the plan computes once for each row, in the order given.

    Without a barrier the optimiser would move a later filter or projection below them and substitute their
    expressions, also into lambdas, where an array would be computed again for each element of another. A one-element
    ``inline`` is such a barrier and costs no shuffle.
    """
    names = {k: f"__once_{i}" for i, k in enumerate(cols)}
    early = df.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(names[k]) for k, v in cols.items()])
    return early.select(*[F.col(f"`{c}`") for c in keep],
                        F.inline(F.array(F.struct(*[F.col(n).alias(k) for k, n in names.items()]))))


def attach(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with computed columns; an input column of the same name (in any case) is replaced."""
    taken = {c.lower() for c in cols}
    return _once(df, [c for c in df.columns if c.lower() not in taken], cols)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` as the session or ``setCheckpointDir`` names it.

    Where neither is set, a scratch folder in local mode; on a cluster that would be one machine's, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="clusterlens-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Bytes of one Arrow batch while tables are stored: what a task holds at a time on either side of a Python worker.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_BYTES (and a row) while the block runs."""
    old = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if old is None else spark.conf.set(_BATCH, old)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Cuts lineage: what follows reads files that outlive any executor. The name is fresh for each call.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clusterlens-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-white-space; null text counts 0."""
    return F.regexp_count(text_or_empty(text), F.lit(f"[^{SPACE_CLASS}]++")).cast("long")


def exclusive_sums(lengths: Column) -> Column:
    """Running sums before each element of an array<bigint>, in blocks so that long arrays cost O(n) copies per block."""
    block = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    local = F.transform(block, lambda b: F.aggregate(b, zero, grow))
    offsets = F.aggregate(F.transform(local, lambda b: F.element_at(b, -1)), zero, grow)
    sums = F.flatten(F.zip_with(local, F.slice(offsets, 1, F.size(local)),
                                lambda b, o: F.transform(F.slice(b, 1, F.size(b) - 1), lambda v: v + o)))
    return F.when(F.size(lengths) > 0, sums).otherwise(F.array().cast("array<bigint>"))


HIT_TYPE = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"


def regex_hits(text: Column, pattern: str, context: int = 24, needs: Column | None = None) -> Column:
    """All matches of a pattern that never matches empty text, leftmost and non-overlapping, with positions.

    Positions are code points, end exclusive. ``before`` and ``after`` hold up to ``context`` characters between
    the match and its neighbours. Built from the matches and the pieces between them, so it stays in the JVM.
    ``needs`` may give a cheaper condition that holds for every text with a match; texts without it are not searched.
    """
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(pieces, 1, F.size(hits)), lambda p: F.length(p).cast("long"))
    lens = F.zip_with(gaps, hits, lambda g, h: g + F.length(h))
    rows = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("p"), hits.alias("h"),
                     F.slice(pieces, 2, F.size(hits)).alias("q"), exclusive_sums(lens).alias("o")),
        lambda z: F.struct(
            (z["o"] + F.length(z["p"])).alias("start"),
            (z["o"] + F.length(z["p"]) + F.length(z["h"])).alias("end"),
            z["h"].alias("hit"), F.right(z["p"], F.lit(context)).alias("before"),
            F.left(z["q"], F.lit(context)).alias("after")))
    found = F.rlike(text, F.lit(pattern))
    return F.when(found if needs is None else needs & found, rows).otherwise(F.array().cast(HIT_TYPE))


SPAN_TYPE = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def as_spans(hits: Column, rank: int, kind: str) -> Column:
    return F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), h["end"].alias("end")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def staged(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add helper columns (their names start with ``__``)."""
    return _once(df, df.columns, cols)
