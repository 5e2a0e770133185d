"""Table profiling and chart tables (A-1..A-9, A-27..A-29, C-1..C-4).

Rule: one aggregate per table for all columns, then an unpivot of the one
result row; top-k reports run on aggregated counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.functions.text import key_digest
from clusterlens.operators.quantiles import quantiles


def _unpivot_row(row_df: DataFrame, cols, fields) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{f}").alias(f) for f in fields])
                      for c in cols])
    return row_df.select(F.explode(items).alias("s")).select("s.*")


def null_distinct_profile(df: DataFrame, cols=None, approx: bool = False, missing_share=0.3,
                          cardinality_share=0.2) -> DataFrame:
    """A-1, A-2, A-7, A-8: null and distinct counts per column with the share flags. NaN is one value."""
    cols = list(cols or df.columns)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}__null_count") for c in cols]
    if approx:
        row = df.agg(F.count(F.lit(1)).alias("_n"), *nulls,
                     *[F.approx_count_distinct(c).alias(f"{c}__distinct_count") for c in cols])
    else:
        # distinct values of all columns in one pass over (column, 128-bit digest); values themselves are not shuffled
        row = df.agg(F.count(F.lit(1)).alias("_n"), *nulls)
        seen = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("c"), *key_digest([F.col(c)]))) for i, c in enumerate(cols)])
        found = df.select(F.explode(F.filter(seen, lambda x: x.isNotNull())).alias("s")).select("s.*").groupBy("c", "d1", "d2").agg(F.lit(1)) \
            .agg(*[F.count_if(F.col("c") == i).alias(f"{c}__distinct_count") for i, c in enumerate(cols)])
        row = row.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one")  # one row with one row
    n = F.greatest(F.col("rows"), F.lit(1))
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__null_count").alias("null_count"),
                               F.col(f"{c}__distinct_count").alias("distinct_count")) for c in cols])
    out = row.select(F.col("_n").alias("rows"), F.explode(items).alias("s")).select("rows", "s.*")
    return out.select("column", "rows", "null_count", F.col("distinct_count").cast("long").alias("distinct_count"),
                      (F.col("null_count") / n > missing_share).alias("high_missing"),
                      (F.col("distinct_count") / n > cardinality_share).alias("high_cardinality"))


def top_missing(profile: DataFrame, n: int = 15) -> DataFrame:
    """C-3: the ``n`` columns with the most nulls of a profile, ties by name, with their share and place."""
    order = Window.orderBy(F.desc("null_count"), "column")  # one row for each column of the table
    return profile.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        "rank", "column", "null_count", (F.col("null_count") / F.greatest("rows", F.lit(1))).alias("null_share"))


def duplicate_key_count(df: DataFrame, key: str) -> DataFrame:
    """A-3: rows after the first of each key (NULL keys form one group)."""
    return (df.select(*key_digest([F.col(key)])).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def numeric_summary(df: DataFrame, cols, method: str = "exact") -> DataFrame:
    """A-4: count, mean, std (ddof 1, one row -> 0), min, median (exact or approx), max."""
    cols = list(cols)
    row = df.agg(*[a for c in cols for a in (
        F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
        F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(F.lit(0.0)).alias(f"{c}__std"),
        F.min(F.col(c).cast("double")).alias(f"{c}__min"), F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    long = _unpivot_row(row, cols, ["count", "mean", "std", "min", "max"]).where(F.col("count") > 0)
    med = quantiles(df, cols, [0.5], method=method).select("column", F.col("value").alias("median"))
    return long.join(med, "column", "left").select("column", "count", "mean", "std", "min", "median", "max")


def top_values(df: DataFrame, cols, n: int = 10, missing: str = "missing") -> DataFrame:
    """A-5 / A-29: top-n counts per column, NULL as 'missing', ties by value."""
    items = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in cols])
    counts = (df.select(F.explode(items).alias("s")).select("s.*")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_tags(df: DataFrame, col: str, delimiter: str = ",", n: int = 20) -> DataFrame:
    """A-6: split raw multi-label text, trim, drop empty, count, top n."""
    import re
    tags = F.explode(F.split(F.coalesce(F.col(col), F.lit("")), re.escape(delimiter)))
    counts = (df.select(tags.alias("tag")).select(F.trim("tag").alias("tag")).where(F.col("tag") != "")
              .groupBy("tag").agg(F.count(F.lit(1)).alias("count")))
    # distributed top-k (per-partition top n, then merge), ranked on the n survivors
    top = counts.orderBy(F.col("count").desc(), F.col("tag")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("tag"))))


def histogram(df: DataFrame, cols, bins: int = 30) -> DataFrame:
    """A-27: equal-width bins between min and max, last bin closed; only non-empty bins. Values that are not finite
    have no bin and do not count for the range."""
    cols = list(cols)
    inf = float("inf")
    finite = lambda c: F.when((F.col(c).cast("double") > -inf) & (F.col(c).cast("double") < inf), F.col(c).cast("double"))
    stats = df.agg(*[a for c in cols for a in (F.min(finite(c)).alias(f"{c}__lo"),
                                               F.max(finite(c)).alias(f"{c}__hi"))]).first()
    parts = []
    for c in cols:
        lo, hi = stats[f"{c}__lo"], stats[f"{c}__hi"]
        if lo is None:
            continue
        x = finite(c)
        width = (hi - lo) / bins if hi > lo else 0.0
        b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)) if hi > lo else F.lit(0)
        parts.append(F.struct(F.lit(c).alias("column"), F.when(x.isNotNull(), b.cast("int")).alias("bin"),
                              F.lit(float(lo)).alias("lo"), F.lit(float(width)).alias("width")))
    long = df.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where(F.col("bin").isNotNull())
    out = long.groupBy("column", "bin", "lo", "width").agg(F.count(F.lit(1)).alias("count"))
    return out.select("column", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
                      (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "count")


def correlation(df: DataFrame, cols) -> DataFrame:
    """A-28: pairwise-complete Pearson matrix; undefined (constant column) -> 0."""
    cols = list(cols)
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
            both = xa.isNotNull() & xb.isNotNull()
            aggs += [F.covar_pop(xa, xb).alias(f"{a}|{b}__cov"),
                     F.stddev_pop(F.when(both, xa)).alias(f"{a}|{b}__sa"),
                     F.stddev_pop(F.when(both, xb)).alias(f"{a}|{b}__sb")]
    row = df.agg(*aggs)
    items = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            k = f"{a}|{b}"
            den = F.col(f"`{k}__sa`") * F.col(f"`{k}__sb`")
            r = F.coalesce(F.col(f"`{k}__cov`") / F.nullif(den, F.lit(0.0)), F.lit(0.0))
            items.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("corr")))
            if a != b:
                items.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), r.alias("corr")))
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")
