"""Per-cluster value distributions with lift against the whole table (P-1, P-2, J-4, W-4).

Plan shape: one partial-aggregated ``groupBy(cluster, value).count()`` over
the rows; cluster sizes come from a second partial aggregate (k rows); global
value counts are re-aggregated from the (cluster, value) table, so the row
data is never joined or windowed. The top-n window runs on the aggregated
table only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _tags_or_missing(tags, missing: str):
    """Array of trimmed tags; empty item -> missing; null/empty array -> [missing]."""
    t = F.transform(F.coalesce(tags, F.array().cast("array<string>")),
                    lambda x: F.when(F.trim(x) == "", F.lit(missing)).otherwise(F.trim(x)))
    return F.when(F.size(t) == 0, F.array(F.lit(missing))).otherwise(t)


def distribution_lift(df: DataFrame, cluster_col: str, value_col: str | None = None, *, tags=None,
                      top_n: int | None = 5, missing: str = "missing", keep_missing: bool = True) -> DataFrame:
    """(cluster, value, count, cluster_share, global_share, lift_vs_global, rank).

    ``value_col`` for a single-valued column (NULL -> ``missing``); ``tags`` (an
    array column) for a multi-label column, where shares are per row, not per tag.
    """
    cluster = F.col(cluster_col).alias("cluster")
    if tags is None:
        pairs = df.select(cluster, F.coalesce(F.col(value_col).cast("string"), F.lit(missing)).alias("value"))
    else:
        pairs = df.select(cluster, F.explode(_tags_or_missing(tags, missing)).alias("value"))
        if not keep_missing:
            pairs = pairs.where(F.col("value") != missing)
    counts = pairs.groupBy("cluster", "value").agg(F.count(F.lit(1)).alias("count"))
    if tags is None:  # one value per row: cluster sizes follow from the aggregated counts
        sizes = counts.groupBy("cluster").agg(F.sum("count").alias("n_c"))
    else:  # shares are per row, not per tag
        sizes = df.select(cluster).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_c"))
    sizes = sizes.withColumn("n_total", F.sum("n_c").over(Window.partitionBy()))
    glob = counts.groupBy("value").agg(F.sum("count").alias("g"))
    out = (counts.join(sizes, counts["cluster"].eqNullSafe(sizes["cluster"]), "inner").drop(sizes["cluster"])
           .join(glob, "value", "left")
           .select("cluster", "value", "count",
                   (F.col("count") / F.col("n_c")).alias("cluster_share"),
                   (F.coalesce(F.col("g"), F.lit(0)) / F.col("n_total")).alias("global_share")))
    out = out.withColumn("lift_vs_global",
                         F.when(F.col("global_share") > 0, F.col("cluster_share") / F.col("global_share")))
    w = Window.partitionBy("cluster").orderBy(F.col("count").desc(), F.col("value").asc())
    out = out.withColumn("rank", F.row_number().over(w))
    if top_n is not None:
        out = out.where(F.col("rank") <= top_n)
    return out


def category_lift(df, cluster_col, value_col, top_n=5, missing="missing"):
    """P-1: categorical distribution per cluster, top 5 by count."""
    return distribution_lift(df, cluster_col, value_col, top_n=top_n, missing=missing)


def multilabel_lift(df, cluster_col, tags, top_n=8, missing="missing", keep_missing=True):
    """P-2: multi-label distribution per cluster, share denominator = rows, top 8."""
    return distribution_lift(df, cluster_col, tags=tags, top_n=top_n, missing=missing, keep_missing=keep_missing)
