"""Cluster profiling (A-21..A-26, K-2, K-3, K-5, W-3, P-3..P-7).

Every per-cluster statistic is one ``groupBy(cluster)`` with partial
aggregation; quantiles use the exact two-pass plan (no per-group value maps). Top-n-per-cluster uses ``row_number() <= n``, which Spark plans with a
map-side WindowGroupLimit, so a hot cluster is cut to n rows per partition
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.operators.quantiles import exact_quantiles, quantiles


def cluster_sizes(assigned: DataFrame, cluster_col: str = "cluster", k: int | None = None) -> DataFrame:
    """A-21 / M-14: size and proportion per cluster; with ``k`` empty clusters appear with 0."""
    sizes = assigned.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    if k is not None:
        ids = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
        sizes = ids.join(sizes, "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).alias("size"))
    total = F.sum("size").over(Window.partitionBy())  # over the k-row table
    return sizes.select("cluster", "size", (F.col("size") / total).alias("proportion"))


def cluster_numeric(df: DataFrame, cluster_col: str, cols, method: str = "exact") -> DataFrame:
    """A-23 / A-24: per (cluster, column) mean, median, p25, p75, std (ddof 1; n=1 -> 0) and z vs global."""
    cols = list(cols)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(F.col(cluster_col).alias("cluster"), F.explode(items).alias("s")).select(
        "cluster", "s.column", "s.v")
    per = long.groupBy("cluster", "column").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"),
        F.when(F.count("v") > 1, F.stddev_samp("v")).otherwise(F.lit(0.0)).alias("std"))
    glob = long.groupBy("column").agg(F.avg("v").alias("g_mean"),
                                      F.coalesce(F.nullif(F.stddev_samp("v"), F.lit(0.0)), F.lit(1.0)).alias("g_std"))
    q = quantiles(df.withColumn("cluster", F.col(cluster_col)), cols, [0.25, 0.5, 0.75], by=["cluster"], method=method)
    qw = q.groupBy("cluster", "column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    qw = qw.toDF("cluster", "column", "p25", "median", "p75")
    out = (per.where(F.col("n") > 0).join(glob, "column")
           .join(qw, ["cluster", "column"], "left")
           .select("cluster", "column", "n", "mean", "median", "p25", "p75", "std",
                   ((F.col("mean") - F.col("g_mean")) / F.col("g_std")).alias("z_score_vs_global")))
    return out


def cluster_zheat(df: DataFrame, cluster_col: str, cols) -> DataFrame:
    """A-25: cluster means z-scored across clusters (population std, 0 -> 1)."""
    means = df.groupBy(F.col(cluster_col).alias("cluster")).agg(*[F.avg(c).alias(c) for c in cols])
    w = Window.partitionBy()  # over the k-row means table
    zs = means.select("cluster", *[((F.col(c) - F.avg(c).over(w)) /
                                    F.coalesce(F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(1.0))).alias(c)
                                   for c in cols])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("z")) for c in cols])
    return zs.select("cluster", F.explode(items).alias("s")).select("cluster", "s.column", "s.z")


def top_z_features(numeric: DataFrame, n: int = 4) -> DataFrame:
    """K-3: the n numeric columns with the largest |z| per cluster (ties by column name)."""
    w = Window.partitionBy("cluster").orderBy(F.abs("z_score_vs_global").desc(), F.col("column"))
    return (numeric.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("cluster", "column", "z_score_vs_global", "rank"))


def top_rows(assigned: DataFrame, cluster_col: str, order_col: str, id_col: str, n: int = 3) -> DataFrame:
    """K-2: n rows per cluster by ``order_col`` desc (ties by id); map-side group limit."""
    w = Window.partitionBy(cluster_col).orderBy(F.col(order_col).desc(), F.col(id_col))
    return assigned.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_per_group(counts: DataFrame, group_col: str, n: int) -> DataFrame:
    """W-3 on an aggregated (group, value, count) table."""
    w = Window.partitionBy(group_col).orderBy(F.col("count").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def overindexed(records: DataFrame, min_share: float, top_n: int) -> DataFrame:
    """K-5: records with share >= min_share and a lift, by (lift, share) desc, value asc; top n."""
    w = Window.partitionBy("cluster").orderBy(F.col("lift_vs_global").desc(), F.col("cluster_share").desc(),
                                              F.col("value"))
    kept = records.where((F.col("cluster_share") >= min_share) & F.col("lift_vs_global").isNotNull())
    return kept.withColumn("oi_rank", F.row_number().over(w)).where(F.col("oi_rank") <= top_n)


def _ranked_list(df: DataFrame, rank_col: str, value_col: str, name: str) -> DataFrame:
    return df.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(value_col).alias("v")))),
                    lambda s: s["v"]).alias(name))


def interpretation_labels(genre_records: DataFrame, type_records: DataFrame, source_records: DataFrame | None,
                          clusters: DataFrame) -> DataFrame:
    """P-3: over-indexed genres (2, share >= .08) + type (1, >= .15) + source (1, >= .12), first 4;
    else top 2 genres + top type; else 'cluster <id>'. Lists are bounded (<= 8 records per cluster)."""
    parts = [_ranked_list(overindexed(genre_records, 0.08, 2), "oi_rank", "value", "oi_g"),
             _ranked_list(overindexed(type_records, 0.15, 1), "oi_rank", "value", "oi_t")]
    if source_records is not None:
        parts.append(_ranked_list(overindexed(source_records, 0.12, 1), "oi_rank", "value", "oi_s"))
    parts += [_ranked_list(genre_records.where(F.col("rank") <= 2), "rank", "value", "top_g"),
              _ranked_list(type_records.where(F.col("rank") <= 1), "rank", "value", "top_t")]
    out = clusters.select("cluster").distinct()
    for p in parts:
        out = out.join(p, "cluster", "left")
    empty = F.array().cast("array<string>")
    bits = F.concat(F.coalesce(F.col("oi_g"), empty), F.coalesce(F.col("oi_t"), empty),
                    F.coalesce(F.col("oi_s"), empty) if source_records is not None else empty)
    fallback = F.concat(F.coalesce(F.col("top_g"), empty), F.coalesce(F.col("top_t"), empty))
    label = (F.when(F.size(bits) > 0, F.array_join(F.slice(bits, 1, 4), ", "))
             .when(F.size(fallback) > 0, F.array_join(fallback, ", "))
             .otherwise(F.concat(F.lit("cluster "), F.col("cluster").cast("string"))))
    return out.select("cluster", label.alias("interpretation_label"))


def examples(rows: DataFrame, cluster_col: str, name_col: str, n: int = 3) -> DataFrame:
    """K-2 as lists: cluster, ``representative`` (most certain names) and ``ambiguous`` (highest entropy), ties by name.

    Each list is cut to ``n`` rows a cluster before the shuffle.
    """
    def first(order: str, out: str) -> DataFrame:
        w = Window.partitionBy("cluster").orderBy(F.desc_nulls_last(order), F.col("name"))
        kept = rows.select(F.col(cluster_col).alias("cluster"), F.col(name_col).cast("string").alias("name"), order) \
            .withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
        return _ranked_list(kept, "r", "name", out)
    return _beside(first("max_probability", "representative"), first("assignment_entropy", "ambiguous"))


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two tables of one row per cluster; a NULL cluster is a cluster."""
    other = right.withColumnRenamed("cluster", "_c")
    return left.join(other, left["cluster"].eqNullSafe(other["_c"]), "left").drop("_c")


def dominance(type_records: DataFrame, source_records: DataFrame | None = None, warn_share: float = 0.8) -> DataFrame:
    """P-4: cluster, top_type_share, top_source_share and the warning that one of them explains the cluster."""
    top = lambda r, name: r.where(F.col("rank") == 1).select("cluster", F.col("cluster_share").alias(name))
    out = top(type_records, "top_type_share")
    out = out.withColumn("top_source_share", F.lit(0.0)) if source_records is None else _beside(out, top(source_records, "top_source_share"))
    out = out.select("cluster", F.coalesce("top_type_share", F.lit(0.0)).alias("top_type_share"),
                     F.coalesce("top_source_share", F.lit(0.0)).alias("top_source_share"))
    return out.withColumn("format_artifact_warning", (F.col("top_type_share") >= warn_share) | (F.col("top_source_share") >= warn_share))


def cluster_profile(sizes: DataFrame, genre_records: DataFrame, type_records: DataFrame, topz: DataFrame, labels: DataFrame,
                    warn_share: float = 0.8, source_records: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """P-4 / P-5: one row per cluster (k rows) joining the k-row frames; ``names`` is what ``examples`` gives."""
    g = _ranked_list(genre_records.where(F.col("rank") <= 5), "rank", "value", "top_genres")
    t = _ranked_list(type_records.where(F.col("rank") <= 3), "rank", "value", "top_types")
    z = _ranked_list(topz, "rank", "column", "top_numeric_features")
    out = sizes
    for part in (g, t, z, labels, dominance(type_records, source_records, warn_share), *([names] if names is not None else [])):
        out = _beside(out, part)
    shown = [F.array_join(c, ", ").alias(c) for c in ("representative", "ambiguous")] if names is not None else []
    return out.select("cluster", "size", "proportion", F.array_join("top_genres", ", ").alias("top_genres"),
                      F.array_join("top_types", ", ").alias("top_types"),
                      F.array_join("top_numeric_features", ", ").alias("top_numeric_features"), "interpretation_label", *shown,
                      F.coalesce("top_type_share", F.lit(0.0)).alias("top_type_share"),
                      F.coalesce("top_source_share", F.lit(0.0)).alias("top_source_share"),
                      F.coalesce("format_artifact_warning", F.lit(False)).alias("format_artifact_warning"))


def assignment_summary(assigned: DataFrame) -> DataFrame:
    """A-22 / A-32: confidence and entropy summary (exact medians), one lazy row."""
    base = assigned.agg(F.avg("max_probability").alias("mean_max_responsibility"),
                        F.avg("assignment_entropy").alias("assignment_entropy_mean"),
                        F.max("assignment_entropy").alias("assignment_entropy_max"),
                        F.avg((F.col("max_probability") < 0.5).cast("double")).alias("low_confidence_fraction"), F.lit(1).alias("_one"))
    med = exact_quantiles(assigned, ["max_probability", "assignment_entropy"], [0.5])
    of = lambda c: F.max(F.when(F.col("column") == c, F.col("value")))
    med = med.agg(of("max_probability").alias("median_max_responsibility"),
                  of("assignment_entropy").alias("assignment_entropy_median"), F.lit(1).alias("_one"))
    return base.join(med, "_one").drop("_one")


def share_dominance(type_records: DataFrame, warn_share: float = 0.8) -> DataFrame:
    """A-31: mean top-value share over clusters and the number of clusters whose top share >= warn_share."""
    top = type_records.where(F.col("rank") == 1)
    return top.agg(F.avg("cluster_share").alias("mean_top_share"),
                   F.count_if(F.col("cluster_share") >= warn_share).alias("dominated_clusters"))
