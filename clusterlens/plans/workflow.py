"""Composition of the model operators (plain function calls on DataFrames).

``model_stage``: search -> final fit -> assign -> diagnostics; ``final_metrics`` and ``distribution_report`` describe its
clusters. The data stages before it are in ``plans.stages``. Each step returns DataFrames; writing them (``sources.io``) is
the caller's choice. The feature matrix is persisted once for the iterative stages and released after them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.operators import evaluate as EV
from clusterlens.operators import lift as L
from clusterlens.operators import metrics as M
from clusterlens.operators import mixture as MX
from clusterlens.operators import models as MOD
from clusterlens.operators import pca as PCA
from clusterlens.operators import select as SEL


def metadata_join(assigned: DataFrame, meta: DataFrame, keys) -> DataFrame:
    """J-1: left join assignments to metadata on the key columns, NULL keys matching NULL keys."""
    m = meta.select(*[F.col(k).alias(f"__m_{k}") for k in keys], *[c for c in meta.columns if c not in keys])
    cond = None
    for k in keys:
        c = assigned[k].eqNullSafe(m[f"__m_{k}"])
        cond = c if cond is None else cond & c
    return assigned.join(m, cond, "left").drop(*[f"__m_{k}" for k in keys])


def reduce_matrix(matrix: DataFrame, id_col, target: float | int = 0.9, features: str = "features", svd_solver: str = "auto"):
    """PCA stage: returns (reduced DataFrame[id..., pc], fitted PCA)."""
    with MX.Matrix.of(matrix, features, id_col) as m:
        model = PCA.fit(m, target, svd_solver=svd_solver)
    return PCA.transform(matrix, features, id_col, model), model


def model_stage(matrix: DataFrame, id_col, model_name: str = "gmm", features: str = "features",
                candidate_k=range(2, 13), seeds=(42, 43, 44, 45, 46), search_kw: dict | None = None,
                final_override: dict | None = None, seed: int = 42):
    """Search, final fit with parameter precedence (M-20), assignment and diagnostics."""
    adapter = MOD.get_adapter(model_name)
    # candidates inherit the training settings (n_init, max_iter, tol, reg_covar) unless overridden
    train = MOD.TRAINING[adapter.family]
    kw = {k: train[k] for k in ("n_init", "max_iter", "tol", "reg_covar") if k in train}
    kw.update(search_kw or {})
    m = MX.Matrix.of(matrix, features, id_col)
    try:
        ranked, best, warnings = adapter.search(m, candidate_k, seeds, **kw)
        params = SEL.final_params(best, MOD.TRAINING[adapter.family], final_override)
        model = adapter.fit(m, params, seed)
        diag = MOD.diagnostics(matrix.sparkSession, model, m.n, m.d)
    finally:
        m.release()
    assigned = MX.assign(matrix, features, id_col, model)
    return {"ranked": ranked, "best": best, "warnings": warnings, "params": params, "model": model,
            "assignments": assigned, "diagnostics": diag}


#: Fields of a search's best record that the final record repeats, and their names there.
_FROM_SELECTION = {"bic": "bic", "aic": "aic", "log_likelihood": "average_log_likelihood", "inertia": "inertia",
                   "stability_ari_mean": "stability_ari_mean", "stability_nmi_mean": "stability_nmi_mean"}


def final_metrics(assigned: DataFrame, matrix: DataFrame, id_col, features: str = "features", k: int | None = None,
                  best: dict | None = None, scoring=None, type_records: DataFrame | None = None,
                  source_records: DataFrame | None = None, warn_share: float = 0.8) -> DataFrame:
    """P-7: one lazy row of size statistics and distribution, confidence summary, quality metrics, what the search found
    for the chosen candidate (``best``), its scoring metrics in order, and the dominance of types and sources."""
    keys = MX.key_columns(id_col)
    x = matrix.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keys)], features)
    same = None
    for i, c in enumerate(keys):
        e = assigned[c].eqNullSafe(x[f"_{i}"])
        same = e if same is None else same & e
    feats = assigned.select(*keys, "cluster").join(x, same).select("cluster", features)
    sizes = EV.cluster_sizes(assigned, "cluster", k)
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(sizes.agg(F.array_sort(F.collect_list(F.struct("cluster", "size", "proportion"))).alias("cluster_size_distribution"),
                        F.min("size").alias("min_cluster_size"), F.max("size").alias("max_cluster_size"),
                        F.avg("size").alias("mean_cluster_size")))
    parts = [EV.assignment_summary(assigned), M.silhouette(feats, features, "cluster").select("silhouette"),
             M.davies_bouldin(feats, features, "cluster"), M.calinski_harabasz(feats, features, "cluster")]
    for records, name in ((type_records, "type"), (source_records, "source")):
        if records is not None:
            parts.append(EV.share_dominance(records, warn_share).toDF(f"mean_top_{name}_share", f"dominated_clusters_by_{name}"))
    for p in parts:
        out = out.join(one(p), "_one")
    chosen = [F.lit(best[c]).cast("double").alias(name) for c, name in _FROM_SELECTION.items() if c in (best or {})]
    named = [F.lit(scoring[i][0] if i < len(scoring) else None).cast("string").alias(f"selection_metric_{n}")
             for i, n in enumerate(("primary", "secondary", "tertiary"))] if scoring else []
    return out.select(*named, *[c for c in out.columns if c != "_one"], *chosen)


def distribution_report(meta_assigned: DataFrame, tags_col, categorical, numeric=(), name_col: str | None = None,
                        type_col: str | None = None, source_col: str | None = None, warn_share: float = 0.8) -> DataFrame:
    """P-6: nested report, one row per cluster: size, proportion, label, examples, dominance, an array of distribution
    records for the tags (``genres``) and each categorical column, numeric summaries, and the strongest numeric shifts.

    ``type_col`` and ``source_col`` (categorical columns; the first two by default) give label and dominance; examples
    need ``name_col`` and the confidence columns of an assignment. Sections without input are left out.
    """
    tags = F.col(tags_col) if isinstance(tags_col, str) else tags_col
    categorical = list(categorical)
    type_col = type_col or (categorical[0] if categorical else None)
    source_col = source_col or (categorical[1] if len(categorical) > 1 else None)
    records = {"genres": L.multilabel_lift(meta_assigned, "cluster", tags, 8)}
    records.update({c: L.category_lift(meta_assigned, "cluster", c, 5) for c in categorical})
    out = EV.cluster_sizes(meta_assigned, "cluster")
    if type_col:
        source = records.get(source_col)
        out = EV._beside(out, EV.interpretation_labels(records["genres"], records[type_col], source, meta_assigned.select("cluster")))
        signals = EV.dominance(records[type_col], source, warn_share)
        out = EV._beside(out, signals.select("cluster", F.struct(*signals.columns[1:]).alias("dominance_signals")))
    if name_col and {"max_probability", "assignment_entropy"} <= set(meta_assigned.columns):
        out = EV._beside(out, EV.examples(meta_assigned, "cluster", name_col))
    for name, rec in records.items():
        out = EV._beside(out, rec.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct(
            "rank", "value", "count", "cluster_share", "global_share", "lift_vs_global"))).alias(name)))
    if numeric:
        num = EV.cluster_numeric(meta_assigned, "cluster", list(numeric))
        out = EV._beside(out, num.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct(
            "column", "n", "mean", "median", "p25", "p75", "std", "z_score_vs_global"))).alias("numeric_distributions")))
        out = EV._beside(out, EV._ranked_list(EV.top_z_features(num, 4), "rank", "column", "top_numeric_features_by_z_score"))
    return out
