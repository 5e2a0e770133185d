"""Model search and selection (M-15..M-20, K-1, A-30, M-16..M-18, J-8).

All candidate x seed x init fits run together in the multi-model engine. Two more scans over all rows score every
chosen fit: the first adds up cluster sizes, means, norms and distances (Davies-Bouldin) and the contingency cells of
each pair of seeds (stability ARI / NMI), the second the squared-Euclidean silhouettes. Only such sums leave the
tasks. Each fit gives a VARIANT record (``operators.records``); seed aggregation, guardrails, ranking and the summary are
DataFrame operations on these.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.operators import mixture as MX
from clusterlens.operators import records as REC
from clusterlens.operators.metrics import ari_nmi_from_table, row_silhouettes

GUARDRAILS = {"reject_smallest_cluster_below": 0.005, "warn_smallest_cluster_below": 0.01, "tiny_cluster_threshold": 0.01,
              "reject_if_degenerate": True, "stability_warn_below": 0.6}
_COMMON = {"smallest_cluster_proportion": "double", "largest_cluster_proportion": "double", "tiny_cluster_count": "double",
           "n_iter": "double", "converged": "boolean", "degenerate_component": "boolean", "silhouette": "double"}
KMEANS_FIELDS = {**_COMMON, "inertia": "double", "davies_bouldin": "double", "calinski_harabasz": "double"}
GMM_FIELDS = {**_COMMON, "bic": "double", "aic": "double", "log_likelihood": "double", "lower_bound": "double",
              "mean_max_responsibility": "double"}
_STABILITY = ("candidate int, stability_ari_mean double, stability_ari_std double, stability_nmi_mean double, "
              "stability_nmi_std double")
KMEANS_SCORING = [("silhouette", "max"), ("davies_bouldin", "min"), ("inertia", "min")]
GMM_SCORING = [("bic", "min"), ("aic", "min")]


def seed_sequence(base_seed: int = 42, n_seeds: int = 5, seed_stride: int = 1) -> list[int]:
    """M-16: the seeds of a stability search; one seed switches stability off."""
    return [base_seed + i * seed_stride for i in range(n_seeds)]


def candidates(family: str, candidate_k, cov_types=("diag", "full")):
    """M-15: the candidate grid."""
    if family == "kmeans":
        return [{"k": int(k)} for k in candidate_k]
    return [{"k": int(k), "covariance_type": c} for k in candidate_k for c in cov_types]


def _labels(X, params):
    """Label of each row and its squared distance to the own centre (0 for mixtures)."""
    if params[0] == "kmeans":
        D = MX._sq_dists(X, params[1])
        lab = D.argmin(1)
        return lab, D[np.arange(len(X)), lab]
    return MX._estep(X, params[1:])[0].argmax(1), np.zeros(len(X))


def _blocks(X, rows: int = 2048):
    for start in range(0, len(X), rows):
        yield X[start:start + rows]


def _label_stats(X, ids, payload):
    """For each candidate, one vector over its seeds: sizes, sums, squared norms and distances of each cluster, then
    the contingency cells of every pair of seeds. Nothing of the rows leaves the scan."""
    out = {}
    for ci, fits in payload.items():
        k, d = fits[0][0], X.shape[1]
        stats = np.zeros((len(fits), k, d + 3))
        pairs = list(itertools.combinations(range(len(fits)), 2))
        cells = np.zeros((len(pairs), k * k))
        for Xb in _blocks(X):
            labs = []
            for i, (_, params) in enumerate(fits):
                lab, d2 = _labels(Xb, params)
                onehot = (lab[:, None] == np.arange(k)[None, :]).astype(float)
                stats[i, :, 0] += onehot.sum(0)
                stats[i, :, 1:d + 1] += onehot.T @ Xb
                stats[i, :, d + 1] += onehot.T @ (Xb * Xb).sum(1)
                stats[i, :, d + 2] += onehot.T @ np.sqrt(d2)
                labs.append(lab)
            for p, (a, b) in enumerate(pairs):
                cells[p] += np.bincount(labs[a] * k + labs[b], minlength=k * k)
        out[ci] = np.concatenate([stats.ravel(), cells.ravel()])
    return out


def _silhouette_sums(X, ids, payload):
    """For each candidate, the sum of the rows' silhouettes under each seed."""
    out = {}
    for ci, fits in payload.items():
        total = np.zeros(len(fits))
        for Xb in _blocks(X):
            for i, (_, params, means, norms, sizes) in enumerate(fits):
                total[i] += row_silhouettes(Xb, _labels(Xb, params)[0], means, norms, sizes).sum()
        out[ci] = total
    return out


def search(matrix: MX.Matrix, family: str = "kmeans", candidate_k=range(2, 13), cov_types=("diag", "full"),
           seeds=(42, 43, 44, 45, 46), n_init: int = 1, max_iter: int = 300, tol: float | None = None,
           reg_covar: float = 1e-6, guardrails: dict | None = None, scoring=None):
    """Fit every candidate for every seed; return (ranked candidate DataFrame, best params, warnings DataFrame)."""
    spark = matrix.df.sparkSession
    g = {**GUARDRAILS, **(guardrails or {})}
    scoring = scoring or (KMEANS_SCORING if family == "kmeans" else GMM_SCORING)
    cands = candidates(family, candidate_k, cov_types)
    fits, owner = {}, {}
    mid = 0
    for ci, c in enumerate(cands):
        for s in seeds:
            for init in range(n_init):
                seed = s * 7919 + init
                fits[mid] = (MX.KMeansFit(c["k"], seed) if family == "kmeans"
                             else MX.GMMFit(c["k"], c["covariance_type"], seed, reg=reg_covar))
                owner[mid] = (ci, s)
                mid += 1
    if family == "kmeans":
        MX.kmeans_many(matrix, fits, max_iter=max_iter, tol=1e-4 if tol is None else tol)
        best_of = lambda f: -f.inertia
    else:
        MX.gmm_many(matrix, fits, max_iter=max_iter, tol=1e-3 if tol is None else tol)
        best_of = lambda f: f.lower_bound
    chosen = {}
    for m, f in fits.items():
        key = owner[m]
        if key not in chosen or best_of(f) > best_of(chosen[key]):
            chosen[key] = f

    # one scan for sizes, spread and the seeds' agreement, one for the silhouettes; both over all rows
    payload = {}
    for ci in range(len(cands)):
        own = []
        for seed in seeds:
            f = chosen[(ci, seed)]
            own.append((f.k, ("kmeans", f.centres) if family == "kmeans" else
                        ("gmm", f.weights, f.means, MX._prec_chol(f.covs, f.cov_type), f.cov_type)))
        payload[ci] = own
    sil_by_fit, spread, stab, second = {}, {}, {}, {}
    for ci, v in MX._reduce(matrix, _label_stats, payload).items():
        k, m = payload[ci][0][0], len(seeds)
        stats = v[:m * k * (matrix.d + 3)].reshape(m, k, matrix.d + 3)
        size = np.maximum(stats[:, :, 0], 1.0)
        for i, seed in enumerate(seeds):
            spread[(ci, seed)] = stats[i, :, -1] / size[i]
        second[ci] = [(*payload[ci][i], stats[i, :, 1:-2] / size[i][:, None], stats[i, :, -2] / size[i], stats[i, :, 0])
                      for i in range(m)]
        for cells in v[m * k * (matrix.d + 3):].reshape(-1, k, k):
            cells = cells[cells.sum(1) > 0][:, cells.sum(0) > 0]
            stab.setdefault(ci, []).append(ari_nmi_from_table(cells))
    for ci, v in MX._reduce(matrix, _silhouette_sums, second).items():
        for i, seed in enumerate(seeds):
            if (second[ci][i][4] > 0).sum() > 1:
                sil_by_fit[(ci, seed)] = float(v[i] / matrix.n)

    n = matrix.n
    recs = []
    for (ci, s), f in chosen.items():
        sizes = np.asarray(f.sizes, dtype=float)
        k = f.k
        rec = {"candidate": ci, "seed": int(s), "k": k,
               "covariance_type": cands[ci].get("covariance_type"),
               "smallest_cluster_proportion": float(sizes.min() / n),
               "largest_cluster_proportion": float(sizes.max() / n),
               "tiny_cluster_count": int((sizes / n < g["tiny_cluster_threshold"]).sum()),
               "cluster_size_distribution": [{"cluster": j, "count": int(c), "proportion": float(c / n)} for j, c in enumerate(sizes)],
               "n_iter": int(f.n_iter), "converged": bool(f.converged),
               "silhouette": sil_by_fit.get((ci, s))}
        if family == "kmeans":
            rec["degenerate_component"] = bool((sizes == 0).any())
            rec["inertia"] = float(f.inertia)
            C = f.centres
            sp = spread[(ci, s)]
            D = np.sqrt(((C[:, None] - C[None]) ** 2).sum(-1))
            with np.errstate(divide="ignore", invalid="ignore"):
                R = (sp[:, None] + sp[None]) / D
            R[~np.isfinite(R)] = 0.0
            np.fill_diagonal(R, 0.0)
            rec["davies_bouldin"] = float(R.max(1).mean()) if k > 1 else None
            # rows are about the global mean, so the centres' squared norms are the spread between clusters
            means = second[ci][list(seeds).index(s)][2]
            between = float((sizes * (means ** 2).sum(1)).sum())
            rec["calinski_harabasz"] = None if k < 2 or n <= k else 1.0 if f.inertia == 0 else between * (n - k) / (f.inertia * (k - 1))
        else:
            bic, aic = MX.bic_aic(f.log_likelihood, n, k, matrix.d, f.cov_type)
            rec.update({"degenerate_component": bool((f.weights < 1e-4).any()), "bic": float(bic), "aic": float(aic),
                        "log_likelihood": float(f.log_likelihood), "lower_bound": float(f.lower_bound),
                        "mean_max_responsibility": float(f.mean_max_resp)})
        recs.append(rec)
    keys = ("candidate", "seed", "k", "covariance_type")
    rows = [(*[r[c] for c in keys], json.dumps({c: v for c, v in r.items() if c not in keys})) for r in recs]
    per_seed = REC.from_dicts(spark, rows, "candidate int, seed int, k int, covariance_type string")
    table = seed_aggregate(per_seed, KMEANS_FIELDS if family == "kmeans" else GMM_FIELDS)
    st_rows = [(ci, *[float(x) for v in zip(*pairs) for x in (np.mean(v), np.std(v))]) for ci, pairs in stab.items()]
    table = table.join(spark.createDataFrame(st_rows, _STABILITY), "candidate", "left")
    ranked = rank(guard(table, g), scoring)
    ranked = spark.createDataFrame(ranked.collect(), ranked.schema)  # a row for each candidate of the grid
    best = ranked.orderBy("selection_rank").first().asDict()
    return ranked, best, warnings(ranked, g)


def seed_aggregate(per_seed: DataFrame, schema: dict) -> DataFrame:
    """A-30: the records of one candidate over its seeds, as columns of ``schema`` with ``<field>_std`` of the numbers.

    ``per_seed``: candidate, seed, k, covariance_type, record. Adds ``degenerate_any_seed``, ``seed_count``,
    ``seed_values`` and ``random_seed`` (the first), and the sizes of the clusters where all seeds agree on them.
    """
    by = ["candidate", "k", "covariance_type"]
    wanted = {}
    for c, t in schema.items():
        wanted[c] = t
        if t == "double":
            wanted[f"{c}_std"] = t
    merged = REC.columns_of(REC.aggregate_records(per_seed, by), wanted)
    seeds = per_seed.groupBy(*by).agg(
        F.bool_or(F.try_variant_get("record", "$.degenerate_component", "boolean")).alias("degenerate_any_seed"),
        F.count(F.lit(1)).cast("int").alias("seed_count"), F.array_sort(F.collect_list("seed")).alias("seed_values"),
        F.min("seed").alias("random_seed"))
    same = [merged[c].eqNullSafe(seeds[c]) for c in by]
    return merged.join(seeds, same[0] & same[1] & same[2]).drop(*[seeds[c] for c in by])


def guard(table: DataFrame, g: dict = GUARDRAILS) -> DataFrame:
    """M-17: guardrail flags; missing stability counts as 1.0."""
    return (table.withColumn("passes_size_guardrail",
                             F.col("smallest_cluster_proportion") >= g["reject_smallest_cluster_below"])
            .withColumn("passes_degenerate_guardrail",
                        ~F.col("degenerate_component") | F.lit(not g["reject_if_degenerate"]))
            .withColumn("passes_stability_guardrail",
                        F.coalesce("stability_ari_mean", F.lit(1.0)) >= g["stability_warn_below"])
            .withColumn("selection_valid", F.col("passes_size_guardrail") & F.col("passes_degenerate_guardrail")))


def rank(table: DataFrame, scoring) -> DataFrame:
    """K-1: valid first, stable first, then the scoring metrics (nulls last), then stability ARI desc."""
    order = [F.col("selection_valid").desc(), F.col("passes_stability_guardrail").desc()]
    for c, mode in scoring:
        order.append(F.col(c).asc_nulls_last() if mode == "min" else F.col(c).desc_nulls_last())
    order += [F.coalesce("stability_ari_mean", F.lit(-1.0)).desc(), F.col("k").asc()]
    return table.withColumn("selection_rank", F.row_number().over(Window.orderBy(*order)))  # candidate grid only


def best_row(ranked: DataFrame, params: dict) -> DataFrame:
    """J-8: the first row, by rank, in which all ``params`` that are columns have their values; else the first row."""
    fits = F.lit(True)
    for c, v in params.items():
        if c in ranked.columns:
            fits = fits & F.col(c).eqNullSafe(F.lit(v))
    return ranked.orderBy(F.desc(fits), "selection_rank").limit(1)


def selection_summary(ranked: DataFrame, scoring, params: dict | None = None) -> DataFrame:
    """M-19: one row: the scoring metrics in order, counts of candidates and of valid ones, and the best row's parameters."""
    top = best_row(ranked, params or {}).select(F.col("k").alias("best_k"), F.col("covariance_type").alias("best_covariance_type"),
                                                F.col("selection_rank").alias("best_rank"), F.col("selection_valid").alias("best_valid"),
                                                *[F.col(c).alias(f"best_{c}") for c, _ in scoring], F.lit(1).alias("_one"))
    counts = ranked.agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if("selection_valid").alias("valid_candidate_count"),
                        F.lit(1).alias("_one"))
    names = [F.lit(scoring[i][0] if i < len(scoring) else None).cast("string").alias(f"selection_metric_{n}")
             for i, n in enumerate(("primary", "secondary", "tertiary"))]
    return counts.join(top, "_one", "left").select(*names, "candidate_count", "valid_candidate_count", *top.columns[:-1])


def warnings(ranked: DataFrame, g: dict = GUARDRAILS) -> DataFrame:
    """M-18: long (candidate, k, covariance_type, kind, value, message) warnings table."""
    value = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    items = F.array(
        F.when(F.col("degenerate_component"), value("degenerate", F.lit(1.0))),
        F.when(F.col("smallest_cluster_proportion") < g["warn_smallest_cluster_below"], value("imbalance", F.col("smallest_cluster_proportion"))),
        F.when(F.col("stability_ari_mean") < g["stability_warn_below"], value("low_stability", F.col("stability_ari_mean"))))
    at = F.concat(F.lit("k="), F.col("k").cast("string"), F.coalesce(F.concat(F.lit(" cov="), F.col("covariance_type")), F.lit("")))
    shown = F.format_string("%.4f", F.col("w.value"))
    message = (F.when(F.col("w.kind") == "degenerate", F.concat(F.lit("degenerate component for "), at))
               .when(F.col("w.kind") == "imbalance", F.concat(F.lit("smallest cluster share "), shown, F.lit(" for "), at))
               .otherwise(F.concat(F.lit("mean ARI "), shown, F.lit(" between seeds for "), at)))
    return (ranked.select("candidate", "k", "covariance_type", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("w"))
            .select("candidate", "k", "covariance_type", "w.kind", "w.value", message.alias("message")))


def final_params(best: dict, training: dict | None = None, override: dict | None = None) -> dict:
    """M-20: training defaults <- best candidate params <- explicit final override (non-null)."""
    out = dict(training or {})
    out.update({k: v for k, v in best.items() if k in ("k", "covariance_type") and v is not None})
    out.update({k: v for k, v in (override or {}).items() if v is not None})
    return out

