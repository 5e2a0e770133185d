"""Estimator adapters and registry (X-2, X-3, X-4), final fit (M-20), diagnostics (M-22..M-24).

An adapter turns a persisted ``Matrix`` plus parameters into a fitted model
dict (parameters in original coordinates) that ``mixture.assign`` can score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.operators import mixture as MX
from clusterlens.operators import select as SEL

TRAINING = {
    "gmm": {"max_iter": 300, "tol": 1e-3, "reg_covar": 1e-6, "n_init": 5, "covariance_type": "full"},
    "kmeans": {"max_iter": 500, "tol": 1e-4, "n_init": 20},
}


class Adapter:
    """X-2: what a search and a final fit need of a model family. A model is a dict of parameters in original coordinates."""

    family: str
    scoring: list

    def selection_candidates(self, candidate_k, cov_types=("diag", "full")) -> list[dict]:
        return SEL.candidates(self.family, candidate_k, cov_types)

    def search(self, matrix: MX.Matrix, candidate_k, seeds, **kw):
        return SEL.search(matrix, self.family, candidate_k, seeds=seeds, **kw)

    def fit_candidate(self, matrix: MX.Matrix, params: dict, seed: int) -> tuple[dict, dict]:
        """A fitted model and the record of its metrics for one seed."""
        kw = {k: params[k] for k in ("n_init", "max_iter", "tol") if k in params}
        cov = {"cov_types": (params["covariance_type"],)} if self.family == "gmm" else {}
        _, record, _ = SEL.search(matrix, self.family, [params["k"]], seeds=(seed,), **cov, **kw)
        return self.fit(matrix, params, seed), record

    def pick_best_params(self, ranked: DataFrame) -> dict:
        row = ranked.orderBy("selection_rank").first().asDict()
        return {c: row[c] for c in ("k", "covariance_type") if row.get(c) is not None}

    def best_row(self, ranked: DataFrame, params: dict) -> dict:
        return SEL.best_row(ranked, params).first().asDict()

    def fit(self, matrix: MX.Matrix, params: dict, seed: int) -> dict:
        raise NotImplementedError

    def predict(self, model: dict, df: DataFrame, vec_col: str, id_col) -> DataFrame:
        return MX.assign(df, vec_col, id_col, model)

    def diagnostics(self, spark, model: dict, n_rows: int, d: int, **kw) -> DataFrame:
        return diagnostics(spark, model, n_rows, d, **kw)


class GMMAdapter(Adapter):
    family, scoring = "gmm", SEL.GMM_SCORING

    def fit(self, matrix: MX.Matrix, params: dict, seed: int) -> dict:
        fits = {i: MX.GMMFit(int(params["k"]), params["covariance_type"], seed * 7919 + i,
                             reg=params.get("reg_covar", 1e-6)) for i in range(int(params.get("n_init", 1)))}
        MX.gmm_many(matrix, fits, max_iter=int(params.get("max_iter", 300)), tol=float(params.get("tol", 1e-3)))
        f = max(fits.values(), key=lambda x: x.lower_bound)
        return {"kind": "gmm", "weights": f.weights, "means": f.means + matrix.shift, "covs": f.covs,
                "cov_type": f.cov_type, "converged": f.converged, "n_iter": f.n_iter,
                "lower_bound": f.lower_bound, "k": f.k}


class KMeansAdapter(Adapter):
    family, scoring = "kmeans", SEL.KMEANS_SCORING

    def fit(self, matrix: MX.Matrix, params: dict, seed: int) -> dict:
        fits = {i: MX.KMeansFit(int(params["k"]), seed * 7919 + i) for i in range(int(params.get("n_init", 1)))}
        MX.kmeans_many(matrix, fits, max_iter=int(params.get("max_iter", 300)), tol=float(params.get("tol", 1e-4)))
        f = min(fits.values(), key=lambda x: x.inertia)
        sizes = np.asarray(f.sizes, float)
        return {"kind": "kmeans", "centres": f.centres + matrix.shift, "weights": sizes / sizes.sum(),
                "inertia": f.inertia, "converged": f.converged, "n_iter": f.n_iter, "k": f.k}


# X-3: name -> adapter; the reduced variants are the same estimators on the PCA matrix (X-4)
REGISTRY = {"gmm": GMMAdapter, "gmm_reduced": GMMAdapter, "kmeans_reduced": KMeansAdapter}


def get_adapter(name: str):
    if name not in REGISTRY:
        raise ValueError(f"Unknown model {name!r}; available: {sorted(REGISTRY)}")
    return REGISTRY[name]()


def diagnostics(spark, model: dict, n_rows: int, d: int, close_threshold: float = 0.5, near_zero: float = 0.01,
                assigned: DataFrame | None = None, low_confidence: float = 0.5, high_entropy: float = 1.0) -> DataFrame:
    """M-22 / M-23: per-component parameters plus health checks, from the k-row parameter table; with the ``assigned``
    rows also the shares of rows with low confidence and with high entropy, over all rows and per component."""
    w = np.asarray(model["weights"], float)
    means = np.asarray(model["means"] if model["kind"] == "gmm" else model["centres"], float)
    k = len(w)
    if model["kind"] == "gmm":
        covs = np.asarray(model["covs"])
        if model["cov_type"] == "diag":
            cov_ok = [bool(np.all(c > 0)) for c in covs]
        else:
            cov_ok = []
            for c in covs:
                try:
                    np.linalg.cholesky(c)
                    cov_ok.append(True)
                except np.linalg.LinAlgError:
                    cov_ok.append(False)
    else:
        cov_ok = [True] * k
    D = np.sqrt(((means[:, None] - means[None]) ** 2).sum(-1))
    close_pairs = int(((D < close_threshold) & np.triu(np.ones((k, k), bool), 1)).sum())
    rows = [(j, float(w[j]), float(np.linalg.norm(means[j])), cov_ok[j]) for j in range(k)]
    comp = spark.createDataFrame(rows, "component int, weight double, mean_norm double, covariance_valid boolean")
    if assigned is not None:
        low, high = F.col("max_probability") < low_confidence, F.col("assignment_entropy") > high_entropy
        share = lambda c: F.avg(c.cast("double"))
        per = assigned.groupBy(F.col("cluster").alias("component")).agg(
            F.avg("assignment_entropy").alias("mean_entropy"), share(low).alias("low_confidence_share"), share(high).alias("high_entropy_share"))
        total = assigned.agg(share(low).alias("low_confidence_total"), share(high).alias("high_entropy_total"), F.lit(1).alias("_one"))
        comp = comp.join(per, "component", "left").withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")
    return comp.select(
        "*", F.lit(float(w.min())).alias("smallest_weight"),
        F.lit(int((w < near_zero).sum())).alias("near_zero_weights"),
        F.lit(close_pairs).alias("close_mean_pairs"),
        F.lit(n_rows >= max(10 * d, 5 * k)).alias("enough_rows"),
        F.lit(bool(model.get("converged"))).alias("converged"),
        F.lit(int(model.get("n_iter", 0))).alias("n_iter"))


def training_summary(spark, model: dict, params: dict, n_rows: int, d: int, run_id: str = "") -> DataFrame:
    """M-24: one-row training record."""
    rec = {"run_id": run_id, "model_kind": model["kind"], "k": int(model["k"]),
           "covariance_type": model.get("cov_type"), "rows": int(n_rows), "dims": int(d),
           "converged": bool(model.get("converged")), "n_iter": int(model.get("n_iter", 0)),
           "lower_bound": float(model["lower_bound"]) if model.get("lower_bound") is not None else None,
           "inertia": float(model["inertia"]) if model.get("inertia") is not None else None,
           "n_init": int(params.get("n_init", 1)), "max_iter": int(params.get("max_iter", 0))}
    schema = ("run_id string, model_kind string, k int, covariance_type string, rows long, dims int, "
              "converged boolean, n_iter int, lower_bound double, inertia double, n_init int, max_iter int")
    return spark.createDataFrame([tuple(rec.values())], schema)


_MODEL_SCHEMA = ("component int, model_kind string, covariance_type string, weight double, mean array<double>, "
                 "covariance array<double>, converged boolean, n_iter int, lower_bound double, inertia double")


def model_table(spark: SparkSession, model: dict) -> DataFrame:
    """S-8 / M-22: the parameters of a fitted model, one row per component; any sink of ``sources.io`` but CSV keeps it.

    ``mean`` is the component's mean or centre. ``covariance`` is its variances (diagonal) or its matrix row by row
    (full), and null for K-means. Unknown weights and fit scalars are null.
    """
    gmm = model["kind"] == "gmm"
    means = np.asarray(model["means"] if gmm else model["centres"], float)
    weights = model.get("weights")
    optional = lambda key, kind: None if model.get(key) is None else kind(model[key])
    fit = (optional("converged", bool), optional("n_iter", int), optional("lower_bound", float),
           optional("inertia", float))
    rows = [(j, model["kind"], model.get("cov_type"), None if weights is None else float(weights[j]), mean.tolist(),
             np.ravel(model["covs"][j]).astype(float).tolist() if gmm else None, *fit)
            for j, mean in enumerate(means)]
    return spark.createDataFrame(rows, _MODEL_SCHEMA)


def model_from_table(table: DataFrame) -> dict:
    """The model that ``model_table`` wrote, ready for ``mixture.assign``; collects one row per component."""
    rows = table.orderBy("component").collect()
    if not rows:
        raise ValueError("the model table has no components")
    first = rows[0]
    means = np.array([r["mean"] for r in rows])
    model = {"kind": first["model_kind"], "k": len(rows), "converged": first["converged"], "n_iter": first["n_iter"],
             "lower_bound": first["lower_bound"], "inertia": first["inertia"]}
    model = {key: value for key, value in model.items() if value is not None}
    if first["weight"] is not None:
        model["weights"] = np.array([r["weight"] for r in rows])
    if first["model_kind"] == "kmeans":
        return {**model, "centres": means}
    covs = np.array([r["covariance"] for r in rows])
    if first["covariance_type"] == "full":
        covs = covs.reshape(len(rows), means.shape[1], means.shape[1])
    return {**model, "means": means, "covs": covs, "cov_type": first["covariance_type"]}
