import numpy as np
import pandas as pd

from clusterlens.operators import mixture as MX


def _blobs(spark, n=600, d=3, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [6, 6, 0], [0, 7, 7]], dtype=float)[:, :d]
    lab = rng.integers(0, 3, n)
    X = centres[lab] + rng.normal(0, [0.5, 1.0, 0.7][:d], (n, d))
    pdf = pd.DataFrame({"id": np.arange(n), "x": list(X)})
    return spark.createDataFrame(pdf), X, lab


def _numpy_lloyd(X, C, iters):
    for _ in range(iters):
        lab = ((X[:, None, :] - C[None]) ** 2).sum(-1).argmin(1)
        C = np.array([X[lab == j].mean(0) if (lab == j).any() else C[j] for j in range(len(C))])
    return C


def test_multi_model_lloyd_matches_numpy(spark):
    df, X, _ = _blobs(spark)
    m = MX.Matrix.of(df, "x", "id")
    starts = {0: X[[0, 1, 2]], 1: X[[5, 10, 20, 30]]}
    fits = {i: MX.KMeansFit(len(c), seed=i) for i, c in starts.items()}
    MX.kmeans_many(m, fits, max_iter=4, tol=-1.0, init_centres=starts)
    for i, c in starts.items():
        ref = _numpy_lloyd(X, c.copy(), 4)
        np.testing.assert_allclose(fits[i].centres + m.shift, ref, atol=1e-8)
        assert fits[i].sizes.sum() == len(X)
    m.release()


def test_gmm_em_recovers_blobs_and_lower_bound_rises(spark):
    df, X, lab = _blobs(spark)
    m = MX.Matrix.of(df, "x", "id")
    fits = {0: MX.GMMFit(3, "diag", seed=1), 1: MX.GMMFit(3, "full", seed=1)}
    MX.gmm_many(m, fits, max_iter=50, tol=1e-4)
    for f in fits.values():
        assert np.all(np.diff(f.history) > -1e-9)  # EM never decreases the bound
        assert sorted(np.round(np.sort(f.weights), 1)) == sorted(np.round(np.sort(np.bincount(lab) / len(lab)), 1))
    m.release()


def test_sharded_scans_give_the_same_statistics(spark):
    df, X, _ = _blobs(spark)
    m = MX.Matrix.of(df, "x", "id")
    starts = {i: X[[i, i + 1, i + 2]] for i in range(6)}
    a = {i: MX.KMeansFit(3, seed=i) for i in starts}
    b = {i: MX.KMeansFit(3, seed=i) for i in starts}
    MX.kmeans_many(m, a, max_iter=3, tol=-1.0, init_centres=starts)
    old = MX.SHARD_BYTES
    MX.SHARD_BYTES = 1  # one model per scan
    try:
        assert len(list(MX._shards({i: f for i, f in enumerate(range(4))}, 1))) == 4
        MX.kmeans_many(m, b, max_iter=3, tol=-1.0, init_centres=starts)
    finally:
        MX.SHARD_BYTES = old
    for i in starts:
        assert abs(a[i].inertia - b[i].inertia) < 1e-9
    m.release()


def test_stacked_diag_estep_matches_per_model(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 4))
    params = {}
    for m in range(3):
        k = 2 + m
        w = rng.dirichlet(np.ones(k))
        means = rng.normal(size=(k, 4))
        covs = rng.uniform(0.5, 2.0, size=(k, 4))
        params[m] = ("soft", w, means, MX._prec_chol(covs, "diag"), "diag")
    stacked = MX._em_scan(X, None, params)
    for m, p in params.items():
        resp, lse = MX._estep(X, p[1:])
        nk, sx, sxx = MX._suff(X, resp, "diag")
        hard = np.bincount(resp.argmax(1), minlength=resp.shape[1]).astype(float)
        ref = np.concatenate([[lse.sum(), resp.max(1).sum()], nk, sx.ravel(), sxx.ravel(), hard])
        np.testing.assert_allclose(stacked[m], ref, rtol=1e-9, atol=1e-9)


def test_model_tables_survive_parquet(spark, tmp_path):
    from clusterlens.operators import models as MOD
    from clusterlens.sources import io

    df, X, lab = _blobs(spark)
    means = np.array([X[lab == j].mean(0) for j in range(3)])
    full = np.array([np.cov(X[lab == j].T) for j in range(3)])
    fitted = {
        "full": {"kind": "gmm", "cov_type": "full", "covs": full, "means": means, "weights": np.array([0.2, 0.3, 0.5]),
                 "converged": True, "n_iter": 7, "lower_bound": -3.5},
        "diag": {"kind": "gmm", "cov_type": "diag", "covs": np.array([np.diag(c) for c in full]), "means": means,
                 "weights": np.array([0.2, 0.3, 0.5])},
        "kmeans": {"kind": "kmeans", "centres": means, "inertia": 12.0}}
    for name, model in fitted.items():
        path = io.write_table(MOD.model_table(spark, model), str(tmp_path / f"{name}.parquet"))
        back = MOD.model_from_table(spark.read.parquet(path))
        assert set(back) - {"k"} == set(model) and back["k"] == 3
        for key, value in model.items():
            assert np.array_equal(back[key], value), (name, key)
        a, b = (MX.assign(df, "x", "id", m).orderBy("id").toPandas() for m in (model, back))
        assert a["cluster"].equals(b["cluster"])


def test_empty_model_table_is_refused(spark):
    import pytest
    from clusterlens.operators import models as MOD

    with pytest.raises(ValueError):
        MOD.model_from_table(spark.createDataFrame([], MOD._MODEL_SCHEMA))
