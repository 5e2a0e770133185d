"""Dense NumPy cross-checks of PCA, silhouette, Davies-Bouldin and Calinski-Harabasz on small fixtures."""

import numpy as np
import pandas as pd

from clusterlens.operators import metrics as M
from clusterlens.operators import mixture as MX
from clusterlens.operators import pca as PCA


def _frame(spark, n=120, d=4, k=3, seed=3):
    rng = np.random.default_rng(seed)
    lab = rng.integers(0, k, n)
    X = rng.normal(size=(n, d)) + lab[:, None] * 2.0
    pdf = pd.DataFrame({"id": np.arange(n), "x": list(X), "label": lab})
    return spark.createDataFrame(pdf), X, lab


def _silhouette(X, lab):
    D = ((X[:, None] - X[None]) ** 2).sum(-1)
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in np.unique(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_is_exact(spark):
    df, X, lab = _frame(spark)
    got = M.silhouette(df, "x", "label").first()
    assert got["rows"] == len(X)
    assert abs(got["silhouette"] - _silhouette(X, lab)) < 1e-9


def test_db_ch_match_numpy(spark):
    df, X, lab = _frame(spark)
    ks = np.unique(lab)
    C = np.array([X[lab == k].mean(0) for k in ks])
    s = np.array([np.sqrt(((X[lab == k] - C[j]) ** 2).sum(1)).mean() for j, k in enumerate(ks)])
    D = np.sqrt(((C[:, None] - C[None]) ** 2).sum(-1))
    R = (s[:, None] + s[None]) / np.where(D == 0, np.inf, D)
    np.fill_diagonal(R, 0)
    assert abs(M.davies_bouldin(df, "x", "label").first()[0] - R.max(1).mean()) < 1e-9
    n, k = len(X), len(ks)
    between = sum((lab == kk).sum() * ((C[j] - X.mean(0)) ** 2).sum() for j, kk in enumerate(ks))
    within = sum(((X[lab == kk] - C[j]) ** 2).sum() for j, kk in enumerate(ks))
    ch = between * (n - k) / (within * (k - 1))
    assert abs(M.calinski_harabasz(df, "x", "label").first()[0] - ch) / ch < 1e-9


def test_pca_matches_numpy_and_ratios_sum_to_one(spark):
    df, X, _ = _frame(spark, d=5)
    m = MX.Matrix.of(df, "x", "id")
    model = PCA.fit(m, None)
    m.release()
    ev = np.sort(np.linalg.eigvalsh(np.cov(X.T)))[::-1]
    np.testing.assert_allclose(model.explained_variance, ev, rtol=1e-9, atol=1e-12)
    assert abs(model.ratio.sum() - 1.0) < 1e-12
    # centred projection: component scores have zero mean and variance = eigenvalue
    pcs = np.array([r["pc"] for r in PCA.transform(df, "x", "id", model).orderBy("id").collect()])
    np.testing.assert_allclose(pcs.mean(0), 0.0, atol=1e-9)
    np.testing.assert_allclose(pcs.var(0, ddof=1), ev, rtol=1e-9)
    # sign rule: the largest |loading| of every component is positive
    assert all(c[np.abs(c).argmax()] > 0 for c in model.components)
    # variance target picks the smallest n whose cumulative ratio exceeds it
    m2 = MX.Matrix.of(df, "x", "id")
    n90 = PCA.fit(m2, 0.9).n_components
    m2.release()
    assert n90 == int(np.searchsorted(np.cumsum(ev / ev.sum()), 0.9, side="right") + 1)


def test_assignment_probabilities_sum_to_one(spark):
    df, X, lab = _frame(spark)
    m = MX.Matrix.of(df, "x", "id")
    f = MX.gmm_many(m, {0: MX.GMMFit(3, "full", seed=5)}, max_iter=50)[0]
    model = {"kind": "gmm", "weights": f.weights, "means": f.means + m.shift, "covs": f.covs, "cov_type": "full"}
    m.release()
    rows = MX.assign(df, "x", "id", model).collect()
    for r in rows:
        assert abs(sum(r["prob"]) - 1.0) < 1e-9
        assert r["cluster"] == int(np.argmax(r["prob"]))
