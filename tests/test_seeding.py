"""Seeding, relocation, guards and stacked full covariances of the model engine."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clusterlens.operators import mixture as MX


def _frame(spark, X, ids=None):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(X)) if ids is None else ids, "x": list(X)})).repartition(3)


def _scans(monkeypatch):
    count = []
    for name in ("_reduce_one", "_top_rows"):
        old = getattr(MX, name)
        monkeypatch.setattr(MX, name, lambda *a, old=old: (count.append(1), old(*a))[1])
    return count


def test_seeding_takes_six_scans_and_finds_the_blobs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 4)) * 40
    X = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 4))
    with MX.Matrix.of(_frame(spark, X), "x", "id") as m:
        fits = {i: MX.KMeansFit(k, seed=i) for i, k in enumerate((2, 30, 30))}
        scans = _scans(monkeypatch)
        MX.seed_centres(m, fits)
        assert len(scans) == MX.SEED_ROUNDS + 2 == 6
        for f in (fits[1], fits[2]):  # a centre next to every blob
            D = MX._sq_dists(centres - m.shift, f.centres)
            assert np.sqrt(D.min(1)).max() < 3
        MX.kmeans_many(m, fits)
        best = ((X - X.mean(0)) ** 2).sum()
        assert fits[1].inertia < 1.2 * 4 * 3000 < best and fits[1].sizes.min() > 0


def test_fits_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(500, 3))
    out = []
    for parts in (1, 7):
        with MX.Matrix.of(_frame(spark, X).repartition(parts), "x", "id") as m:
            f = MX.kmeans_many(m, {0: MX.KMeansFit(5, seed=9)})[0]
            out.append(f.centres[np.lexsort(f.centres.T)] + m.shift)
    np.testing.assert_allclose(out[0], out[1], atol=1e-9)


def test_empty_clusters_move_to_the_farthest_rows(spark):
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(size=(200, 2)), rng.normal(size=(50, 2)) + 30, rng.normal(size=(20, 2)) - 50])
    far = np.array([[0.0, 0], [30, 30], [500, 500]])  # the last gets no row
    with MX.Matrix.of(_frame(spark, X), "x", "id") as m:
        f = MX.kmeans_many(m, {0: MX.KMeansFit(3, seed=1)}, init_centres={0: far})[0]
        assert sorted(f.sizes) == [20, 50, 200]


def test_fewer_distinct_rows_than_centres(spark):
    X = np.repeat([[1.0, 2], [3, 4]], 10, axis=0)
    with MX.Matrix.of(_frame(spark, X), "x", "id") as m:
        f = MX.kmeans_many(m, {0: MX.KMeansFit(4, seed=1)})[0]
        assert f.sizes.sum() == 20 and f.inertia == pytest.approx(0) and f.converged


def test_shuffled_statistics_equal_direct_ones(spark, monkeypatch):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(400, 5))
    out = []
    for direct in (MX.DIRECT_BYTES, 0):
        monkeypatch.setattr(MX, "DIRECT_BYTES", direct)
        with MX.Matrix.of(_frame(spark, X), "x", "id") as m:
            f = MX.gmm_many(m, {0: MX.GMMFit(3, "full", seed=2), 1: MX.GMMFit(4, "diag", seed=2)}, max_iter=5)
            out.append([f[i].lower_bound for i in f])
    np.testing.assert_allclose(out[0], out[1], rtol=1e-9)


def test_stacked_full_estep_matches_per_model(monkeypatch):
    monkeypatch.setattr(MX, "CELLS", 600)  # several blocks
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 4))
    params = {}
    for m in range(3):
        k = 2 + m
        covs = np.array([a @ a.T + np.eye(4) for a in rng.normal(size=(k, 4, 4))])
        params[m] = ("soft", rng.dirichlet(np.ones(k)), rng.normal(size=(k, 4)), MX._prec_chol(covs, "full"), "full")
    stacked = MX._em_scan(X, None, params)
    for m, p in params.items():
        resp, lse = MX._estep(X, p[1:])
        i, j = np.triu_indices(4)
        sxx = np.einsum("nk,ni,nj->kij", resp, X, X)[:, i, j]
        ref = np.concatenate([[lse.sum(), resp.max(1).sum()], resp.sum(0), (resp.T @ X).ravel(), sxx.ravel(),
                              np.bincount(resp.argmax(1), minlength=len(p[1])).astype(float)])
        np.testing.assert_allclose(stacked[m], ref, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, float("nan")], [float("inf"), 1.0], [None, 1.0]])
def test_matrix_guards(spark, bad):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], "id long, x array<double>")
    with pytest.raises(MX.MatrixError):
        MX.Matrix.of(df, "x", "id")
    with pytest.raises(MX.MatrixError):
        MX.Matrix.of(df.limit(0), "x", "id")


def test_keys_of_text_and_of_two_columns(spark):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(60, 2)) + np.repeat([[0, 0], [20, 20]], 30, axis=0)
    df = _frame(spark, X).withColumn("name", F.concat(F.lit("k"), "id")).withColumn("part", (F.col("id") % 3).cast("int"))
    for key in ("name", ["name", "part"]):
        with MX.Matrix.of(df, "x", key) as m:
            f = MX.kmeans_many(m, {0: MX.KMeansFit(2, seed=1)})[0]
            assert sorted(f.sizes) == [30, 30]
            model = {"kind": "kmeans", "centres": f.centres + m.shift}
        a = MX.assign(df, "x", key, model)
        assert a.columns[:len(MX.key_columns(key))] == MX.key_columns(key)
        assert a.select(*MX.key_columns(key)).distinct().count() == 60
        assert a.schema["name"].dataType.simpleString() == "string"


@pytest.mark.parametrize("parts", [3, 40])
def test_randomized_pca_agrees_with_the_exact_one(spark, parts):
    from clusterlens.operators import pca as PCA
    rng = np.random.default_rng(9)
    X = rng.normal(size=(400, 30)) * (0.8 ** np.arange(30)) @ np.linalg.qr(rng.normal(size=(30, 30)))[0] + 7
    with MX.Matrix.of(_frame(spark, X).repartition(parts), "x", "id") as m:
        exact, fast = PCA.fit(m, 5, svd_solver="full"), PCA.fit(m, 5, svd_solver="randomized")
        np.testing.assert_allclose(fast.explained_variance, exact.explained_variance[:5], rtol=1e-6)
        np.testing.assert_allclose(fast.ratio[:5], exact.ratio[:5], rtol=1e-6)
        np.testing.assert_allclose(np.abs((fast.components * exact.components).sum(1)), 1, atol=1e-6)
        low = np.linalg.svd(X - X.mean(0), full_matrices=False)[1][:5] ** 2 / 399
        np.testing.assert_allclose(fast.explained_variance, low, rtol=1e-6)
        for bad in ({"n_components": 0.9, "svd_solver": "randomized"}, {"n_components": 31}, {"n_components": 2, "svd_solver": "x"}):
            with pytest.raises(ValueError):
                PCA.fit(m, **bad)


def test_randomized_pca_of_few_directions(spark):
    from clusterlens.operators import pca as PCA
    rng = np.random.default_rng(10)
    X = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 12))
    with MX.Matrix.of(_frame(spark, X), "x", "id") as m:
        fast = PCA.fit(m, 4, svd_solver="randomized")
        assert fast.explained_variance[2:] == pytest.approx([0, 0], abs=1e-9) and fast.ratio[:2].sum() == pytest.approx(1)


def test_iterations_send_the_driver_less_than_all_partitions_vectors(spark, monkeypatch):
    """The vectors of many models meet in a shuffle before the driver takes them, also where they are a few MB in all."""
    rng = np.random.default_rng(11)
    got = []
    with MX.Matrix.of(_frame(spark, rng.normal(size=(400, 64))).repartition(8), "x", "id") as m:
        payload = {i: rng.normal(size=(10, 64)) for i in range(40)}
        old = type(m.df).toArrow
        monkeypatch.setattr(type(m.df), "toArrow", lambda df: (got.append(old(df)), got[-1])[1])
        stats = MX._reduce(m, MX._lloyd_scan, payload)
    one = sum(v.nbytes for v in stats.values())
    assert len(got) == 1 and got[0].nbytes < 1.5 * one


def test_top_rows_of_equal_keys_are_the_same_on_either_path(spark, monkeypatch):
    X = np.random.default_rng(12).normal(size=(60, 2))
    out = []
    for direct in (MX.DIRECT_BYTES, 0):
        monkeypatch.setattr(MX, "DIRECT_BYTES", direct)
        with MX.Matrix.of(_frame(spark, X, np.zeros(60, np.int64)).repartition(60), "x", "id") as m:
            m.df, m.parts = m.kept, 60
            out.append(MX._top_rows(m, MX._draw, {0: (None, 5, 4)})[0][1])
    np.testing.assert_array_equal(*out)


def test_many_small_partitions_are_read_together(spark, monkeypatch):
    X = np.random.default_rng(13).normal(size=(300, 3))
    cores = spark.sparkContext.defaultParallelism
    with MX.Matrix.of(_frame(spark, X).repartition(60), "x", "id") as m:
        assert m.parts == m.df.rdd.getNumPartitions() == cores < 60
        assert m.df.count() == 300
    assert not m.kept.is_cached
    monkeypatch.setattr(MX, "PART_BYTES", 200)
    with MX.Matrix.of(_frame(spark, X).repartition(60), "x", "id") as m:
        assert m.parts == m.df.rdd.getNumPartitions() == 300 * 3 * 8 / 200
