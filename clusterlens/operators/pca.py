"""Centred, sign-fixed PCA (M-1..M-4, K-4, C-11).

Two solvers. ``covariance_eigh``: one scan accumulates X'X about the global mean (shifted, so nothing cancels), the
d x d covariance is decomposed on the driver. ``randomized``: subspace iteration, where a scan multiplies d x l matrices
and no d x d matrix is formed anywhere; in the last scan every partition reduces its part of the projected rows to a
triangular factor, and the factors meet in a tree of QR reductions. The projection centres the rows and runs in Arrow
batches with the broadcast d x k loading matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.operators.mixture import Matrix, _reduce, _rows, _step, key_columns

SOLVERS = ("auto", "full", "covariance_eigh", "randomized")
#: Columns up to which ``auto`` forms the covariance; beyond, it iterates if few components are wanted.
AUTO_COLUMNS = 500
OVERSAMPLES, POWER_ITERATIONS = 10, 7
#: Triangular factors that one task of the tree takes.
TREE_FAN = 32


@dataclass
class PCAFit:
    mean: np.ndarray
    components: np.ndarray          # k x d, rows = components
    explained_variance: np.ndarray  # all d eigenvalues (ddof 1), descending
    n_components: int
    whiten: bool = False
    total_variance: float | None = None  # of all columns, where not all eigenvalues are known

    @property
    def ratio(self):
        return self.explained_variance / (self.total_variance or self.explained_variance.sum())


def _moments(X, ids, payload):
    return {0: np.concatenate([[len(X)], X.sum(0), (X.T @ X).ravel()])}


def _power(X, ids, payload):
    """X'XQ, a block of rows at a time."""
    Q, step = payload["q"][0], _step(payload["q"][0].shape[1] + X.shape[1])
    return {0: sum(X[i:i + step].T @ (X[i:i + step] @ Q) for i in range(0, len(X), step)).ravel()}


def _triangular(matrix: Matrix, Q: np.ndarray) -> np.ndarray:
    """The triangular factor of XQ: one for each partition, then a tree of QR reductions over them."""
    width = Q.shape[1]
    bc = matrix.df.sparkSession.sparkContext.broadcast(Q)
    shift = matrix.shift

    def packed(r, number):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "r"])

    def leaves(batches):
        from pyspark import TaskContext
        r = None
        for batch in batches:
            if batch.num_rows:
                y = _rows(batch, shift)[1] @ bc.value
                r = np.linalg.qr(y if r is None else np.vstack([r, y]), mode="r")
        if r is not None:
            yield packed(r, TaskContext.get().partitionId())

    def join(batches):
        r, number = None, 0
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.values.to_numpy().reshape(-1, width)
                r, number = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r"), n
        if r is not None:
            yield packed(r, number)

    schema, parts = "part long, r array<double>", matrix.parts
    tree = matrix.df.mapInArrow(leaves, schema)
    while parts > TREE_FAN:
        parts = -(-parts // TREE_FAN)
        tree = tree.repartition(parts).mapInArrow(join, schema)
    factors = [x.values.to_numpy().reshape(-1, width) for x in tree.orderBy("part").toArrow().column(1)]
    bc.destroy()
    return np.linalg.qr(np.vstack(factors), mode="r")


def _randomized(matrix: Matrix, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading k eigenvalues (ddof 1) and eigenvectors by subspace iteration."""
    width = min(matrix.d, matrix.n, k + OVERSAMPLES)
    Q = np.linalg.qr(np.random.default_rng(seed).normal(size=(matrix.d, width)))[0]
    for _ in range(POWER_ITERATIONS):
        Q = np.linalg.qr(_reduce(matrix, _power, {"q": (Q,)})[0].reshape(matrix.d, width))[0]
    R = _triangular(matrix, Q)
    Z = _reduce(matrix, _power, {"q": (Q,)})[0].reshape(matrix.d, width)  # X'(XQ)
    # XQ = UR, so U'X = R^-T Z'; the pseudo-inverse leaves out directions in which X has no extent
    _, values, rows = np.linalg.svd(np.linalg.pinv(R.T, rcond=1e-12) @ Z.T, full_matrices=False)
    return values[:k] ** 2 / (matrix.n - 1), rows[:k]


def covariance(matrix: Matrix) -> np.ndarray:
    """Sample covariance (ddof 1) from one distributed scan."""
    s = _reduce(matrix, _moments, None)[0]
    n, d = s[0], matrix.d
    sx = s[1:1 + d]
    sxx = s[1 + d:].reshape(d, d)
    return (sxx - np.outer(sx, sx) / n) / (n - 1)


def fit(matrix: Matrix, n_components: int | float | None = None, whiten: bool = False, svd_solver: str = "auto",
        random_state: int = 42) -> PCAFit:
    """Fixed ``n_components`` (int) or the smallest n whose cumulative ratio exceeds a float target.

    ``svd_solver``: ``covariance_eigh`` (``full`` means the same) or ``randomized``, which needs a fixed number. ``auto``
    takes the first up to AUTO_COLUMNS columns, and where a target or most components are wanted.
    """
    if svd_solver not in SOLVERS:
        raise ValueError(f"unknown svd_solver {svd_solver!r}; available: {SOLVERS}")
    fixed = n_components is not None and not (isinstance(n_components, float) and 0 < n_components < 1)
    if fixed and not 1 <= int(n_components) <= min(matrix.n, matrix.d):
        raise ValueError(f"n_components={n_components} must be between 1 and {min(matrix.n, matrix.d)}")
    if svd_solver == "auto":
        few = fixed and 5 * int(n_components) < 4 * matrix.d
        svd_solver = "randomized" if few and matrix.d > AUTO_COLUMNS else "covariance_eigh"
    if svd_solver == "randomized":
        if not fixed:
            raise ValueError("the randomized solver needs a fixed number of components")
        k = int(n_components)
        ev, vec = _randomized(matrix, k, random_state)
        return PCAFit(matrix.shift.copy(), _signed(vec), ev, k, whiten, matrix.mean_var * matrix.d * matrix.n / (matrix.n - 1))
    ev, vec = np.linalg.eigh(covariance(matrix))
    order = np.argsort(ev)[::-1]
    ev, vec = np.maximum(ev[order], 0.0), _signed(vec[:, order].T)
    if n_components is None:
        k = len(ev)
    elif fixed:
        k = int(n_components)
    else:
        k = min(int(np.searchsorted(np.cumsum(ev / ev.sum()), n_components, side="right") + 1), len(ev))
    return PCAFit(matrix.shift.copy(), vec[:k], ev, k, whiten)


def _signed(vec: np.ndarray) -> np.ndarray:
    """Rows with their largest entry positive."""
    signs = np.sign(vec[np.arange(len(vec)), np.abs(vec).argmax(1)])
    return vec * np.where(signs == 0, 1.0, signs)[:, None]


def component_table(spark, model: PCAFit) -> DataFrame:
    """M-3 / W-6: (component, explained_variance, ratio, cumulative) for the retained components."""
    r = model.ratio
    rows = [(i + 1, float(model.explained_variance[i]), float(r[i]), float(np.cumsum(r)[i]))
            for i in range(model.n_components)]
    return spark.createDataFrame(rows, "component int, explained_variance double, ratio double, cumulative double")


def loadings(spark, model: PCAFit, names) -> DataFrame:
    """U-4: long (feature_name, component, loading) — d x k rows."""
    rows = [(names[j], i + 1, float(model.components[i, j]))
            for i in range(model.n_components) for j in range(len(names))]
    return spark.createDataFrame(rows, "feature_name string, component int, loading double")


def top_loadings(load: DataFrame, n: int = 10, max_component: int = 5) -> DataFrame:
    """K-4 / U-2: n largest and n smallest loadings per component, merged without duplicates."""
    hi = Window.partitionBy("component").orderBy(F.col("loading").desc(), F.col("feature_name"))
    lo = Window.partitionBy("component").orderBy(F.col("loading").asc(), F.col("feature_name"))
    x = load.where(F.col("component") <= max_component)
    x = x.withColumn("r_hi", F.row_number().over(hi)).withColumn("r_lo", F.row_number().over(lo))
    return x.where((F.col("r_hi") <= n) | (F.col("r_lo") <= n)).select("component", "feature_name", "loading")


def transform(df: DataFrame, vec_col: str, id_col, model: PCAFit, out_col: str = "pc") -> DataFrame:
    """M-2: (x - mean) @ components.T, optionally whitened; Arrow batches, broadcast d x k matrix.

    ``id_col`` is one key column or several, of any type.
    """
    keys = key_columns(id_col)
    W = model.components.T.copy()
    if model.whiten:
        W = W / np.sqrt(model.explained_variance[:model.n_components])[None, :]
    bc = df.sparkSession.sparkContext.broadcast((model.mean, W))
    n_keys = len(keys)

    def project(batches):
        mean, w = bc.value
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(n_keys).flatten().to_numpy(zero_copy_only=False)
                out = (flat.reshape(batch.num_rows, -1) - mean) @ w
                offsets = pa.array(np.arange(0, out.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_keys], pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], [*keys, out_col])

    src = df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    schema = T.StructType([src.schema[c] for c in keys]).add(out_col, T.ArrayType(T.DoubleType()))
    return src.mapInArrow(project, schema)
