"""Multi-model K-means (k-means|| / Lloyd) and Gaussian mixtures (EM, diag / full).

A model search fits hundreds of small models on one matrix. Running one Spark job per iteration per model would drown
in scheduling, so every unconverged model advances in the SAME scan:

* the parameters of all active models are broadcast (k x d (x d) each), in shards of bounded size;
* ``mapInArrow`` views each batch's flat buffer as a matrix and adds its sufficient statistics to per-model
  accumulators, a block of rows at a time; the factors of all models are stacked, so a block is a few matrix products;
* the partitions' vectors are added up: in chunks by (model, chunk), or on the driver where all of them
  together are below 1 MB. The driver receives no row data, and of each scan about one vector per model;
* the driver runs the M-step / centre update and drops converged models.

Statistics are computed about a fixed shift (the global mean) to avoid cancellation in E[x^2] - mean^2. Random draws
come from a hash of (row id, seed, step), so a fit is deterministic for a given seed independent of partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = np.finfo(float).eps
LOG2PI = math.log(2 * math.pi)


def _u01(ids: np.ndarray, salt: int) -> np.ndarray:
    """Deterministic uniform(0,1] per row id and salt (splitmix64)."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(2 ** 53)


def _rows(batch: pa.RecordBatch, shift) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a batch with columns id and x; the matrix is a view of the batch's buffer, less the shift."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(zero_copy_only=False), flat.reshape(batch.num_rows, -1) - shift


def _sq_dists(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    d = (X * X).sum(1)[:, None] - 2.0 * X @ C.T + (C * C).sum(1)[None, :]
    return np.maximum(d, 0.0)


def key_columns(key) -> list[str]:
    """A key is the name of one column or a list of names."""
    return [key] if isinstance(key, str) else list(key)


def row_id(df: DataFrame, key):
    """The long that draws for a row: an integer key itself, a hash of text or of several columns."""
    cols = key_columns(key)
    if len(cols) == 1 and isinstance(df.schema[cols[0]].dataType, T.IntegralType):
        return F.coalesce(F.col(f"`{cols[0]}`").cast("long"), F.lit(0))
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols])


class MatrixError(ValueError):
    """The matrix cannot be fitted: no rows, missing or non-finite values, or rows of different widths."""


@dataclass
class Matrix:
    """The persisted (id, x) frame a search iterates over, with its shift and size. Use it as a context manager."""
    df: DataFrame
    n: int
    d: int
    shift: np.ndarray
    mean_var: float
    parts: int = 1
    kept: DataFrame | None = None  # the persisted frame under df, where df reads several of its partitions in one task

    @classmethod
    def of(cls, df: DataFrame, vec_col: str, id_col) -> "Matrix":
        """Persist the vectors of ``df`` and check them (F-19, F-20); ``id_col`` is one column or several, of any type."""
        vec = F.col(f"`{vec_col}`").cast("array<double>")
        m = df.select(row_id(df, id_col).alias("id"), vec.alias("x")).persist()
        try:
            finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
            row = m.withColumn("part", F.spark_partition_id()).agg(
                F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.count_if(~finite).alias("bad"),
                F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.max("part").alias("part")).first()
            if not row["n"]:
                raise MatrixError("the matrix has no rows")
            if row["missing"] or row["bad"]:
                raise MatrixError(f"the matrix has {row['missing']} null rows and {row['bad']} rows with null, NaN or infinite values")
            if row["least"] != row["most"] or not row["most"]:
                raise MatrixError(f"the rows of the matrix have {row['least']} to {row['most']} columns")
            # a scan costs a task for each partition, so small ones are read together: a shuffle before may have left hundreds
            parts, wanted = row["part"] + 1, max(m.sparkSession.sparkContext.defaultParallelism, -(-8 * row["n"] * row["most"] // PART_BYTES))
            read, parts = (m.coalesce(wanted), wanted) if parts > wanted else (m, parts)
            stat = read.agg(Summarizer.metrics("mean", "variance").summary(array_to_vector("x")).alias("s")).first()["s"]
        except Exception:
            m.unpersist()
            raise
        var = np.asarray(stat["variance"].toArray()) * (row["n"] - 1) / row["n"]  # population variance
        return cls(read, int(row["n"]), int(row["most"]), np.asarray(stat["mean"].toArray()), float(var.mean()), parts, m)

    def release(self):
        (self.df if self.kept is None else self.kept).unpersist()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.release()


CHUNK = 4096  # numbers of a statistics vector that are added up under one key
SHARD_BYTES = 64 << 20  # budget for one scan's broadcast parameters and per-partition statistics
DIRECT_BYTES = 1 << 20  # partitions' vectors of one scan that may meet on the driver instead of in a shuffle; a fit takes hundreds
SUM_BYTES = 8 << 20  # partitions' vectors that one task adds up
PART_BYTES = 32 << 20  # numbers that one task of a scan reads at least, where there are more partitions than cores
CELLS = 1 << 21  # numbers of one block's widest intermediate matrix


def _step(columns: int) -> int:
    """Rows of a block so that rows x columns stays bounded."""
    return int(min(4096, max(32, CELLS // max(1, columns))))


def _nbytes(obj) -> int:
    if isinstance(obj, np.ndarray):
        return obj.nbytes
    if isinstance(obj, (tuple, list)):
        return sum(_nbytes(o) for o in obj)
    return 64


def _shards(payload: dict, budget: int = SHARD_BYTES):
    """Split the model payload so that each scan stays under the byte budget (statistics are of the
    same order as the parameters: counts, first and second moments)."""
    if not isinstance(payload, dict):
        yield payload
        return
    cur, size = {}, 0
    for mid, params in payload.items():
        b = 2 * _nbytes(params)
        if cur and size + b > budget:
            yield cur
            cur, size = {}, 0
        cur[mid] = params
        size += b
    if cur:
        yield cur


def _reduce(matrix: Matrix, fn, payload) -> dict:
    """One scan per shard: fn(X, ids, payload) -> {model: flat stats}, added up within each partition. The partitions'
    vectors meet in chunks, so no task holds more than partitions x CHUNK numbers of one model; the driver receives one
    vector per model."""
    out = {}
    for shard in _shards(payload, SHARD_BYTES):
        out.update(_reduce_one(matrix, fn, shard))
    return out


def _sent(matrix: Matrix, payload) -> int:
    """About how many bytes the vectors of all partitions take."""
    size = sum(map(_nbytes, payload.values())) if isinstance(payload, dict) else 8 * matrix.d ** 2
    return 2 * matrix.parts * size


def _add_chunks(batches):
    """Sums of the vectors of each (model, chunk)."""
    acc: dict = {}
    for batch in batches:
        for m, c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            v = v.values.to_numpy()
            acc[m, c] = acc[m, c] + v if (m, c) in acc else v
    if acc:
        yield pa.RecordBatch.from_arrays(
            [pa.array([m for m, _ in acc], pa.int64()), pa.array([c for _, c in acc], pa.int32()),
             pa.array(list(acc.values()), pa.list_(pa.float64()))], ["model", "chunk", "s"])


def _reduce_one(matrix: Matrix, fn, payload) -> dict:
    bc = matrix.df.sparkSession.sparkContext.broadcast(payload)
    shift, chunk = matrix.shift, CHUNK

    def per_partition(batches):
        acc = {}
        for batch in batches:
            if batch.num_rows:
                ids, X = _rows(batch, shift)
                for mid, vec in fn(X, ids, bc.value).items():
                    acc[mid] = acc[mid] + vec if mid in acc else vec
        if acc:
            parts = [(mid, c, v[c * chunk:(c + 1) * chunk]) for mid, v in acc.items() for c in range(-(-len(v) // chunk))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int32()),
                 pa.array([p[2] for p in parts], pa.list_(pa.float64()))], ["model", "chunk", "s"])

    schema = "model long, chunk int, s array<double>"
    part = matrix.df.mapInArrow(per_partition, schema)
    if (sent := _sent(matrix, payload)) > DIRECT_BYTES:
        tasks = max(matrix.df.sparkSession.sparkContext.defaultParallelism, sent // SUM_BYTES)
        part = part.repartition(tasks, "model", "chunk").mapInArrow(_add_chunks, schema)
    got = part.toArrow()
    bc.destroy()
    cells: dict = {}
    for m, c, v in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2)):
        v = v.values.to_numpy()
        cells[m, c] = cells[m, c] + v if (m, c) in cells else v
    out: dict = {}
    for m, c in sorted(cells):
        out.setdefault(m, []).append(cells[m, c])
    return {m: np.concatenate(v) for m, v in out.items()}


def _top_rows(matrix: Matrix, fn, payload: dict) -> dict:
    """One scan per shard: ``fn(X, ids, params)`` gives (keys, how many, one more number per row) of a model; the rows with
    the smallest finite keys of all partitions come back as {model: (numbers, rows)}, at most so many for each model."""
    out = {}
    for shard in _shards(payload, SHARD_BYTES):
        bc = matrix.df.sparkSession.sparkContext.broadcast(shard)
        shift = matrix.shift

        def per_partition(batches, bc=bc, shift=shift):
            best: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, X = _rows(batch, shift)
                for mid, params in bc.value.items():
                    keys, want, extra = fn(X, ids, params)
                    at = np.argpartition(keys, want - 1)[:want] if len(keys) > want else np.arange(len(keys))
                    at = at[np.isfinite(keys[at])]
                    own = (keys[at], extra[at], X[at])
                    if mid in best:
                        own = tuple(np.concatenate([x, y]) for x, y in zip(best[mid], own))
                        at = np.argsort(own[0], kind="stable")[:want]
                        own = tuple(x[at] for x in own)
                    best[mid] = own
            rows = [(mid, k, e, x) for mid, own in best.items() for k, e, x in zip(*own)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()),
                     pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.list_(pa.float64()))],
                    ["model", "key", "extra", "x"])

        found = matrix.df.mapInArrow(per_partition, "model long, key double, extra double, x array<double>")
        want = {mid: fn.want(p) for mid, p in shard.items()}
        if matrix.parts * sum(want.values()) * matrix.d * 8 > DIRECT_BYTES:
            found = found.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy("key", "x"))) \
                .filter(F.col("r") <= max(want.values())).drop("r")
        by: dict = {}
        for m, k, e, x in zip(*[c.to_pylist() for c in found.toArrow().columns]):
            by.setdefault(m, []).append((k, e, x))
        bc.destroy()
        for mid, rows in by.items():
            rows = sorted(rows, key=lambda r: (r[0], r[2]))[:want[mid]]
            out[mid] = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    return out


# ------------------------------------------------------------------ K-means
@dataclass
class KMeansFit:
    k: int
    seed: int
    centres: np.ndarray = None          # shifted coordinates
    n_iter: int = 0
    inertia: float = None
    sizes: np.ndarray = None
    converged: bool = False
    done: bool = False


def _nearest(X: np.ndarray, C: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, and its squared distance; a block at a time."""
    at, d2 = np.empty(len(X), np.int64), np.empty(len(X))
    step = _step(len(C))
    for i in range(0, len(X), step):
        D = _sq_dists(X[i:i + step], C)
        at[i:i + step] = D.argmin(1)
        d2[i:i + step] = D[np.arange(len(D)), at[i:i + step]]
    return at, d2


def _draw(X, ids, params):
    """Keys whose smallest ones are a draw without replacement, with weights 1 or the squared distances to the centres."""
    C, salt, want = params
    w = np.ones(len(X)) if C is None else _nearest(X, C)[1]
    with np.errstate(divide="ignore"):
        return np.where(w > 0, -np.log(_u01(ids, salt)) / w, np.inf), want, w


def _far(X, ids, params):
    """The rows farthest from their centres, with the number of the centre; rows on a centre are out."""
    C, want = params
    at, d2 = _nearest(X, C)
    return np.where(d2 > 0, -d2, np.inf), want, at.astype(float)


_draw.want = lambda p: p[2]
_far.want = lambda p: p[1]


def _weights_scan(X, ids, payload):
    return {mid: np.bincount(_nearest(X, C)[0], minlength=len(C)).astype(float) for mid, C in payload.items()}


SEED_ROUNDS, OVERSAMPLING, RECLUSTER_ITER = 4, 2, 20


def _recluster(P: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres from weighted candidates: k-means++ with greedy trials, then weighted Lloyd steps."""
    rng = np.random.default_rng(seed)
    at = [int(rng.choice(len(P), p=w / w.sum()))]
    near = _sq_dists(P, P[at])[:, 0]
    trials = 2 + int(math.log(k))
    while len(at) < k:
        pot = np.cumsum(w * near)
        if pot[-1] <= 0:  # fewer distinct candidates than centres
            at.append(at[0])
            continue
        tries = np.minimum(np.searchsorted(pot, rng.random(trials) * pot[-1], "right"), len(P) - 1)
        reach = np.minimum(near[:, None], _sq_dists(P, P[tries]))
        best = int((w @ reach).argmin())
        at.append(int(tries[best]))
        near = reach[:, best]
    C = P[at]
    for _ in range(RECLUSTER_ITER):
        lab = _sq_dists(P, C).argmin(1)
        mass = np.bincount(lab, w, k)
        new = np.stack([np.bincount(lab, w * P[:, j], k) for j in range(P.shape[1])], 1)
        new = np.where(mass[:, None] > 0, new / np.maximum(mass, 1e-300)[:, None], C)
        if np.array_equal(new, C):
            break
        C = new
    return C


def seed_centres(matrix: Matrix, fits: dict, rounds: int = SEED_ROUNDS, oversampling: int = OVERSAMPLING) -> None:
    """k-means|| seeding of all models in rounds + 2 scans, whatever K is.

    One row is drawn, then ``rounds`` times ``oversampling`` x k rows with probabilities by their squared distance to what
    is drawn so far; a last scan weighs the candidates by the rows nearest to them, and the driver reclusters these
    1 + rounds x oversampling x k points.
    """
    found: dict = {}
    for step in range(rounds + 1):
        payload = {mid: (found.get(mid), f.seed * 1000003 + step, oversampling * f.k if step else 1) for mid, f in fits.items()}
        for mid, (_, rows) in _top_rows(matrix, _draw, payload).items():
            found[mid] = np.vstack([found[mid], rows]) if mid in found else rows
    weights = _reduce(matrix, _weights_scan, found)
    for mid, f in fits.items():
        f.centres = _recluster(found[mid], np.maximum(weights[mid], 1e-12), f.k, f.seed)


def _lloyd_scan(X, ids, payload):
    """Counts, sums and SSE per (model, cluster). All models' centres are stacked into one matrix, so a block of rows
    needs one product for every distance and one for the sums."""
    mids = list(payload)
    offs = np.concatenate([[0], np.cumsum([len(payload[m]) for m in mids])])
    C = np.vstack([payload[m] for m in mids])
    cn = (C * C).sum(1)
    counts, sums, sse = np.zeros(offs[-1]), np.zeros((offs[-1], X.shape[1])), np.zeros(len(mids))
    step = _step(offs[-1])
    for start in range(0, len(X), step):
        Xb = X[start:start + step]
        rows = np.arange(len(Xb))
        D = np.maximum((Xb * Xb).sum(1)[:, None] - 2.0 * Xb @ C.T + cn[None, :], 0.0)
        onehot = np.zeros_like(D)
        for j in range(len(mids)):
            block = D[:, offs[j]:offs[j + 1]]
            lab = block.argmin(1)
            sse[j] += block[rows, lab].sum()
            onehot[rows, offs[j] + lab] = 1.0
        counts += onehot.sum(0)
        sums += onehot.T @ Xb
    return {m: np.concatenate([counts[offs[j]:offs[j + 1]], sums[offs[j]:offs[j + 1]].ravel(), [sse[j]]])
            for j, m in enumerate(mids)}


def _relocate(matrix: Matrix, empty: dict) -> None:
    """Give each empty cluster one of the rows farthest from their centres, and take the row from the cluster that held it.

    ``empty``: {model: (centres, counts, sums)}, changed in place. One more scan, only of the models concerned.
    """
    far = _top_rows(matrix, _far, {m: (C, int((counts == 0).sum())) for m, (C, counts, _) in empty.items()})
    for m, (owner, rows) in far.items():
        _, counts, sums = empty[m]
        for j, old, x in zip(np.flatnonzero(counts == 0), owner.astype(int), rows):
            if counts[old] > 1:
                sums[old] -= x
                counts[old] -= 1
                sums[j], counts[j] = x, 1


def kmeans_many(matrix: Matrix, fits: dict, max_iter: int = 300, tol: float = 1e-4,
                init_centres: dict | None = None) -> dict:
    """Lloyd iterations for every model in one scan per iteration.

    ``tol`` is relative to the mean feature variance (sum of squared centre shifts <= tol * mean variance). An empty
    cluster moves to the row farthest from its centre. The final scan recomputes inertia and sizes with the final centres.
    """
    if init_centres:
        for mid, c in init_centres.items():
            fits[mid].centres = np.asarray(c, dtype=float) - matrix.shift
    missing = {m: f for m, f in fits.items() if f.centres is None}
    if missing:
        seed_centres(matrix, missing)
    tol_abs = tol * matrix.mean_var
    d = matrix.d
    while True:
        active = {m: f for m, f in fits.items() if not f.done}
        if not active:
            break
        stats = _reduce(matrix, _lloyd_scan, {m: f.centres for m, f in active.items()})
        moving = {}
        for mid, f in active.items():
            s, k = stats[mid], f.k
            counts, sums, sse = s[:k], s[k:k + k * d].reshape(k, d), s[-1]
            if f.converged or f.n_iter >= max_iter:
                f.inertia, f.sizes, f.done = float(sse), counts.astype(np.int64), True
            else:
                moving[mid] = (f.centres, counts.copy(), sums.copy())
        if empty := {m: v for m, v in moving.items() if (v[1] == 0).any()}:
            _relocate(matrix, empty)
        for mid, (old, counts, sums) in moving.items():
            f = fits[mid]
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old)
            shift = float(((new - old) ** 2).sum())
            f.centres = new
            f.n_iter += 1
            if shift <= tol_abs:
                f.converged = True
    return fits


# ------------------------------------------------------------------ Gaussian mixtures
@dataclass
class GMMFit:
    k: int
    cov_type: str
    seed: int
    reg: float = 1e-6
    weights: np.ndarray = None
    means: np.ndarray = None            # shifted coordinates
    covs: np.ndarray = None
    lower_bound: float = -np.inf
    n_iter: int = 0
    converged: bool = False
    done: bool = False
    log_likelihood: float = None
    sizes: np.ndarray = None
    mean_max_resp: float = None
    history: list = field(default_factory=list)


def _prec_chol(covs, cov_type):
    if cov_type == "diag":
        if np.any(covs <= 0):
            raise np.linalg.LinAlgError("non-positive variance")
        return 1.0 / np.sqrt(covs)
    out = np.empty_like(covs)
    for j, c in enumerate(covs):
        L = np.linalg.cholesky(c)  # raises when not positive definite
        out[j] = np.linalg.inv(L).T
    return out


def _log_gauss(X, means, pc, cov_type):
    d = X.shape[1]
    if cov_type == "diag":
        log_det = np.log(pc).sum(1)
        prec = pc ** 2
        maha = ((X * X) @ prec.T) - 2.0 * X @ (means * prec).T + ((means ** 2) * prec).sum(1)[None, :]
    else:
        log_det = np.array([np.log(np.diag(p)).sum() for p in pc])
        maha = np.empty((len(X), len(means)))
        for j in range(len(means)):
            y = X @ pc[j] - means[j] @ pc[j]
            maha[:, j] = (y * y).sum(1)
    return -0.5 * (d * LOG2PI + maha) + log_det[None, :]


def _normalise(lw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities and log of the sum of weighted densities."""
    mx = lw.max(1, keepdims=True)
    lse = (mx + np.log(np.exp(lw - mx).sum(1, keepdims=True))).ravel()
    return np.exp(lw - lse[:, None]), lse


def _estep(X, params):
    w, means, pc, cov_type = params
    return _normalise(_log_gauss(X, means, pc, cov_type) + np.log(w)[None, :])


def _triangle(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def _second(Xb: np.ndarray, cov_type: str) -> np.ndarray:
    """What the second moments are sums of: squares, or the products of the upper triangle."""
    if cov_type == "diag":
        return Xb * Xb
    i, j = _triangle(Xb.shape[1])
    return Xb[:, i] * Xb[:, j]


def _suff(X, resp, cov_type):
    """Sizes, sums and second moments (full: packed upper triangles) of the components."""
    return resp.sum(0), resp.T @ X, resp.T @ _second(X, cov_type)


def _hard_stats(X, params: dict) -> dict:
    """Statistics of the components that the nearest centres give, for the first M-step."""
    out = {}
    for mid, (_, C, cov_type) in params.items():
        k, total = len(C), 0
        for start in range(0, len(X), step := _step(max(k, X.shape[1] ** 2))):
            Xb = X[start:start + step]
            resp = (_sq_dists(Xb, C).argmin(1)[:, None] == np.arange(k)[None, :]).astype(np.float64)
            nk, sx, sxx = _suff(Xb, resp, cov_type)
            total = total + np.concatenate([[0.0, len(Xb)], nk, sx.ravel(), sxx.ravel(), nk])
        out[mid] = total
    return out


def _full_stacked(X, params: dict) -> dict:
    """E-step statistics of many full-covariance models at once.

    The triangular factors of all components stand side by side, so one product gives every whitened row; the products
    of the upper triangle are formed once for all of them. Temporaries: block x total k x d and block x d (d + 1) / 2.
    """
    mids = list(params)
    d = X.shape[1]
    ks = [len(params[m][0]) for m in mids]
    offs = np.concatenate([[0], np.cumsum(ks)])
    K = int(offs[-1])
    pc = np.concatenate([params[m][2] for m in mids])                      # K x d x d
    means = np.concatenate([params[m][1] for m in mids])
    W = pc.transpose(1, 0, 2).reshape(d, K * d)
    B = np.einsum("kd,kde->ke", means, pc).ravel()
    const = np.log(np.diagonal(pc, axis1=1, axis2=2)).sum(1) - 0.5 * d * LOG2PI + np.log(np.concatenate([params[m][0] for m in mids]))
    nk, sx, hard = np.zeros(K), np.zeros((K, d)), np.zeros(K)
    sxx = np.zeros((K, d * (d + 1) // 2))
    lse_sum, maxr_sum = np.zeros(len(mids)), np.zeros(len(mids))
    step = _step(max(K * d, d * d))
    for start in range(0, len(X), step):
        Xb = X[start:start + step]
        Y = (Xb @ W - B).reshape(len(Xb), K, d)
        lw = const - 0.5 * np.einsum("nkd,nkd->nk", Y, Y)
        resp = np.empty_like(lw)
        for j in range(len(mids)):
            r, lse = _normalise(lw[:, offs[j]:offs[j + 1]])
            resp[:, offs[j]:offs[j + 1]] = r
            lse_sum[j] += lse.sum()
            maxr_sum[j] += r.max(1).sum()
            hard[offs[j]:offs[j + 1]] += np.bincount(r.argmax(1), minlength=ks[j])
        a, b, c = _suff(Xb, resp, "full")
        nk, sx, sxx = nk + a, sx + b, sxx + c
    return {m: np.concatenate([[lse_sum[j], maxr_sum[j]], *[x[offs[j]:offs[j + 1]].ravel() for x in (nk, sx, sxx, hard)]])
            for j, m in enumerate(mids)}


def _diag_stacked(X, params: dict) -> dict:
    """E-step statistics of many diagonal models at once: every component's log density is one column
    of [x^2, x] @ [-prec/2; mean*prec]^T, so a row block needs two GEMMs for all models."""
    mids = list(params)
    ks = [len(params[m][0]) for m in mids]
    offs = np.concatenate([[0], np.cumsum(ks)])
    d = X.shape[1]
    P = np.vstack([params[m][2] ** 2 for m in mids])                      # precisions
    MP = np.vstack([params[m][1] * params[m][2] ** 2 for m in mids])
    const = np.concatenate([-0.5 * (d * LOG2PI + ((params[m][1] ** 2) * params[m][2] ** 2).sum(1))
                            + np.log(params[m][2]).sum(1) + np.log(params[m][0]) for m in mids])
    K = offs[-1]
    nk, sx, sxx, hard = np.zeros(K), np.zeros((K, d)), np.zeros((K, d)), np.zeros(K)
    lse_sum, maxr_sum = np.zeros(len(mids)), np.zeros(len(mids))
    step = _step(int(K))
    for start in range(0, len(X), step):
        Xb = X[start:start + step]
        X2 = Xb * Xb
        lw = -0.5 * (X2 @ P.T) + Xb @ MP.T + const[None, :]
        resp = np.empty_like(lw)
        for j in range(len(mids)):
            r, lse = _normalise(lw[:, offs[j]:offs[j + 1]])
            resp[:, offs[j]:offs[j + 1]] = r
            lse_sum[j] += lse.sum()
            maxr_sum[j] += r.max(1).sum()
            hard[offs[j]:offs[j + 1]] += np.bincount(r.argmax(1), minlength=ks[j])
        nk += resp.sum(0)
        sx += resp.T @ Xb
        sxx += resp.T @ X2
    return {m: np.concatenate([[lse_sum[j], maxr_sum[j]], nk[offs[j]:offs[j + 1]], sx[offs[j]:offs[j + 1]].ravel(),
                               sxx[offs[j]:offs[j + 1]].ravel(), hard[offs[j]:offs[j + 1]]])
            for j, m in enumerate(mids)}


def _em_scan(X, ids, payload):
    out = {}
    for fn, own in ((_diag_stacked, {m: p[1:4] for m, p in payload.items() if p[0] == "soft" and p[4] == "diag"}),
                    (_full_stacked, {m: p[1:4] for m, p in payload.items() if p[0] == "soft" and p[4] == "full"}),
                    (_hard_stats, {m: p for m, p in payload.items() if p[0] == "hard"})):
        if own:
            out.update(fn(X, own))
    return out


def _mstep(f: GMMFit, s: np.ndarray, n: int, d: int):
    k = f.k
    width = d if f.cov_type == "diag" else d * (d + 1) // 2
    nk_raw, sx, sxx = np.split(s[2:2 + k * (1 + d + width)], [k, k + k * d])
    sx, sxx = sx.reshape(k, d), sxx.reshape(k, width)
    nk = nk_raw + 10 * EPS
    means = sx / nk[:, None]
    if f.cov_type == "diag":
        covs = sxx / nk[:, None] - means ** 2 + f.reg
    else:
        i, j = _triangle(d)
        # about the new mean: the statistics are about the shift
        part = (sxx - sx[:, i] * means[:, j] - means[:, i] * sx[:, j] + nk_raw[:, None] * means[:, i] * means[:, j]) / nk[:, None]
        covs = np.empty((k, d, d))
        covs[:, i, j] = part
        covs[:, j, i] = part
        covs[:, np.arange(d), np.arange(d)] += f.reg
    f.weights, f.means, f.covs = nk / nk.sum(), means, covs


def _unpack_tail(f: GMMFit, s: np.ndarray):
    return s[0], s[1], s[-f.k:]


def gmm_many(matrix: Matrix, fits: dict, max_iter: int = 100, tol: float = 1e-3,
             init_kmeans_iter: int = 300) -> dict:
    """EM for every model in one scan per iteration; k-means initialisation (one k-means fit per model,
    itself run as a multi-model search). Lower bound = mean log-likelihood of the E-step."""
    km = {m: KMeansFit(f.k, f.seed) for m, f in fits.items() if f.means is None}
    if km:
        kmeans_many(matrix, km, max_iter=init_kmeans_iter, tol=1e-4)
        stats = _reduce(matrix, _em_scan, {m: ("hard", km[m].centres, fits[m].cov_type) for m in km})
        for m in km:
            _mstep(fits[m], stats[m], matrix.n, matrix.d)
    while True:
        active = {m: f for m, f in fits.items() if not f.done}
        if not active:
            break
        payload = {}
        for m, f in active.items():
            try:
                payload[m] = ("soft", f.weights, f.means, _prec_chol(f.covs, f.cov_type), f.cov_type)
            except np.linalg.LinAlgError as exc:
                raise ValueError(f"model {m}: covariance is not positive definite; raise reg_covar") from exc
        stats = _reduce(matrix, _em_scan, payload)
        for m, f in active.items():
            s = stats[m]
            ll_sum, maxr_sum, hard = _unpack_tail(f, s)
            lb = ll_sum / matrix.n
            if f.converged or f.n_iter >= max_iter:
                f.log_likelihood, f.mean_max_resp, f.sizes, f.done = lb, maxr_sum / matrix.n, hard.astype(np.int64), True
                continue
            change = lb - f.lower_bound
            f.lower_bound = lb
            f.history.append(lb)
            _mstep(f, s, matrix.n, matrix.d)
            f.n_iter += 1
            if abs(change) < tol:
                f.converged = True
    return fits


def n_parameters(k: int, d: int, cov_type: str) -> int:
    cov = k * d if cov_type == "diag" else k * d * (d + 1) // 2
    return int(cov + k * d + k - 1)


def bic_aic(log_likelihood: float, n: int, k: int, d: int, cov_type: str) -> tuple[float, float]:
    p = n_parameters(k, d, cov_type)
    return -2 * log_likelihood * n + p * math.log(n), -2 * log_likelihood * n + 2 * p


# ------------------------------------------------------------------ assignment (M-6, M-21)
def assign(matrix_df: DataFrame, vec_col: str, id_col, model: dict) -> DataFrame:
    """Per-row cluster, probabilities, max probability and entropy -sum p ln(p + 1e-12).

    ``id_col`` names the key: one column or several, of any type, which come back as they are. ``model``: {"kind":
    "kmeans", "centres"} or {"kind": "gmm", "weights", "means", "covs", "cov_type"} in original coordinates. Hard models
    give a one-hot probability row of width k. The model is broadcast: k x d (x d) numbers.
    """
    keys = key_columns(id_col)
    if model["kind"] == "kmeans":
        payload = ("kmeans", np.asarray(model["centres"], float))
    else:
        payload = ("gmm", np.asarray(model["weights"]), np.asarray(model["means"], float),
                   _prec_chol(np.asarray(model["covs"], float), model["cov_type"]), model["cov_type"])
    bc = matrix_df.sparkSession.sparkContext.broadcast(payload)
    n_keys = len(keys)

    def score(batches):
        p = bc.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column(n_keys).flatten().to_numpy(zero_copy_only=False)
            X = flat.reshape(batch.num_rows, -1)
            if p[0] == "kmeans":
                lab = _nearest(X, p[1])[0]
                prob = (lab[:, None] == np.arange(len(p[1]))[None, :]).astype(np.float64)
                lse = np.full(len(X), np.nan)
            else:
                parts = [_estep(X[i:i + 4096], p[1:]) for i in range(0, len(X), 4096)]
                prob, lse = (np.concatenate(x) for x in zip(*parts))
                lab = prob.argmax(1)
            ent = -(prob * np.log(prob + 1e-12)).sum(1)
            width = prob.shape[1]
            probs = pa.ListArray.from_arrays(pa.array(np.arange(0, prob.size + 1, width, dtype=np.int32)), pa.array(prob.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keys], pa.array(lab.astype(np.int32)), probs, pa.array(prob.max(1)), pa.array(ent), pa.array(lse)],
                [*keys, "cluster", "prob", "max_probability", "assignment_entropy", "log_density"])

    src = matrix_df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    schema = T.StructType([src.schema[c] for c in keys] + T.StructType.fromDDL(
        "cluster int, prob array<double>, max_probability double, assignment_entropy double, log_density double").fields)
    return src.mapInArrow(score, schema)
