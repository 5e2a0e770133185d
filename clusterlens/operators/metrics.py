"""Cluster-quality metrics (M-9..M-14, J-5, J-6), over all rows and without size limits.

Row data stays on the executors: centroids are a partial-aggregated ``Summarizer`` per cluster and join the rows by
cluster, ARI / NMI are sums over a ``groupBy(a, b).count()`` contingency table and its margins, in one plan. Pairs of
clusters meet in blocks by an equi-join. The silhouette is the
squared-Euclidean one: the mean squared distance of a row to a cluster has a closed form in the cluster's mean and mean
squared norm, so one pass over the rows is exact and no pairs of rows are built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.functions.vectors import lit_vector, sq_dist


def centroids(df: DataFrame, vec_col: str, cluster_col: str) -> DataFrame:
    """(cluster, n, centroid array<double>) — one partial-aggregated pass."""
    return (df.groupBy(F.col(cluster_col).alias("cluster"))
            .agg(F.count(F.lit(1)).alias("n"),
                 Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>"))).alias("c"))
            .select("cluster", "n", vector_to_array("c").alias("centroid")))


def _with_own_centroid(df, vec_col, cluster_col):
    table = centroids(df, vec_col, cluster_col).select(F.col("cluster").alias("_k"), F.col("n").alias("_n"),
                                                       F.col("centroid").alias("_c"))
    joined = df.join(table, F.col(cluster_col) == F.col("_k"))
    return table, joined.withColumn("_d2", sq_dist(F.col(vec_col).cast("array<double>"), "_c"))


#: Blocks of clusters that are paired with each other; every pair of blocks can be a task of its own.
PAIR_BLOCKS = 16


def _pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All pairs of a row of ``left`` and one of ``right``, two tables of one row per cluster, as an equi-join by block."""
    return left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1)))).join(
        right.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(PAIR_BLOCKS)).cast("int")), "_block").drop("_block")


def davies_bouldin(df: DataFrame, vec_col: str, cluster_col: str) -> DataFrame:
    """M-10: mean over clusters of max_j (s_i + s_j) / d(c_i, c_j); NULL for one cluster."""
    _, j = _with_own_centroid(df, vec_col, cluster_col)
    spread = j.groupBy("_k").agg(F.avg(F.sqrt("_d2")).alias("s"), F.any_value("_c").alias("c"))
    other = spread.select(F.col("_k").alias("k2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    pairs = _pairs(spread, other, "k2").filter(F.col("_k") != F.col("k2"))
    d = F.sqrt(sq_dist("c", "c2"))
    ratio = F.when(d > 0, (F.col("s") + F.col("s2")) / d).otherwise(0.0)
    return pairs.groupBy("_k").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, vec_col: str, cluster_col: str) -> DataFrame:
    """M-11: (between / (k-1)) / (within / (n-k)); within 0 -> 1.0; NULL for one cluster."""
    table, j = _with_own_centroid(df, vec_col, cluster_col)
    row = j.agg(F.sum("_d2").alias("w"), F.count(F.lit(1)).alias("n"),
                Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>"))).alias("m")).first()
    value = None
    if row["n"]:
        b = table.agg(F.sum(F.col("_n") * sq_dist("_c", lit_vector(row["m"].toArray()))).alias("b"),
                      F.count(F.lit(1)).alias("k")).first()
        if b["k"] > 1:
            value = 1.0 if row["w"] == 0 else float(b["b"] * (row["n"] - b["k"]) / (row["w"] * (b["k"] - 1)))
    return df.sparkSession.createDataFrame([(value,)], "calinski_harabasz double")


def row_silhouettes(X: np.ndarray, own: np.ndarray, means: np.ndarray, norms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouette of each row with squared distances, given every cluster's mean, mean squared norm and size.

    The mean squared distance of x to a cluster is |x|^2 - 2 x.mean + mean squared norm; in the own cluster it is scaled
    by n / (n - 1), as the row itself is left out. Rows of clusters of one are 0. Empty clusters do not count.
    """
    at = np.arange(len(X))
    d = np.maximum((X * X).sum(1)[:, None] - 2.0 * X @ means.T + norms[None, :], 0.0)
    n = sizes[own]
    a = d[at, own] * n / np.maximum(n - 1, 1)
    d[:, sizes == 0] = np.inf
    d[at, own] = np.inf
    b = d.min(1)
    top = np.maximum(a, b)
    return np.where((n > 1) & (top > 0) & np.isfinite(top), (b - a) / np.where(top > 0, top, 1.0), 0.0)


def silhouette(df: DataFrame, vec_col: str, cluster_col: str, id_col: str | None = None) -> DataFrame:
    """M-9: mean squared-Euclidean silhouette of all rows, and their number; NULL for one cluster.

    What tasks receive is one mean, norm and size for each cluster, as for scoring a K-means model.
    """
    spark = df.sparkSession
    x = df.select(F.col(cluster_col).alias("k"), F.col(vec_col).cast("array<double>").alias("x")).where(F.col("k").isNotNull())
    stats = x.groupBy("k").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector("x")).alias("m"),
                               Summarizer.normL2(array_to_vector("x")).alias("s")).collect()  # one row a cluster
    n = int(sum(r["n"] for r in stats))
    if len(stats) < 2:
        return spark.createDataFrame([(None, n)], "silhouette double, rows long")
    number = {r["k"]: i for i, r in enumerate(stats)}
    sizes = np.array([r["n"] for r in stats], float)
    means = np.array([r["m"].toArray() for r in stats])
    shift = (means * sizes[:, None]).sum(0) / n  # about the common mean nothing cancels
    # sum |x - shift|^2 = sum |x|^2 - 2 shift.sum x + n |shift|^2, by column
    squares = np.array([(r["s"].toArray() ** 2) for r in stats]) / sizes[:, None]
    norms = (squares - 2.0 * means * shift + shift ** 2).sum(1)
    bc = spark.sparkContext.broadcast((number, means - shift, norms, sizes, shift))

    def score(batches):
        number_, m, q, size, mu = bc.value
        total, count = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            X = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = np.array([number_[v] for v in batch.column(0).to_pylist()])
            for i in range(0, len(X), 4096):
                total += float(row_silhouettes(X[i:i + 4096] - mu, own[i:i + 4096], m, q, size).sum())
            count += len(X)
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([count])], ["s", "n"])

    return (x.mapInArrow(score, "s double, n long")
            .agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.sum("n").alias("rows")))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("nij"))


def ari_nmi_from_table(ct) -> tuple[float, float]:
    """ARI (pair-confusion form) and NMI (arithmetic mean, natural log) of a contingency matrix."""
    ct = np.asarray(ct, dtype=float)
    n = ct.sum()
    ssq = (ct ** 2).sum()
    na, nb = ct.sum(1), ct.sum(0)
    fp = (nb ** 2).sum() - ssq
    fn = (na ** 2).sum() - ssq
    tp = ssq - n
    tn = n * n - fp - fn - ssq
    ari = 1.0 if fn == 0 and fp == 0 else 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    if ct.shape[0] == 1 and ct.shape[1] == 1:
        return float(ari), 1.0
    nz = ct > 0
    mi = float((ct[nz] / n * np.log(ct[nz] * n / np.outer(na, nb)[nz])).sum())
    if abs(mi) < np.finfo(float).eps:
        return float(ari), 0.0
    ha = -float((na / n * np.log(na / n)).sum())
    hb = -float((nb / n * np.log(nb / n)).sum())
    return float(ari), float(mi / ((ha + hb) / 2))


def ari_nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """M-12 / M-13 in one scan and one lazy plan: every cell of the contingency table gets its two margins, and all sums
    over rows, columns and cells are sums over cells (sum of na squared = sum of nij na, and so on)."""
    margin = lambda c: F.sum("nij").over(Window.partitionBy(c))
    cells = contingency(df, a, b).select("nij", margin("a").alias("na"), margin("b").alias("nb"))
    nij, na, nb = F.col("nij"), F.col("na"), F.col("nb")
    sums = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum(nij).alias("n"), F.sum(nij * nij).alias("sq"), F.sum(nij * na).alias("sa"),
                     F.sum(nij * nb).alias("sb"), F.sum(nij * F.log(na)).alias("la"), F.sum(nij * F.log(nb)).alias("lb"),
                     F.sum(nij * F.log(nij)).alias("lab"))
    n = F.coalesce("n", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = sums.select("cells", n.alias("n"), (zero("sq") - n).alias("tp"), (zero("sb") - zero("sq")).alias("fp"),
                    (zero("sa") - zero("sq")).alias("fn"), (n * n - zero("sa") - zero("sb") + zero("sq")).alias("tn"),
                    ((F.col("lab") - F.col("la") - F.col("lb")) / n + F.log(n)).alias("mi"),
                    (F.log(n) - F.col("la") / n).alias("ha"), (F.log(n) - F.col("lb") / n).alias("hb"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    # a mutual information of rounding errors is none
    small = F.abs("mi") < float(np.finfo(float).eps) * F.greatest(F.log(n), F.lit(1.0)) * 4
    nmi = F.when((F.col("cells") <= 1) | (n == 0), F.lit(1.0)).when(small, F.lit(0.0)).otherwise(F.col("mi") * 2 / (F.col("ha") + F.col("hb")))
    return s.select(ari.alias("ari"), nmi.alias("nmi"))


def close_means(df: DataFrame, vec_col: str, cluster_col: str, threshold: float = 0.5) -> DataFrame:
    """J-6 / M-23: distance between every pair of cluster means i < j, which meet in blocks."""
    c = centroids(df, vec_col, cluster_col)
    a = c.select(F.col("cluster").alias("cluster_a"), F.col("centroid").alias("ca"))
    b = c.select(F.col("cluster").alias("cluster_b"), F.col("centroid").alias("cb"))
    pairs = _pairs(a, b, "cluster_b").filter(F.col("cluster_a") < F.col("cluster_b"))
    d = F.sqrt(sq_dist("ca", "cb"))
    return pairs.select("cluster_a", "cluster_b", d.alias("distance"), (d < threshold).alias("close"))
