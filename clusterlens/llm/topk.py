"""Exact top-k search by inner product, a block of vectors at a time.

Vectors are laid out in ranges of similar strongest terms and packed into blocks: a forward index (a matrix of the block's
vectors) and the largest and smallest weight of every term. The sum over terms of a query's weight times that extreme
bounds every score in the block. A query takes blocks in descending order of their bounds, and stops at the first whose
bound is below its k-th score; no vector that could be among its first k is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Vectors of one block.
BLOCK_ROWS = 512
#: Consecutive blocks that give their own queries a first lower bound for the k-th score.
SEED_BLOCKS = 8
#: Queries searched in one pass over the index, and sent to every task together.
PASS_QUERIES = 8192
#: Strongest terms of a vector by which the ranges are laid out.
LEADING_TERMS = 3
#: Vectors of one range at most, about; there are at least two ranges for each core.
RANGE_ROWS = 1 << 20

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
INDEX_SCHEMA = ("block bigint, ids array<bigint>, queries array<boolean>, dims int, vectors binary, "
                "upper binary, lower binary")
QUERY_SCHEMA = "rows binary, ids array<bigint>, dims int, vectors binary, floors binary"
FOUND_SCHEMA = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long (at most what a long holds); null unless all are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _leading(vector: Column, n: int) -> Column:
    """Signed numbers of the strongest terms, strongest first: similar vectors get nearby keys."""
    terms = F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("w"), (F.signum(x) * (i + 1)).cast("int").alias("t")))
    return F.transform(F.slice(F.array_sort(terms), 1, n), lambda s: s["t"])


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors have zeros at the end."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(lengths.max(initial=0))
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _ids(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), values.is_null().to_numpy(zero_copy_only=False)


def build_index(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, scale: int = 64) -> DataFrame:
    """Write the blocks of all valid vectors to the shared folder and return them, one row per block.

    Vectors that are null or hold a null or non-finite component are left out. ``is_query`` marks the rows that are asked
    for; null marks none. Ids are integers, or null. Rows with equal ids stay vectors of their own.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"),
                          quantised(F.col(f"`{vector_col}`"), scale).alias("v")).filter(F.col("v").isNotNull())
    spark = vectors.sparkSession
    ranges = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    keyed = rows.withColumn("key", _leading(F.col("v"), LEADING_TERMS))  # a column, or each comparison would compute it
    size = BLOCK_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = _matrix(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([part.column(0)], pa.list_(pa.int64())),
                     pa.array([part.column(1)], pa.list_(pa.bool_())), pa.array([x.shape[1]], pa.int32()),
                     *[pa.array([m.tobytes()], pa.binary()) for m in (x, x.max(axis=0), x.min(axis=0))]],
                    ["block", "ids", "queries", "dims", "vectors", "upper", "lower"])
                number += 1

    laid = keyed.repartitionByRange(ranges, "key", "id").sortWithinPartitions("key", "id").select("id", "q", "v")
    return stored(laid.mapInArrow(pack, INDEX_SCHEMA))


class _Block:
    """One row of the index."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda name: batch.column(name)[i]
        number, dims = get("block").as_py(), get("dims").as_py()
        self.ids, self.no_id = _ids(get("ids").values)
        self.x = np.frombuffer(get("vectors").as_buffer(), np.int64).reshape(len(self.ids), dims)
        self.upper, self.lower = (np.frombuffer(get(c).as_buffer(), np.int64) for c in ("upper", "lower"))
        self.rows = number * BLOCK_ROWS + np.arange(len(self.ids))
        self.asked = get("queries").values.to_numpy(zero_copy_only=False) if "queries" in batch.schema.names else None


def _fitting(dims: int, most_q: int, most_x: int):
    """The cheapest number type in which every product and every sum of ``dims`` of them is exact."""
    reach = max(1, dims) * max(1, most_q) * max(1, most_x)
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact q @ x.T as int64; vectors of fewer terms have zeros there. Sums beyond 64 bits stay at the limit."""
    n = min(q.shape[1], x.shape[1])
    q, x = q[:, :n], x[:, :n]
    kind = _fitting(n, _largest(q), _largest(x))
    out = q.astype(kind) @ x.astype(kind).T
    return (np.clip(out, _LEAST, _MOST) if kind is object else out).astype(np.int64)


def _bounds(q: np.ndarray, blocks: list[_Block]) -> np.ndarray:
    """Largest possible score of every query in every block: positive weights meet the maxima, negative ones the minima."""
    dims = max([q.shape[1], *[len(b.upper) for b in blocks]])
    pad = lambda rows: np.stack([np.pad(r, (0, dims - len(r))) for r in rows])
    q = np.pad(q, ((0, 0), (0, dims - q.shape[1])))
    up = _products(np.maximum(q, 0), pad([b.upper for b in blocks]))
    down = _products(np.minimum(q, 0), pad([b.lower for b in blocks]))
    with np.errstate(over="ignore"):
        total = up + down
    past = ((up ^ total) & (down ^ total)) < 0  # beyond 64 bits, on the side of both parts
    total = np.where(past, np.where(up > 0, _MOST, _LEAST), total)
    return np.where((up == _MOST) | (down == _MOST), _MOST, total)


class _Best:
    """The k best (score, id) of each query so far, and the least score that can still enter."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.full = np.zeros(len(floors), bool)
        self.kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        self.new: list[list[np.ndarray]] = []
        self.pending = 0

    def add(self, queries, scores, ids, no_id):
        self.new.append([queries, scores, ids, no_id])
        self.pending += len(queries)
        if self.pending > len(self.floors) * self.k:
            self.settle()

    def settle(self):
        if not self.new:
            return
        q, s, i, e = (np.concatenate([old, *[n[c] for n in self.new]]) for c, old in enumerate(self.kept))
        order = np.lexsort((i, e, ~s, q))  # ~s descends without overflow
        q, s, i, e = q[order], s[order], i[order], e[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        last = place == self.k - 1
        self.floors[q[last]] = np.maximum(self.floors[q[last]], s[last])
        self.full[q[last]] = True
        own = place < self.k
        self.kept, self.new, self.pending = [q[own], s[own], i[own], e[own]], [], 0


def _search(blocks: list[_Block], rows: np.ndarray, q: np.ndarray, best: _Best):
    """Score the blocks for all queries, each in its own order of bounds, until the next bound is below its floor."""
    bounds = _bounds(q, blocks)
    order = np.argsort(~bounds, axis=1, kind="stable")
    every = np.arange(len(q))
    alive = every
    for rank in range(len(blocks)):
        pick = order[alive, rank]
        on = bounds[alive, pick] >= best.floors[alive]
        alive, pick = alive[on], pick[on]
        if not len(alive):
            return
        by = np.argsort(pick, kind="stable")
        cuts = np.flatnonzero(np.diff(pick[by])) + 1
        for own in np.split(by, cuts):
            block, who = blocks[pick[own[0]]], alive[own]
            scores = _products(q[who], block.x)
            least = best.floors[who]
            if scores.shape[1] > best.k + 1:  # one of them may be the query itself
                fresh = ~best.full[who]
                at = scores.shape[1] - best.k - 1
                least[fresh] = np.maximum(least[fresh], np.partition(scores[fresh], at, axis=1)[:, at])
            a, b = np.nonzero(scores >= least[:, None])
            other = rows[who[a]] != block.rows[b]
            a, b = a[other], b[other]
            best.add(who[a], scores[a, b], block.ids[b], block.no_id[b])


def _asked(index: DataFrame, k: int) -> DataFrame:
    """The queries in packs, each with a lower bound of its k-th score: the one among the blocks next to its own."""
    near = SEED_BLOCKS

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, near):
                blocks = [_Block(batch, i) for i in range(first, min(first + near, batch.num_rows))]
                dims = max(b.x.shape[1] for b in blocks)
                asked = [np.flatnonzero(b.asked) for b in blocks]
                if not sum(map(len, asked)):
                    continue
                q = np.concatenate([np.pad(b.x[a], ((0, 0), (0, dims - b.x.shape[1]))) for b, a in zip(blocks, asked)])
                rows = np.concatenate([b.rows[a] for b, a in zip(blocks, asked)])
                ids = np.concatenate([b.ids[a] for b, a in zip(blocks, asked)])
                no_id = np.concatenate([b.no_id[a] for b, a in zip(blocks, asked)])
                best = _Best(np.full(len(q), _LEAST, np.int64), k)
                _search(blocks, rows, q, best)
                best.settle()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.astype(np.int64).tobytes()], pa.binary()),
                     pa.array([pa.array(ids, mask=no_id)], pa.list_(pa.int64())), pa.array([dims], pa.int32()),
                     pa.array([q.tobytes()], pa.binary()), pa.array([best.floors.tobytes()], pa.binary())],
                    ["rows", "ids", "dims", "vectors", "floors"])

    return stored(index.mapInArrow(take, QUERY_SCHEMA))


def _passes(packs: DataFrame, size: int):
    """(rows, ids, has no id, vectors, floors) of at least ``size`` queries at a time (the last: of what is left)."""
    held, n = [], 0

    def joined():
        dims = max(h[3].shape[1] for h in held)
        vectors = np.concatenate([np.pad(h[3], ((0, 0), (0, dims - h[3].shape[1]))) for h in held])
        return (*[np.concatenate([h[c] for h in held]) for c in range(3)], vectors, np.concatenate([h[4] for h in held]))

    for r in packs.toLocalIterator(prefetchPartitions=True):
        rows = np.frombuffer(r["rows"], np.int64)
        ids = np.array([0 if i is None else i for i in r["ids"]], np.int64)
        no_id = np.array([i is None for i in r["ids"]], bool)
        held.append((rows, ids, no_id, np.frombuffer(r["vectors"], np.int64).reshape(len(rows), r["dims"]),
                     np.frombuffer(r["floors"], np.int64)))
        n += len(rows)
        if n >= size:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()


def search(index: DataFrame, k: int, pass_queries: int = PASS_QUERIES) -> DataFrame:
    """Each query's ``k`` best other rows: query_row, query_id, rank (from 1), vec_id, score; all rows if there are fewer.

    Highest score first, ties to the smaller id, null ids last. A query is a row, so a repeated query id is answered for
    each of its rows, and another row with the query's id can be found. Queries go through the index in passes of a fixed
    number, so what a task receives does not grow with their count; every pass writes its own answers.
    """
    spark = index.sparkSession
    packs = _asked(index, k)
    out = f"{shared_dir(spark)}/clusterlens-{uuid.uuid4().hex}"
    spark.createDataFrame([], FOUND_SCHEMA).withColumn("rank", F.lit(1)).write.parquet(out)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    for queries in _passes(packs, pass_queries):
        sent = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, ids, no_id, q, floors = sent.value  # noqa: B023
            best = _Best(floors, k)
            for batch in batches:
                _search([_Block(batch, i) for i in range(batch.num_rows)], rows, q, best)
            best.settle()
            who, scores, found, unnamed = best.kept
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[who]), pa.array(ids[who], mask=no_id[who]), pa.array(found, mask=unnamed), pa.array(scores)],
                ["query_row", "query_id", "vec_id", "score"])

        near = index.drop("queries").mapInArrow(run, FOUND_SCHEMA)
        near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).write.mode("append").parquet(out)
        sent.destroy()
    return spark.read.schema(FOUND_SCHEMA + ", rank int").parquet(out)


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int, scale: int = 64) -> DataFrame:
    """Build the index and search it: query_id, rank, vec_id, score.

    Weights are floor(scale * x). Vectors that are null or hold null or non-finite components neither ask nor answer;
    an empty vector scores 0 with every other; a shorter one has zeros at its end. Scores are exact; beyond 64 bits they
    stay at the limit. An empty table, or one without queries, gives no rows; extra columns are ignored.
    """
    return search(build_index(vectors, id_col, vector_col, is_query, scale), k).select("query_id", "rank", "vec_id", "score")
