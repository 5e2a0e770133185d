"""N-gram Jaccard join: MinHash bands propose candidates, full n-gram sets decide, hot groups are compared in blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

N_GRAM, THRESHOLD = 5, 0.8
#: Share of pairs at the threshold that some band must bring together.
TARGET_RECALL = 0.9995
#: Rows of a band: the more, the fewer unlike texts meet; the number of bands follows from the recall.
ROWS = 8
#: A candidate group is compared in blocks of about so many sets and n-grams.
BLOCK_SETS, BLOCK_GRAMS = 2048, 2_000_000
#: Texts whose full sets are handed on at a time.
FULL_ROWS = 512

_SPACES = bytes(32 if c in (9, 10, 11, 12, 13, 32) else c for c in range(256))


def bands_for(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, rows: int = ROWS) -> int:
    """Bands so that two sets at the threshold share one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


class _Words:
    """Hashes of words, remembered while their words take less than ``room`` bytes. Lives as long as one task's stream."""

    def __init__(self, room: int = 8 << 20):
        self.known: dict[bytes, int] = {}
        self.room, self.held = room, 0

    def of(self, words: list[bytes]) -> np.ndarray:
        get, miss = self.known.get, self._miss
        return np.array([get(w) or miss(w) for w in words], np.uint64)

    def _miss(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.held += len(word) + 100
        if self.held > self.room:
            self.known.clear()
            self.held = len(word) + 100
        self.known[word] = h
        return h


def shingles(text: bytes, n: int = N_GRAM, words: _Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``n`` words; a shorter text is one run; none without words."""
    own = [w for w in text.translate(_SPACES).split(b" ") if w]
    if not own:
        return np.zeros(0, np.uint64)
    h = (words or _Words()).of(own)
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[i:len(h) - k + 1 + i]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)) ^ np.uint64(k))


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):  # blocks that stay in the cache
        t = x[i:i + 512, None] * a
        t += b
        np.minimum(out, t.min(axis=0), out=out)
    return out


def _sets(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``key`` (digest of the set; null without words), ``n_grams`` and ``bands`` of every document.

    A band is the hash of its number and its rows of the signature. Equal sets of one batch give their bands once.
    """
    rng = np.random.default_rng(20_240)
    a = (rng.integers(0, 1 << 31, bands * rows, dtype=np.int64) * 2 + 1).astype(np.uint32)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.int64).astype(np.uint32)

    def band_hashes(grams):
        part = _signature(grams, a, b).reshape(bands, rows).astype(np.uint64)
        h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(rows):
            h = (h ^ part[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h.view(np.int64)

    def run(batches):
        words = _Words()
        for batch in batches:
            keys, sizes, hashes, seen = [], [], [], set()
            for t in batch.column(1):
                grams = shingles(t.as_py() or b"", n, words)
                key = _digest(grams) if len(grams) else None
                keys.append(key)
                sizes.append(len(grams))
                hashes.append(None if key is None or key in seen else band_hashes(grams))
                seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "key", "n_grams", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, key binary, n_grams int, bands array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (least node of its connected component) for all nodes of ``edges`` (``a``, ``b``).

    Alternates large and small stars: each node hangs its larger neighbours, then its smaller ones, on the least node
    it sees. Every round is written to the shared folder; rounds grow with the logarithm of the longest chain. Per
    node only the least neighbour is aggregated, so a hot node never gathers its neighbours in one task.
    """
    link = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = link.unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.join(least, "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct())
        large = stored(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
                 .filter(F.col("a") != F.col("b")).distinct())
        small = stored(small)
        # a star forest: every node has one parent, and no parent has one
        parents = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        chained = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        link = small
        if parents <= 1 and not chained:
            break
    return link.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        link.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def link_matrix(sets: list[np.ndarray], split: int | None, num: int, den: int) -> np.ndarray:
    """Which pairs of sets have Jaccard similarity num / den or more, from exact intersection sizes.

    With ``split`` the pairs of the first so many sets (rows) with the others (columns), else all pairs of the list.
    Frequent n-grams are counted by a product of 0/1 matrices, a block of columns at a time; rare ones by their pairs.
    """
    total = len(sets)
    size = np.array([len(x) for x in sets])
    nl, at0 = (total, 0) if split is None else (split, split)
    grams, row = np.concatenate(sets), np.repeat(np.arange(total), size)
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(grams)))
    shared = np.zeros((nl, total - at0), np.float32)
    often = np.flatnonzero(count > 32)
    for c in np.unique(count[(count > 1) & (count <= 32)]):
        at = start[count == c]
        for i in range(c):
            for j in range(i + 1, c):  # the rows of one n-gram ascend
                p, q = row[at + i], row[at + j]
                if split is not None:
                    ok = (p < nl) & (q >= nl)
                    p, q = p[ok], q[ok] - at0
                np.add.at(shared, (p, q), 1)
    if split is None:
        shared += shared.T.copy()
    for k in range(0, len(often), 1024):
        cols = often[k:k + 1024]
        n = count[cols]
        at = np.repeat(start[cols] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        m = np.zeros((total, len(cols)), np.float32)
        m[row[at], np.repeat(np.arange(len(cols)), n)] = 1
        shared += m[:nl] @ m[at0:].T
    both = np.rint(shared).astype(np.int64)
    return (both > 0) & (both * den >= num * (size[:nl, None] + size[None, at0:] - both))


def _local_roots(link: np.ndarray, n: int) -> np.ndarray:
    """Least node of each node's component in a symmetric boolean matrix."""
    root = np.full(n, -1)
    for s in range(n):
        if root[s] < 0:
            front = np.array([s])
            root[s] = s
            while len(front):
                reach = link[front].any(axis=0) & (root < 0)
                front = np.flatnonzero(reach)
                root[front] = s
    return root


def _compare(rows: dict, own: bool, num: int, den: int):
    """Links within one block (``own``) or between two: (key, links, root key) of each set that has one.

    ``rows`` maps (side, key) to the bytes of the set, so repeated documents count once.
    """
    at = sorted(rows)
    keys, sets = [k for _, k in at], [np.frombuffer(rows[x], np.uint64) for x in at]
    if own:
        link = link_matrix(sets, None, num, den)
        np.fill_diagonal(link, False)
    else:
        nl = sum(side == 0 for side, _ in at)
        if nl in (0, len(at)):
            return []
        link = np.zeros((len(at), len(at)), bool)
        link[:nl, nl:] = link_matrix(sets, nl, num, den)
        link[nl:, :nl] = link[:nl, nl:].T
    n_links, root = link.sum(axis=1), _local_roots(link, len(at))
    return [(keys[i], int(n_links[i]), keys[root[i]]) for i in np.flatnonzero(n_links)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_GRAM,
                    threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id``, ``n_links``, ``class_key`` (binary), ``n_grams``.

    Texts with the same set of ``n``-word runs are one; two different sets are linked if their Jaccard similarity is
    ``threshold`` or more. A class is a connected component of links and takes the least id in it; ``n_links`` counts
    the other sets that the document's set is linked to (copies are not counted). Similarity is always decided on the
    full sets; a linked pair is missed only if no band brings its group together, which ``recall`` bounds.

    Sets that share a band fall into one candidate group (a component over bands). Groups up to a block are compared
    by one task; larger ones are cut into blocks, and every pair of blocks is a task of bounded size that hands on
    counts and roots, never pairs. Texts without a word are classes of their own with no link, null texts too. Null
    ids are ordinary ids that come last; repeated ids stay rows. Empty tables give an empty result.
    """
    bands = bands_for(threshold, recall)
    num, den = _fraction(threshold)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    sets = stored(_sets(base, n, bands, ROWS))
    band = sets.select("key", F.explode("bands").alias("band"))
    least = band.groupBy("band").agg(F.min("key").alias("b"), F.max("key").alias("z")).filter(F.col("b") != F.col("z"))
    groups = stored(components(band.join(least, "band").filter(F.col("key") != F.col("b")).select(F.col("key").alias("a"), "b")))
    # every candidate set with its group, its block and one document that holds it
    place = (sets.join(groups, sets["key"] == groups["node"])
             .groupBy("key", "root").agg(F.min("doc_id").alias("id"), F.first("n_grams").alias("n")))
    sizes = place.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_GRAMS)).cast("int")
    place = stored(place.join(sizes.select("root", blocks.alias("blocks")), "root")
                   .withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("n"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, FULL_ROWS):
                part = batch.slice(at, FULL_ROWS)
                grams = [shingles(t.as_py() or b"", n, words) for t in part.column(0)]
                fits = pa.array([_digest(g) == k.as_py() for g, k in zip(grams, part.column(1))], pa.bool_())
                out = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([g.tobytes() for g in grams], pa.binary())],
                                                 ["key", "root", "blocks", "own", "grams"])
                yield out.filter(fits)

    # the same plan at every size: whole texts meet their candidates by a shuffle
    placed = (base.join(place.hint("merge"), base["doc_id"].eqNullSafe(place["id"])).select("text", "key", "root", "blocks", "own")
              .mapInArrow(full, "key binary, root binary, blocks int, own int, grams binary"))
    # each set meets every block once: (i, j) with i <= j, side 0 if the set's own block is i
    tasks = (placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "key", "grams"))
    linked = stored(_by_group(tasks, num, den))
    roots = components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_set = (linked.groupBy("node").agg(F.sum("links").alias("n_links"))
               .join(roots, "node").select(F.col("node").alias("key"), "n_links", F.col("root").alias("class_key")))
    rows = sets.drop("bands").join(per_set, "key", "left").withColumn("class_key", F.coalesce("class_key", "key"))
    rows = stored(rows)
    ids = rows.filter(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    return rows.join(ids, "class_key", "left").select(
        "doc_id", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_key", "n_grams")


def _by_group(tasks: DataFrame, num: int, den: int) -> DataFrame:
    """Compare each (root, i, j): rows of a task come sorted, so one group after the other is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, {}

        def done():
            out = _compare(rows, current[1] == current[2], num, den) if len(rows) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()),
                     pa.array([r[2] for r in out], pa.binary())], ["node", "links", "other"])

        for batch in batches:
            root, i, j, side, node, grams = (c.to_pylist() for c in batch.columns)
            for k in range(batch.num_rows):
                at = (root[k], i[k], j[k])
                if at != current:
                    if rows:
                        yield from done()
                    current, rows = at, {}
                rows[side[k], node[k]] = grams[k]
        if rows:
            yield from done()

    return (tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
            .mapInArrow(run, "node binary, links bigint, other binary"))


def _fraction(x: float) -> tuple[int, int]:
    from fractions import Fraction
    f = Fraction(str(x))
    return f.numerator, f.denominator
