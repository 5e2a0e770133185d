"""Suffix-array dedup: repeated byte strings across documents, by two-stage suffix sorting within content-defined parts.

Every 100-byte string holds one k-gram that is its minimiser, and equal strings hold the same one at the same place. So
the strings are dealt out by minimiser, and only strings whose minimiser occurs elsewhere too are sorted. Each task
sorts the suffixes of its strings in two stages and compares neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import stored
from .merkle import numbered

LENGTH, GRAM = 100, 32
#: Bytes of text that a task scans at once (its arrays stay in the cache), and bytes whose suffixes it sorts at once.
SCAN_BYTES, SORT_BYTES = 1 << 16, 1 << 20
#: Bytes of runs that a task settles at once, and runs that it hands on at once. Runs travel in buckets by their minimisers:
#: packed, as a row for each run would cost more than all work on it; many, so that one bucket fits into memory.
RUN_BYTES, RUNS, BUCKET_BITS = 8 << 20, 1 << 18, 13
#: Buckets of documents, by which what is found of their runs comes to them: packed likewise.
DOC_BITS = 12
#: A minimiser with more different surroundings is dealt out by the strings themselves, 100 bytes for each.
HOT_CONTEXTS = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(7)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Scanner:
    """Minimiser runs of a buffer: the starts of strings that share a minimiser, with hashes of gram and surroundings."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.wide = length, gram, length - gram + 1
        self.up, self.down = _powers(SCAN_BYTES + 2 * length + 2)

    def __call__(self, buf: np.ndarray, valid: np.ndarray, doc: np.ndarray):
        """``valid``: starts whose string lies in one document; ``doc``: their documents. Returns h, c, doc, first, last."""
        n = len(buf)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buf] * self.up[:n], out=sums[1:])
        grams = _mix((sums[self.gram:] - sums[:-self.gram]) * self.down[:n - self.gram + 1])
        key = (grams & ~np.uint64(0x1FFFFF)) | np.arange(len(grams), dtype=np.uint64)
        step, least = 1, key
        while step * 2 <= self.wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < self.wide:
            least = np.minimum(least[:len(least) - (self.wide - step)], least[self.wide - step:])
        at = (least[valid] & np.uint64(0x1FFFFF)).astype(np.int64)
        new = np.ones(len(valid), bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1) | (doc[1:] != doc[:-1])
        lead = np.flatnonzero(new)
        first, last = valid[lead], valid[np.append(lead[1:], len(valid)) - 1]
        span = last + self.length
        around = _mix(((sums[span] - sums[first]) * self.down[first]) ^ (span - first).astype(np.uint64) * _BASE)
        return grams[at[lead]].view(np.int64), around.view(np.int64), doc[lead], first, last


def _pieces(texts: list[bytes], length: int):
    """Runs of documents of about SCAN_BYTES: (bytes, [(document, offset in it, its first byte in the run)])."""
    parts, size = [], 0
    for d, t in enumerate(texts):
        for off in range(0, max(len(t) - length + 1, 0), SCAN_BYTES):
            piece = t[off:off + SCAN_BYTES + length - 1]
            if size and size + len(piece) > SCAN_BYTES:
                yield parts
                parts, size = [], 0
            parts.append((d, off, piece))
            size += len(piece)
    if parts:
        yield parts


def _named(batch: pa.RecordBatch, at: int = 0) -> tuple[np.ndarray, ...]:
    """The columns that name documents, from column ``at`` on, as keys for np.lexsort; null ids come first."""
    ids = batch.column(at)
    return (batch.column(at + 2).to_numpy(), batch.column(at + 1).to_numpy(), pc.fill_null(ids, 0).to_numpy(),
            pc.is_valid(ids).to_numpy(zero_copy_only=False))


def _ranks(key: tuple[np.ndarray, ...]) -> np.ndarray:
    """Places of the documents in their order; equal documents share a rank."""
    order = np.lexsort(key)
    differ = np.zeros(len(order) - 1, bool)
    for k in key:
        differ |= k[order][1:] != k[order][:-1]
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(differ)])
    return rank


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, and where each of its values begins in them and the last ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


#: One long holds whether there is an id (1 bit), the tie (20 bits), the first start (31), the number of starts less one
#: (7) and the mark of a repeat.
def _pack(known, tie, first, more, repeat):
    return (known << 59) | (tie << 39) | (first << 8) | (more << 1) | repeat


def _unpack(p):
    return (p >> 59) & 1, (p >> 39) & 0xFFFFF, (p >> 8) & 0x7FFFFFFF, (p >> 1) & 0x7F


def _bucketed(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each bucket, with the longs of its rows; ``bucket`` is in order."""
    rows = np.stack(columns, 1)
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)]), len(bucket))
    ends = pa.py_buffer((cuts * rows.itemsize * len(columns)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]]), pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, ends, pa.py_buffer(rows)])], names)


def _longs(column: pa.Array, n: int) -> np.ndarray:
    """What ``_bucketed`` has packed, as ``n`` columns."""
    data, begin = _flat(column)
    return np.frombuffer(data[begin[0]:begin[-1]].tobytes(), np.int64).reshape(-1, n).T


def _shared(h: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once."""
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    return order[(np.append(equal, False) | np.append(False, equal))[:len(h)]]


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Minimiser runs of all documents in buckets by h: each has h, c, doc_id (0 for null), name and pack, as longs.

    Of runs with equal gram and surroundings in a batch only the earliest keeps h; the others are marked as repeats.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scanner(length, gram)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _named(batch)
            ties, names, ids, known = key
            texts = [t.as_py() or b"" for t in batch.column(3)]
            rank = _ranks(key)

            def hand_on(found):
                h, c, d, first, more = (np.concatenate(x) for x in zip(*found))
                by = _shared(h)
                by = by[np.lexsort((first[by], rank[d[by]], c[by], h[by]))]
                same = np.zeros(len(by), bool)
                same[1:] = (h[by[1:]] == h[by[:-1]]) & (c[by[1:]] == c[by[:-1]])
                twin = np.zeros(len(by), bool)  # the same place of a document that the table holds twice
                twin[1:] = same[1:] & (rank[d[by[1:]]] == rank[d[by[:-1]]]) & (first[by[1:]] == first[by[:-1]])
                repeat = np.zeros(len(h), np.int64)
                repeat[by[same]] = 1
                again = by[same]
                h[again] = _mix((h[again] ^ names[d[again]] ^ (first[again] << 20)).view(np.uint64)).view(np.int64)  # spread evenly
                keep = np.ones(len(h), bool)
                keep[by[twin]] = False
                bucket = (h.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                order = order[keep[order]]
                d, bucket = d[order], bucket[order]
                pack = _pack(known[d].astype(np.int64), ties[d], first[order], more[order], repeat[order])
                return _bucketed(bucket.astype(np.int32), [h[order], c[order], ids[d], names[d], pack], ["bucket", "runs"])

            found, n = [], 0
            for parts in _pieces(texts, length):
                buf = np.frombuffer(b"".join([p for _, _, p in parts]), np.uint8)
                sizes = np.array([len(p) for _, _, p in parts])
                ends = np.cumsum(sizes)
                counts = sizes - length + 1
                owner = np.repeat(np.arange(len(parts)), counts)
                begin = ends - sizes
                valid = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[owner]
                h, c, p, first, last = scan(buf, valid, owner)
                off = np.array([o for _, o, _ in parts]) - begin
                found.append((h, c, np.array([d for d, _, _ in parts])[p], first + off[p], last - first))
                n += len(h)
                if n >= RUNS:
                    yield hand_on(found)
                    found, n = [], 0
            if found:
                yield hand_on(found)

    return docs.select(*KEY, "text").mapInArrow(run, "bucket int, runs binary")


#: What names a document: its id, and 84 bits of two hashes of its text. It orders documents of one id as well.
KEY = ["doc_id", "name", "tie"]
#: What becomes of a run: it repeats an earlier one whole, or its strings are compared with those of its minimiser, or, if
#: that is a hot one, by themselves.
REPEAT, OPEN, HOT = 0, 1, 2


#: While tables are stored: shuffle files go when their query ends, not when the driver happens to collect its garbage; and
#: rows of an Arrow batch, of which a worker holds some copies.
_WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2500"}


def _released(df: DataFrame) -> DataFrame:
    """``stored`` with these settings."""
    conf = df.sparkSession.conf
    old = {k: conf.get(k, None) for k in _WHILE_STORED}
    try:
        for k, v in _WHILE_STORED.items():
            conf.set(k, v)
        return stored(df)
    finally:
        for k, v in old.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _place(docs: DataFrame) -> DataFrame:
    """Documents with ``place``: twice their bucket and 1; twice the bucket is the place of what was found of them."""
    mixed = F.col("name").bitwiseXOR(F.shiftleft(F.coalesce("doc_id", F.lit(0).cast("bigint")), 64 - DOC_BITS))
    return docs.withColumn("place", (F.shiftrightunsigned(mixed, 64 - DOC_BITS) * 2 + 1).cast("int"))


def _repeated(runs: DataFrame) -> DataFrame:
    """Runs that repeat an earlier one whole, and runs whose gram occurs with other surroundings.

    In buckets of documents; each has doc_id (0 for null), name, h, and pack with what becomes of it above, as longs.
    """
    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        h, c, doc, name, pack = _longs(rows.column(1), 5)
        repeats = np.flatnonzero(pack & 1)
        by = np.flatnonzero(~pack & 1)
        by = by[_shared(h[by])]
        by = by[np.lexsort((pack[by], name[by], doc[by], pack[by] >> 59, c[by], h[by]))]
        new_h, new_c = np.ones(len(by), bool), np.ones(len(by), bool)
        new_h[1:] = h[by[1:]] != h[by[:-1]]
        new_c[1:] = new_h[1:] | (c[by[1:]] != c[by[:-1]])
        # a row that equals the first of its surroundings is the same document given twice
        lead = by[np.maximum.accumulate(np.where(new_c, np.arange(len(by)), 0))]
        twin = (doc[by] == doc[lead]) & (name[by] == name[lead]) & (pack[by] >> 8 == pack[lead] >> 8)
        group = np.cumsum(new_h) - 1
        kinds = np.bincount(group, weights=new_c)[group]
        need = new_c & (kinds > 1)
        repeats = np.append(repeats, by[~new_c & ~twin])
        at = np.append(repeats, by[need])
        kind = np.append(np.full(len(repeats), REPEAT), np.where(kinds[need] > HOT_CONTEXTS, HOT, OPEN))
        bucket = ((name[at] ^ (doc[at] << (64 - DOC_BITS))).view(np.uint64) >> np.uint64(64 - DOC_BITS)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        return _bucketed(bucket.astype(np.int32) * 2, [doc[at], name[at], h[at], pack[at] | (kind[order] << 60)], ["place", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < RUN_BYTES:
                continue
            rows = pa.concat_batches(held)
            bucket = rows.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if cut:
                yield settle(rows.slice(0, cut))
            held = [rows.slice(cut)]
            size = held[0].nbytes
        if held:
            yield settle(pa.concat_batches(held))

    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "place int, runs binary")


def suffix_order(buf: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes of ``buf`` in the order of their first ``depth`` bytes or more; ``buf`` ends with a 0.

    With a mask ``wanted`` only the places it holds: others are sorted only as far as the order of these rests on them.

    Two stages: suffixes smaller than their successors are sorted directly; all others follow from these in one scan
    over the buckets of first bytes, as a suffix larger than its successor has its place right after the place of the
    successor is known.
    """
    n = len(buf)
    places = np.arange(n, dtype=np.int32)
    ends = np.where(buf[1:] != buf[:-1], places[:-1], np.int32(n - 1))
    ends = np.minimum.accumulate(ends[::-1])[::-1]  # where the run of equal bytes ends
    smaller = np.append(buf[np.minimum(ends + 1, n - 1)] >= buf[ends], True)
    needed = np.ones(n, bool)
    if wanted is not None:  # a suffix rests on its successors up to one that is sorted directly
        stop = np.minimum.accumulate(np.where(smaller, places, np.int32(n))[::-1])[::-1]
        since = np.maximum.accumulate(np.where(wanted, places, np.int32(-1)))
        needed = (since >= 0) & (places <= stop[since])
    direct = np.flatnonzero(smaller & needed)
    induced = ~smaller & needed
    padded = np.concatenate([buf, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    heads = np.searchsorted(buf[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def hand_on(places, c):
        before = places[places > 0] - 1
        before = before[induced[before] & (buf[before] > c)]
        if len(before):
            first = buf[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cuts):
                waiting[buf[part[0]]].append(part)

    for c in range(256):
        larger = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(larger):  # runs of one byte: the suffix that begins one earlier comes right behind
            order.append(larger)
            hand_on(larger, c)
            before = larger[larger > 0] - 1
            larger = before[induced[before] & (buf[before] == c)]
        own = direct[heads[c]:heads[c + 1]]
        if len(own):
            order.append(own)
            hand_on(own, c)
    if not order:
        return np.zeros(0, np.int64)
    out = np.concatenate(order)
    return out if wanted is None else out[wanted[out]]


def common_prefixes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``, at most ``limit``."""
    padded = np.concatenate([buf, np.zeros(limit + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = np.full(len(a), limit, np.int64)
    open_ = np.arange(len(a))
    for off in range(0, limit, 8):
        x = words[a[open_] + off] ^ words[b[open_] + off]
        ends = x != 0
        low = x[ends] & (~x[ends] + np.uint64(1))  # lowest set bit
        out[open_[ends]] = np.minimum(off + np.log2(low.astype(np.float64)).astype(np.int64) // 8, limit)
        open_ = open_[~ends]
        if not len(open_):
            break
    return out


def _later_copies(data: np.ndarray, begin: np.ndarray, rank: np.ndarray, length: int):
    """Starts (context, offset) whose string also starts earlier; contexts lie in ``data`` and begin at ``begin``, which
    ends with the end of the last; ``rank`` orders the contexts, equal for one document.

    Third result: of each different string, the contexts that hold its earliest start, for strings that are contexts.
    """
    sizes = np.diff(begin)
    buf = np.append(data, np.uint8(0))
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    wanted = np.append(np.arange(len(data), dtype=np.int32) <= (begin[1:] - length).astype(np.int32)[owner], False)  # strings that end in their context
    order = suffix_order(buf, length, wanted)
    owner = owner[order]
    same = common_prefixes(buf, order[1:], order[:-1], length) >= length
    lead = np.flatnonzero(np.concatenate([[True], ~same]))
    place = rank[owner] + (order - begin[owner])
    least = np.minimum.reduceat(place, lead)
    counts = np.diff(np.append(lead, len(order)))
    later = place != np.repeat(least, counts)
    return owner[later], (order - begin[owner])[later], np.unique(owner[~later])


def _sorted_parts(contexts: DataFrame, length: int) -> DataFrame:
    """Sort the suffixes of all contexts of a key together; returns the starts that repeat an earlier string."""
    def sort(rows: pa.RecordBatch, old: int):
        """The repeats, and the contexts with earliest places; the first ``old`` rows were reported before."""
        data, begin = _flat(rows.column(5))
        first = rows.column(4).to_numpy().astype(np.int64)
        # rows come by key, then document; their order over all keys is by document and place
        owner, off, firsts = _later_copies(data[begin[0]:begin[-1]], begin - begin[0], (_ranks(_named(rows, 1)) << 32) + first, length)
        fresh = owner >= old
        owner, off = owner[fresh], off[fresh]
        by = np.lexsort((off, owner))
        owner, off = owner[by], off[by]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (off[1:] != off[:-1] + 1)
        lead = np.flatnonzero(new)
        end = np.append(lead, len(owner))[1:] - 1
        which = pa.array(owner[lead])
        return pa.RecordBatch.from_arrays(
            [*[rows.column(c).take(which) for c in (1, 2, 3)],
             pa.array((first[owner[lead]] + off[lead]).astype(np.int32)), pa.array((first[owner[lead]] + off[end]).astype(np.int32))],
            [*KEY, "first", "last"]), firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, old = [], 0, 0  # rows not sorted yet, of these the first ``old`` were reported before
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += int(np.ptp(_flat(batch.column(5))[1][[0, -1]]))
            if size < SORT_BYTES:
                continue
            rows = pa.concat_batches(held)
            h, (_, begin) = rows.column(0).to_numpy(), _flat(rows.column(5))
            borders, at = np.flatnonzero(h[1:] != h[:-1]) + 1, 0
            while len(after := borders[begin[borders] - begin[at] >= SORT_BYTES]):
                yield sort(rows.slice(at, after[0] - at), old)[0]
                at, old = int(after[0]), 0
            key = max(at, int(borders[-1])) if len(borders) else at  # where the last key begins
            if begin[-1] - begin[key] >= 4 * SORT_BYTES and (np.diff(begin[key:]) == length).all():
                # a very frequent string: documents come in order, so its earliest places are all that is kept
                found, firsts = sort(rows.slice(at), old)
                yield found
                rows, at = rows.take(pa.array(firsts[firsts >= key - at] + at)), 0
                old, begin = rows.num_rows, _flat(rows.column(5))[1]
            held, size = [rows.slice(at)], int(begin[-1] - begin[at])
        if held:
            yield sort(pa.concat_batches(held), old)[0]

    return (contexts.repartition("h").sortWithinPartitions("h", *KEY, "first")
            .mapInArrow(run, "doc_id bigint, name bigint, tie bigint, first int, last int"))


def _cover(text: bytes, ranges, length: int):
    """n_removed, n_spans, and the digest of what is left, given ranges of starts."""
    gone, spans, at, kept = 0, 0, 0, hashlib.sha256()
    end = -1
    for first, last in sorted(ranges):
        stop = last + length
        if first > end:
            spans += 1
        if stop > end:
            begin = max(first, end, 0)
            kept.update(text[at:begin])
            gone += stop - begin
            at = end = stop
    kept.update(text[at:])
    return gone, spans, kept.hexdigest()


_HALF = ("doc_id bigint, name bigint, tie bigint, n_bytes bigint, text binary, ranges array<struct<first:int,last:int>>, "
         "contexts array<struct<h:bigint,first:int,bytes:binary>>, n_removed bigint, n_spans bigint, kept_sha256 string")
_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_CONTEXT = pa.list_(pa.struct([("h", pa.int64()), ("first", pa.int32()), ("bytes", pa.binary())]))


def _joined(batches: Iterator[pa.RecordBatch]):
    """Texts (place, KEY, text) in the order of their documents, with a number for each document, and what was found of them:
    number of the document, first, last, what becomes of the run, h. Of each bucket all that was found comes before the texts.
    """
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column(0).to_numpy()
        is_text = place % 2 == 1
        held.append(batch.select([0, 5]).filter(pa.array(~is_text)))
        runs = pa.concat_batches(held)
        held = [runs.filter(pc.greater_equal(runs.column(0), int(place[-1]) & ~1))]  # texts of the last bucket may follow
        at = np.flatnonzero(is_text)
        if not len(at):
            continue
        doc, name, h, pack = _longs(runs.column(1), 4)
        known, tie, first, more = _unpack(pack)
        texts = _named(batch.select([1, 2, 3]).take(pa.array(at)))
        rank = _ranks(tuple(np.append(a, b) for a, b in zip(texts, (tie, name, doc, known == 1))))
        numbers, of_text = np.unique(rank[:len(at)], return_inverse=True)
        of = np.minimum(np.searchsorted(numbers, rank[len(at):]), len(numbers) - 1)
        here = numbers[of] == rank[len(at):]
        order = np.argsort(of_text, kind="stable")
        yield (batch.take(pa.array(at[order])), of_text[order], of[here], first[here], (first + more)[here], (pack >> 60)[here], h[here])


def _with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each document's rows of ``docs`` (first null) and then its rows of ``runs``, together in one task."""
    both = docs.withColumn("first", F.lit(None).cast("int")).unionByName(runs, allowMissingColumns=True)
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "first")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows cut between documents, with the number of its document for each row."""
    held = []
    for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
        # of the rows held back only the first is looked at: all are of one document
        rows = pa.concat_batches([held[0].slice(0, 1), batch]) if held else batch
        new = _differ(rows)
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            rows = pa.concat_batches([*held, batch.slice(0, cut - 1)]) if held else batch.slice(0, cut)
            yield rows, np.append(0, np.cumsum(_differ(rows)[1:]))
            held = [batch.slice(cut - 1 if held else cut)]
        else:
            held.append(batch)
    if held:
        rows = pa.concat_batches(held)
        yield rows, np.zeros(rows.num_rows, np.int64)


def _differ(rows: pa.RecordBatch) -> np.ndarray:
    """Rows of another document than the row before."""
    out = np.zeros(rows.num_rows, bool)
    for k in _named(rows):
        out[1:] |= k[1:] != k[:-1]
    return out


def _merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """Ranges of starts whose strings touch, made one: (document, first, last), by document and place."""
    a = (doc << 32) + first
    by = np.argsort(a, kind="stable")
    a, end = a[by], np.maximum.accumulate(((doc << 32) + last + length)[by])
    lead = np.flatnonzero(np.append(True, a[1:] > end[:-1])[:len(a)])
    stop = end[np.append(lead, len(a))[1:] - 1]
    return a[lead] >> 32, a[lead] & 0xFFFFFFFF, (stop & 0xFFFFFFFF) - length


def _string_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes, to deal them out by."""
    up = _powers(rows.shape[1])[0]
    return _mix(np.concatenate([(_TABLE[rows[i:i + 4096]] * up).sum(1, dtype=np.uint64) for i in range(0, len(rows), 4096)])).view(np.int64)


def _contexts(data: np.ndarray, start: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray,
              hot: np.ndarray, length: int):
    """Key, first start, and bytes of the open runs, which begin at ``start`` in ``data``; strings of hot minimisers one by one."""
    strings = (last - first + 1)[hot]
    shift = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    at = np.repeat(start[hot], strings) + shift
    keys = h[:0] if not len(at) else _string_keys(np.lib.stride_tricks.sliding_window_view(data, length)[at])
    cold = ~hot
    doc = np.append(doc[cold], np.repeat(doc[hot], strings))
    by = np.argsort(doc, kind="stable")
    begin = np.append(start[cold], at)
    end = np.append((start + last - first)[cold], at) + length
    raw = data.tobytes()  # Arrow would not let go of slices of a memoryview
    return (doc[by], np.append(h[cold], keys)[by], np.append(first[cold], np.repeat(first[hot], strings) + shift)[by],
            pa.array([raw[x:y] for x, y in zip(begin[by].tolist(), end[by].tolist())], pa.binary()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Removes each byte covered by a ``length``-byte string that also starts earlier: in a document with a smaller id or
    at an earlier place of the same one (null ids come first; documents with the same id and different texts are ordered
    by hashes of the text; rows equal in id and text are one document and get the same result each). Null texts are
    empty. Texts are UTF-8 bytes; strings never cross documents and are judged on the input. Ids of any type that can be
    ordered; other than integers they are numbered in their order first. Extra columns are ignored; an empty table gives
    an empty result. Documents up to 2 GB.

    Text is shuffled once by document, runs of starts by minimiser; a run that equals an earlier one needs no sorting.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    if not isinstance(given.schema["doc_id"].dataType, IntegralType):
        return _with_numbers(given, lambda df: remove_repeats(df, length=length, gram=gram))
    base = given.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("name"),
                        F.shiftrightunsigned(F.xxhash64(F.lit(1), "text"), 44).alias("tie"), F.col("text").cast("binary").alias("text"))
    found = _released(_repeated(_runs(base, length, gram)))

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, doc, of, first, last, kind, h in _joined(batches):
            open_ = kind != REPEAT
            n = doc[-1] + 1
            is_open = np.zeros(n, bool)
            is_open[of[open_]] = True
            data, begin = _flat(whole.column(4))
            r_doc, r_first, r_last = _merged(of[~open_], first[~open_], last[~open_], length)
            r_cut = np.searchsorted(r_doc, np.arange(n + 1))
            lists = pa.ListArray.from_arrays(pa.array(r_cut.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(r_first.astype(np.int32)), pa.array(r_last.astype(np.int32))], fields=list(_RANGE.value_type)))
            text_at = begin[np.searchsorted(doc, of[open_])]  # equal documents hold equal texts: the first will do
            c_doc, key, at, strings = _contexts(
                data, text_at + first[open_], of[open_], first[open_], last[open_], h[open_], kind[open_] == HOT, length)
            parts = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(c_doc, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(key), pa.array(at.astype(np.int32)), strings], fields=list(_CONTEXT.value_type)))
            keep = is_open[doc]
            pick = pa.array(doc, mask=~keep)
            spans = list(zip(r_first.tolist(), r_last.tolist()))
            done = [(None, None, None) if k else _cover(data[x:y].tobytes(), spans[r_cut[d]:r_cut[d + 1]], length)
                    for k, d, x, y in zip(keep.tolist(), doc.tolist(), begin[:-1].tolist(), begin[1:].tolist())]
            removed, n_spans, sha = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [*whole.columns[1:4], pa.array(np.diff(begin)), pc.if_else(pa.array(keep), whole.column(4), pa.scalar(None, whole.column(4).type)),
                 lists.take(pick), parts.take(pick), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
                [*KEY, "n_bytes", "text", "ranges", "contexts", "n_removed", "n_spans", "kept_sha256"])

    both = _place(base).select("place", *KEY, "text").unionByName(found, allowMissingColumns=True)
    half = _released(both.repartition(F.shiftright("place", 1)).sortWithinPartitions("place").mapInArrow(halve, _HALF))
    contexts = half.filter(F.col("contexts").isNotNull())
    if _has_twins(half):
        contexts = contexts.dropDuplicates(KEY)
    contexts = contexts.select(*KEY, F.explode("contexts").alias("x")).select("x.h", *KEY, "x.first", "x.bytes")
    more = _sorted_parts(contexts, length)
    rest = half.filter(F.col("text").isNotNull()).select(*KEY, "n_bytes", "text", "ranges")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, doc in _whole(batches):
            # columns: KEY, text, first, last, n_bytes, ranges
            is_run = pc.is_valid(rows.column(4)).to_numpy(zero_copy_only=False)
            whole = rows.filter(pa.array(~is_run))
            runs, doc, of = rows.filter(pa.array(is_run)), doc[~is_run], doc[is_run]
            settled = whole.column(7)
            own = np.repeat(doc, pc.list_value_length(settled).to_numpy())
            first, last = (np.append(pc.struct_field(settled.flatten(), i).to_numpy(), runs.column(4 + i).to_numpy()).astype(np.int64)
                           for i in (0, 1))
            r_doc, r_first, r_last = _merged(np.append(own, of), first, last, length)
            cut = np.searchsorted(r_doc, np.arange(doc[-1] + 2))
            spans = list(zip(r_first.tolist(), r_last.tolist()))
            out = [_cover(t.as_py(), spans[cut[d]:cut[d + 1]], length) for t, d in zip(whole.column(3), doc.tolist())]
            yield pa.RecordBatch.from_arrays(
                [whole.column(0), whole.column(6), pa.array([x[0] for x in out], pa.int64()),
                 pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = half.filter(F.col("text").isNull()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rest = _with_runs(rest, more).select(*KEY, "text", "first", "last", "n_bytes", "ranges")
    return done.unionByName(rest.mapInArrow(finish, schema))


def _has_twins(half: DataFrame) -> bool:
    """Whether some document with open runs is in the table twice."""
    return half.filter(F.col("text").isNotNull()).groupBy(*KEY).count().filter("count > 1").limit(1).count() > 0


def _with_numbers(docs: DataFrame, work) -> DataFrame:
    """``work`` on ``docs`` with ids replaced by their places in order, and the ids put back. Null ids stay null."""
    known = docs.filter(F.col("doc_id").isNotNull())
    ids = stored(numbered(known.select(F.lit(0).alias("all"), "doc_id").distinct(), "all", ["doc_id"]).select(
        F.col("doc_id").alias("id"), "pos"))
    out = work(known.join(ids, known["doc_id"] == ids["id"]).select(F.col("pos").alias("doc_id"), "text").unionByName(
        docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("bigint").alias("doc_id"), "text")))
    rest = [c for c in out.columns if c != "doc_id"]
    named = out.filter(F.col("doc_id").isNotNull()).join(ids, F.col("doc_id") == F.col("pos")).select(F.col("id").alias("doc_id"), *rest)
    none = F.lit(None).cast(ids.schema["id"].dataType).alias("doc_id")
    return named.unionByName(out.filter(F.col("doc_id").isNull()).select(none, *rest))
