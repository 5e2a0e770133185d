"""Benchmark decontamination: a distributed positional inverted index, searched for phrases from their rarest terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of text in one index segment, about (a longer document is a segment of its own).
SEGMENT_BYTES = 256 << 10
#: Test words in one block of queries; every block is one pass over the stored index.
BLOCK_WORDS = 200_000
#: Distinct test terms up to which the index keeps only postings of these; beyond, it keeps all.
VOCABULARY_BOUND = 1_000_000
WINDOW = 13

#: Byte table of the contract's tokenizer: A-Z lower-cased, digits, a-z and bytes over 127 kept, the rest a separator.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

SEGMENT_SCHEMA = ("segment bigint, ids array<{}>, n_words array<int>, terms array<binary>, "
                  "starts array<int>, positions array<int>")
MATCH_SCHEMA = "segment bigint, ordinal int, query bigint, start int, end int"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _segment(number, ids, texts, vocabulary):
    """Postings of one run of documents: a document's positions follow the last one's with a gap of one."""
    tokens, counts = [], []
    for t in texts:
        w = words(t)
        counts.append(len(w))
        tokens += w
    if vocabulary is None:
        numbering: dict[bytes, int] = {}
        codes = np.fromiter((numbering.setdefault(w, len(numbering)) for w in tokens), np.int32, len(tokens))
        terms = list(numbering)
    else:
        get = vocabulary.get
        codes = np.fromiter((get(w, -1) for w in tokens), np.int32, len(tokens))
        terms = None
    del tokens
    n_words = np.array(counts, np.int32)
    at = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(counts), dtype=np.int32), n_words)
    known = codes >= 0
    codes, at = codes[known], at[known]
    order = np.argsort(codes, kind="stable")
    codes, at = codes[order], at[order]
    used, starts = np.unique(codes, return_index=True)
    if terms is None:
        names = vocabulary["__names__"]
        terms = [names[i] for i in used]
    else:
        terms = [terms[i] for i in used]
    return number, ids, n_words, terms, np.append(starts, len(codes)).astype(np.int32), at


def _as_batch(rows):
    number, ids, n_words, terms, starts, at = zip(*rows)
    lists = lambda xs, t: pa.array([pa.array(x, t) if isinstance(x, list) else x for x in xs], pa.list_(t))
    return pa.RecordBatch.from_arrays(
        [pa.array(number, pa.int64()), *[pa.array([x], pa.list_(x.type)) for x in ids], lists(n_words, pa.int32()),
         lists(terms, pa.binary()), lists(starts, pa.int32()), lists(at, pa.int32())],
        ["segment", "ids", "n_words", "terms", "starts", "positions"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                vocabulary: list[bytes] | None = None) -> DataFrame:
    """Write the positional index of ``docs`` to the shared folder and return it, one row per segment.

    A segment holds whole documents, about ``SEGMENT_BYTES`` of text: their ids and word counts, its terms, and for
    each term the sorted positions. Documents spread evenly over segments, so no term, however frequent, gathers in one
    task. ``vocabulary`` restricts the postings to terms that will be asked for; ``None`` keeps all. Null texts count
    as empty. Ids are of any type; repeated and null ids stay documents of their own.
    """
    names = None if vocabulary is None else {**{w: i for i, w in enumerate(vocabulary)}, "__names__": vocabulary}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            size, first = 0, 0
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for i, n in enumerate(lengths):
                size += n
                if size >= SEGMENT_BYTES or i == len(lengths) - 1:
                    part = [t or b"" for t in texts.slice(first, i + 1 - first).to_pylist()]
                    yield _as_batch([_segment(number, ids.slice(first, i + 1 - first), part, names)])
                    number, size, first = number + 1, 0, i + 1

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return stored(rows.mapInArrow(build, SEGMENT_SCHEMA.format(rows.schema["id"].dataType.simpleString())))


class _Queries:
    """A block of phrases, grouped by length: a matrix of term numbers and the queries that hold each phrase."""

    def __init__(self, phrases: list[tuple[int, tuple[bytes, ...]]]):
        numbering: dict[bytes, int] = {}
        by: dict[tuple[int, ...], set[int]] = {}
        for query, phrase in phrases:
            by.setdefault(tuple(numbering.setdefault(w, len(numbering)) for w in phrase), set()).add(query)
        self.terms = numbering
        self.groups = []
        for n in sorted({len(p) for p in by}):
            own = [p for p in by if len(p) == n]
            self.groups.append((np.array(own, np.int32), [sorted(by[p]) for p in own]))


def _near(wanted: np.ndarray, postings: np.ndarray, slop: int) -> np.ndarray:
    """Which wanted positions have a posting at most ``slop`` away."""
    at = np.searchsorted(postings, wanted - slop)
    found = at < len(postings)
    found[found] = postings[at[found]] <= wanted[found] + slop
    return found


def _search_segment(row, queries: _Queries, slop: int):
    """(document ordinal, query, start, end) of all matches; overlapping spans of one query in a document are merged."""
    number, n_words, terms, starts, positions = row
    lists: list[np.ndarray | None] = [None] * len(queries.terms)
    frequency = np.zeros(len(queries.terms), np.int64)
    get = queries.terms.get
    for i, t in enumerate(terms):
        k = get(t)
        if k is not None:
            lists[k] = positions[starts[i]:starts[i + 1]]
            frequency[k] = starts[i + 1] - starts[i]
    first = np.concatenate([[0], np.cumsum(n_words + 1)[:-1]]) if len(n_words) else np.zeros(0, np.int64)
    found = []
    for phrases, holders in queries.groups:
        counts = frequency[phrases]
        length = phrases.shape[1]
        for k in np.flatnonzero(counts.min(axis=1) > 0):
            rarest = np.argsort(counts[k], kind="stable")
            begin = lists[phrases[k, rarest[0]]] - rarest[0]
            for off in rarest[1:]:
                begin = begin[_near(begin + off, lists[phrases[k, off]], slop)]
                if not len(begin):
                    break
            if len(begin) and slop:  # all terms near their places: keep what lies within one document
                doc = np.searchsorted(first, np.maximum(begin, 0), "right") - 1
                begin = begin[(begin >= first[doc] - slop) & (begin + length <= first[doc] + n_words[doc] + slop)]
            for q in holders[k] if len(begin) else ():
                found.append(np.stack([np.full(len(begin), q, np.int64), begin, begin + length], axis=1))
    if not found:
        return None
    m = np.concatenate(found).astype(np.int64)
    m[:, 1] = np.maximum(m[:, 1], 0)
    doc = np.searchsorted(first, m[:, 1], "right") - 1
    m[:, 1] -= first[doc]
    m[:, 2] = np.minimum(m[:, 2] - first[doc], n_words[doc])
    order = np.lexsort((m[:, 1], m[:, 0], doc))
    m, doc = m[order], doc[order]
    new = np.ones(len(m), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (m[1:, 0] != m[:-1, 0])
    new[1:] |= m[1:, 1] > m[:-1, 2]  # the phrases of a query are equally long, so ends ascend with starts
    lead = np.flatnonzero(new)
    return doc[lead], m[lead, 0], m[lead, 1], np.maximum.reduceat(m[:, 2], lead), number


def search(index: DataFrame, phrases: list[tuple[int, tuple[bytes, ...]]], slop: int = 0) -> DataFrame:
    """Matches of one block of ``(query id, terms)`` in all segments: segment, ordinal of the document, query, start, end.

    Each phrase starts from the postings of its rarest term in the segment; the lists of the others, rarest first, are
    intersected after shifting them by their offset. ``slop`` 0 finds exact phrases; with ``slop`` s every term may lie up to s
    words from its place, in any order. Positions count words, end exclusive; overlapping matches of a query are merged.
    """
    queries = _Queries(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                out = _search_segment((batch.column(0)[i].as_py(), values(1), batch.column(2)[i].as_py(),
                                       values(3), values(4)), queries, slop)
                if out is not None:
                    doc, query, start, end, number = out
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(doc), number, np.int64)), pa.array(doc.astype(np.int32)), pa.array(query),
                         pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))],
                        ["segment", "ordinal", "query", "start", "end"])

    return (index.select("segment", "n_words", "terms", "starts", "positions").mapInArrow(run, MATCH_SCHEMA))


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The test set in blocks of bounded size; only one block is on the driver at a time."""
    block, size = [], 0
    rows = items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")) \
        .filter(F.col("t").isNotNull())
    for r in rows.toLocalIterator():
        w = words(r["t"].encode())
        if w:
            block.append((r["i"], w))
            size += len(w)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def windows_of(w: list[bytes], n: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``n`` words; a shorter text is one window."""
    return [tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (array of item ids as text, sorted).

    The index of ``docs`` is written once and searched for every window of every item, block by block. ``n_hit`` counts
    the words inside any occurrence of a window. Null texts have no words; items without a word are no window, and
    equal item ids count once (a null item id counts as the text ``null``). Documents with the same id, or none, stay
    rows of their own. Empty tables give no rows, or rows without hits. Extra columns are ignored.
    """
    terms = _vocabulary(items, item_text_col)
    index = build_index(docs, id_col, text_col, terms)
    total = None
    names = items.sparkSession
    for block in _blocks(items, item_id_col, item_text_col):
        phrases = [(k, p) for k, (_, w) in enumerate(block) for p in windows_of(w, window)]
        ids = names.createDataFrame([(k, "null" if i is None else str(i)) for k, (i, _) in enumerate(block)],
                                    "query bigint, item string")
        found = stored(search(index, phrases).join(F.broadcast(ids), "query").drop("query"))
        total = found if total is None else total.unionByName(found)
    listed = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("ordinal", "d")).select(
        "segment", "ordinal", F.col("d.ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if total is None:
        return listed.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    key = ["segment", "ordinal"]
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = (total.withColumn("gain", F.greatest(F.col("end") - reach, F.lit(0)))
            .groupBy(*key).agg(F.sum("gain").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")))
    return listed.join(hits, key, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"))


def _vocabulary(items: DataFrame, text_col: str) -> list[bytes] | None:
    """Distinct terms of the test set, ``None`` if there are more than the bound."""
    low = F.translate(F.col(f"`{text_col}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = (items.select(F.explode(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)).alias("t"))
             .filter(F.length("t") > 0).distinct().limit(VOCABULARY_BOUND + 1).collect())
    return None if len(terms) > VOCABULARY_BOUND else sorted(r["t"].encode() for r in terms)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """Fixed rule of the contract: some hit, and at least a twentieth of the words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
