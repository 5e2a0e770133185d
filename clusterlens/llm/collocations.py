"""Phrase collocations by prefix-free parsing.

Texts are parsed into overlapping chunks: a chunk ends where the hash of the last words is a trigger, and the next one
begins with these words, so equal passages are cut alike wherever they stand. Equal chunks meet in a dictionary with
their frequency, and n-grams are counted inside distinct chunks, weighted by it. An n-gram belongs to the chunk in which
it starts before the overlap, so each occurrence counts once.

Long n-grams are counted only where all shorter ones inside them are frequent. A bit array of fixed size keeps the hashes
of frequent n-grams: it may let rare ones pass (they are counted, then dropped), it never stops a frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A window of words ends a chunk if its hash is divisible by this: the mean length of a chunk.
TRIGGER = 32
#: Bits of the array of frequent n-grams (a fixed size: the larger, the fewer rare n-grams are counted in vain).
FILTER_BITS = 1 << 26
#: Bytes of text that a task takes at a time.
STEP_BYTES = 2 << 20

#: Stands between the pieces of a text; no byte of UTF-8.
_BREAK = b"\xff"
#: Byte table of the contract: A-Z lower-cased, ``.,;:!?`` and line ends are breaks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Words of a text, with breaks between its pieces."""
    text = text.translate(_TABLE).replace(b"\xff\xff", _BREAK)
    return text.replace(_BREAK, b" \xff ").split()


def _numbered(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Tokens as numbers, and the distinct tokens; a break is number 0."""
    numbering = {_BREAK: 0}
    codes = np.fromiter((numbering.setdefault(w, len(numbering)) for w in tokens), np.int64, len(tokens))
    return codes, list(numbering)


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))


def _rolled(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of words."""
    out = np.full(len(hashes[0]), 0x243F6A8885A308D3, np.uint64)
    with np.errstate(over="ignore"):
        for h in hashes:
            out = (out ^ h) * _MIX
            out ^= out >> np.uint64(29)
    return out


def cuts(codes: np.ndarray, hashes: np.ndarray, ends: np.ndarray, overlap: int, trigger: int) -> np.ndarray:
    """Where chunks begin in texts that lie end to end, each followed by ``overlap`` breaks (``ends``: behind these)."""
    begins = np.concatenate([[0], ends[:-1]])
    if len(codes) <= overlap:
        return begins
    h = hashes[codes]
    n = len(codes) - overlap + 1
    hit = _rolled([h[i:n + i] for i in range(overlap)]) % np.uint64(trigger) == 0
    hit[begins] = True
    for back in range(1, overlap + 1):  # the closing breaks begin no chunk
        last = ends - back
        hit[last[last < n]] = False
    return np.flatnonzero(hit)


def chunks(texts: list[bytes], overlap: int, trigger: int) -> tuple[list[bytes], np.ndarray]:
    """The chunks of all texts in order, and how many each text has; consecutive ones share ``overlap`` tokens."""
    tokens: list[bytes] = []
    ends = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = words(t)
        if own:
            tokens += own
            tokens += [_BREAK] * overlap
        ends[i] = len(tokens)
    real = np.unique(ends[ends > 0])
    if not len(real):
        return [], np.zeros(len(texts), np.int64)
    codes, names = _numbered(tokens)
    at = cuts(codes, _hashes(names), real, overlap, trigger)
    text_end = real[np.searchsorted(real, at, "right")]
    stop = np.minimum(np.append(at[1:], len(tokens)) + overlap, text_end)
    out = [b" ".join(tokens[a:b]) for a, b in zip(at.tolist(), stop.tolist())]
    return out, np.diff(np.concatenate([[0], np.searchsorted(at, ends)]))


BLOCK_SCHEMA = "group string, names binary, hashes binary, codes binary, lengths binary, freq binary"


def build_dictionary(docs: DataFrame, text: Column, group: Column, max_words: int = 3, trigger: int = TRIGGER) -> DataFrame:
    """Write the distinct chunks of all texts with their frequencies, in blocks of numbered tokens of one group each.

    The last ``max_words - 1`` tokens of a chunk are its overlap with the next one (breaks at the end of a text). A null
    text has no chunk.
    """
    overlap, step = max_words - 1, STEP_BYTES

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(groups, texts):
            found, n = chunks(texts, overlap, trigger)
            counts: dict[tuple[str, bytes], int] = {}
            for key in zip(np.repeat(np.array(groups, object), n), found):
                counts[key] = counts.get(key, 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()),
                     pa.array(list(counts.values()), pa.int64())], ["group", "chunk", "freq"])

        groups, texts, size = [], [], 0
        for batch in batches:
            for g, t in zip(batch.column(0), batch.column(1)):
                groups.append(g.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size > step:
                    yield from out(groups, texts)
                    groups, texts, size = [], [], 0
        yield from out(groups, texts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def out():
            for group, (texts, freq) in held.items():
                codes, names = _numbered(b" ".join(texts).split(b" "))
                lengths = np.fromiter((t.count(b" ") + 1 for t in texts), np.int32, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group], pa.string()), *[pa.array([x], pa.binary()) for x in (
                        b" ".join(names[1:]), _hashes(names).tobytes(), codes.astype(np.int32).tobytes(), lengths.tobytes(),
                        np.array(freq, np.int64).tobytes())]],
                    ["group", "names", "hashes", "codes", "lengths", "freq"])

        for batch in batches:
            for g, c, f in zip(*(batch.column(i) for i in range(3))):
                texts, freq = held.setdefault(g.as_py(), ([], []))
                texts.append(c.as_py())
                freq.append(f.as_py())
                size += len(texts[-1])
                if size >= step:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    rows = docs.select(group.cast("string").alias("group"), text.cast("string").cast("binary").alias("text")) \
        .filter(F.col("text").isNotNull())
    counted = rows.mapInArrow(parse, "group string, chunk binary, freq bigint").groupBy("group", "chunk").agg(F.sum("freq").alias("freq"))
    return stored(counted.mapInArrow(pack, BLOCK_SCHEMA))


class _Pieces:
    """A block of the dictionary: numbered tokens, weights, and where n-grams may start."""

    def __init__(self, batch: pa.RecordBatch, i: int, overlap: int):
        raw = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        self.group = batch.column("group")[i].as_py()
        self.names = batch.column("names")[i]
        self.hashes = raw("hashes", np.uint64)
        self.codes = raw("codes", np.int32).astype(np.int64)
        lengths, freq = raw("lengths", np.int32), raw("freq", np.int64)
        ends = np.cumsum(lengths, dtype=np.int64)
        own = self.codes > 0
        for back in range(1, overlap + 1):
            own[ends - back] = False
        self.starts = np.flatnonzero(own)
        self.weights = np.repeat(freq, lengths)
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(self.group.encode()))

    def hash_of(self, at: np.ndarray, n: int, codes: np.ndarray) -> np.ndarray:
        return _rolled([np.full(len(at), self.seed), *[self.hashes[codes[at + i]] for i in range(n)]])

    def grams(self, n: int, shorter: np.ndarray | None = None, own: np.ndarray | None = None):
        """Distinct n-grams as a matrix of token numbers, with their weighted counts.

        With ``shorter`` only those whose both n-grams of one word less pass it, with ``own`` those that pass it themselves.
        """
        at, codes = self.starts, self.codes
        for i in range(1, n):
            at = at[codes[at + i] > 0]
        for shift in (0, 1) if shorter is not None else ():
            at = at[_passes(shorter, self.hash_of(at + shift, n - 1, codes))]
        if own is not None:
            at = at[_passes(own, self.hash_of(at, n, codes))]
        if not len(at):
            return np.zeros((0, n), np.int64), np.zeros(0, np.int64)
        key, width, reach = codes[at], len(self.hashes), len(self.hashes)
        for i in range(1, n):
            if reach * width >= 1 << 63:
                values, key = np.unique(key, return_inverse=True)
                reach = len(values)
            key, reach = key * width + codes[at + i], reach * width
        order = np.argsort(key)
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        lead = at[order[first]]
        return np.column_stack([codes[lead + i] for i in range(n)]), np.add.reduceat(self.weights[at][order], first)

    def texts(self, grams: np.ndarray) -> pa.Array:
        names = pa.array(self.names.as_py().split(b" "), pa.binary()).cast(pa.string())
        parts = [names.take(pa.array(grams[:, i] - 1)) for i in range(grams.shape[1])]
        return pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes % np.uint64(bits), (hashes >> np.uint64(32)) * _MIX % np.uint64(bits)


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    with np.errstate(over="ignore"):
        for at in _bits(hashes, 64 * len(bitmap)):
            out &= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _each(dictionary: DataFrame, overlap: int, schema: str, make, names: str) -> DataFrame:
    """Run ``make`` on every block; it gives Arrow columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cols = make(_Pieces(batch, i, overlap))
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays(cols, names.split())

    return dictionary.mapInArrow(run, schema)


def _counts(dictionary: DataFrame, n: int, overlap: int, own) -> DataFrame:
    """group, phrase, f: n-grams with their counts; for n = 1 a null phrase holds the number of words."""
    def make(p: _Pieces):
        grams, f = p.grams(n, own=None if own is None else own.value)
        phrase = p.texts(grams)
        if n == 1:
            phrase, f = pa.concat_arrays([phrase, pa.nulls(1, pa.string())]), np.append(f, f.sum())
        return [pa.array([p.group] * len(f), pa.string()), phrase, pa.array(f)]

    rows = _each(dictionary, overlap, "group string, phrase string, f bigint", make, "group phrase f")
    return rows.groupBy("group", "phrase").agg(F.sum("f").alias("f"))


def _hash_counts(dictionary: DataFrame, n: int, overlap: int, shorter) -> DataFrame:
    """h, f: counts by hash, which are never below the count of an n-gram with that hash."""
    def make(p: _Pieces):
        grams, f = p.grams(n, shorter=shorter.value)
        return [pa.array(p.hash_of(np.arange(len(grams)) * n, n, grams.ravel()).view(np.int64)), pa.array(f)]

    return _each(dictionary, overlap, "h bigint, f bigint", make, "h f").groupBy("h").agg(F.sum("f").alias("f"))


def _word_hashes(single: DataFrame) -> DataFrame:
    """Hashes of one-word phrases, as those of n-grams are made."""
    def run(batches):
        for b in batches:
            h = _rolled([_hashes([x.encode() for x in b.column(i).to_pylist()]) for i in (0, 1)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
    return single.select("group", "phrase").mapInArrow(run, "h bigint")


def _filter(hashes: DataFrame, bits: int):
    """The bit array of some hashes, broadcast: at most bits / 64 numbers reach the driver."""
    def place(batches):
        for b in batches:
            if b.num_rows:
                with np.errstate(over="ignore"):
                    at = np.concatenate(_bits(b.column(0).to_numpy().view(np.uint64), bits))
                word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                order = np.argsort(word, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0])
                yield pa.RecordBatch.from_arrays([pa.array(word[order][first]), pa.array(
                    np.bitwise_or.reduceat(bit[order], first).view(np.int64))], ["word", "bits"])

    found = hashes.mapInArrow(place, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def count_phrases(dictionary: DataFrame, least: int, max_words: int = 3, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(group, n) with the words of each group, and (group, phrase, words, f): all n-grams up to ``max_words`` with f >= ``least``."""
    overlap = max_words - 1
    counted = stored(_counts(dictionary, 1, overlap, None).filter((F.col("f") >= least) | F.col("phrase").isNull()))
    sizes = counted.filter(F.col("phrase").isNull()).select("group", F.col("f").alias("n"))
    single = counted.filter(F.col("phrase").isNotNull())
    grams = single.select("group", "phrase", F.lit(1).alias("words"), "f")
    passing = _filter(_word_hashes(single), bits)
    for n in range(2, max_words + 1):
        shorter, passing = passing, _filter(_hash_counts(dictionary, n, overlap, passing).filter(F.col("f") >= least).select("h"), bits)
        shorter.destroy()
        level = stored(_counts(dictionary, n, overlap, passing).filter(F.col("f") >= least))
        grams = grams.unionByName(level.select("group", "phrase", F.lit(n).alias("words"), "f"))
    passing.destroy()
    return sizes, grams


#: Copies of the counts that the parts of phrases meet: a word that begins very many phrases is spread over as many tasks.
SALTS = 8


def score_phrases(grams: DataFrame) -> DataFrame:
    """group, phrase, words, a, l, r, score of every phrase of two words or more: the cut with the lowest score, then the first.

    Products are exact decimals of up to 38 digits: for counts below 10 ** 16.
    """
    phrases = grams.filter("words > 1").select("group", "phrase", "words", F.col("f").alias("a"))
    part = "array_join(slice(split(phrase, ' '), {}, {}), ' ')"
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", F.expr(f"inline(array(struct(true AS first, {part.format('1', 'k')} AS part), "
                    f"struct(false AS first, {part.format('k + 1', 'words - k')} AS part)))")) \
        .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    table = grams.select("group", F.col("phrase").alias("part"), F.col("f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = cuts.join(table, ["group", "part", "salt"]).groupBy("group", "phrase", "words", "a", "k").agg(
        F.max(F.expr("if(first, f, null)")).alias("l"), F.max(F.expr("if(first, null, f)")).alias("r"))
    exact = lambda c: f"cast({c} as decimal(20, 0))"
    scored = both.withColumn("score", F.expr(
        f"({exact('a')} * {exact('a')} * cast(1000000 as decimal(7, 0))) div ({exact('l')} * {exact('r')})"))
    best = scored.groupBy("group", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("group", "phrase", "words", "a", "b.l", "b.r", "b.score")


def standing(scored: DataFrame, percent: int = 50) -> DataFrame:
    """Without phrases that lie inside a longer one which is at least ``percent`` of them as frequent."""
    inner = scored.filter("words > 2").select("group", "a", "words", F.split("phrase", " ").alias("w")).select(
        "group", "a", F.expr(
            "explode(flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), "
            "i -> array_join(slice(w, i, n), ' ')))))").alias("phrase"))
    longest = inner.groupBy("group", "phrase").agg(F.max("a").alias("longer"))
    return scored.join(longest, ["group", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = 10, max_words: int = 3,
                 percent: int = 50, top: int = 2000, no_group: str = "und", trigger: int = TRIGGER,
                 bits: int = FILTER_BITS) -> DataFrame:
    """The ``top`` phrases of each group: group, rank (from 1), phrase, a, l, r, n, score, words.

    ``a`` counts all occurrences within pieces, overlaps included, ``l`` and ``r`` those of the two parts, ``n`` the words
    of the group. Order: score and ``a`` descending, then phrase by its UTF-8 bytes. A null group counts as ``no_group``,
    a null text as empty; repeated rows count each. An empty table gives no rows; extra columns are ignored.
    """
    dictionary = build_dictionary(docs, F.col(f"`{text_col}`"), F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit(no_group)),
                                  max_words, trigger)
    sizes, grams = count_phrases(dictionary, least, max_words, bits)
    found = standing(stored(score_phrases(grams)), percent)
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "group").select("group", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words")
