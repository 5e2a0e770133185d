"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans of mixed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach

#: Hashed character trigrams of words; the model is a table of so many rows for each language.
BUCKETS = 1 << 15
#: What a change of language between two words costs, in nats.
SWITCH_PENALTY = 8.0
#: A language is a candidate for a script that holds at least this share of its training words.
SCRIPT_SHARE = 0.01
#: Text handled at a time by a task, and words whose scores it remembers.
CHUNK_BYTES, CACHE_WORDS = 2 << 20, 200_000

#: A word: letters, with the marks that combine with them.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")

#: First code points of script ranges, and the script that starts there (fixed values, Unicode blocks).
SCRIPTS = [(0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
           (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0E00, "Thai"), (0x0E80, "Other"),
           (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
           (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
           (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
           (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"),
           (0x20000, "Han"), (0x32000, "Other")]
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF_RANGE = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words (with marks at both ends), where each word's begin, and each word's script."""
    text = np.frombuffer("".join([f" {w} " for w in words]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.flatnonzero(text == 32)
    first = blank[0::2]
    c = text.astype(np.int64)
    grams = ((c[:-2] * 0x9E3779B1 + c[1:-1] * 0x85EBCA77 + c[2:] * 0xC2B2AE3D) >> 7) % BUCKETS
    inside = np.ones(len(text) - 2, bool)
    inside[blank[1:-1:2] - 1] = False  # the trigrams that lie over two words
    inside[blank[1:-1:2]] = False
    starts = first - 2 * np.arange(len(words))
    return grams[inside], starts, _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, c[first + 1], "right") - 1]


def _texts(column: pa.Array, order: list[int] | None = None) -> Iterator[tuple[int, list[str]]]:
    """Texts in chunks of about CHUNK_BYTES, with the place at which each chunk starts; null is empty.

    ``order`` gives the rows in another order than the batch's.
    """
    part, size, first = [], 0, 0
    for t in column if order is None else (column[i] for i in order):
        t = t.as_py() or ""
        part.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield first, part
            part, size, first = [], 0, first + len(part)
    if part:
        yield first, part


@dataclass
class Model:
    """Languages by code point; log-probability of each trigram bucket, and whether it uses a script."""
    languages: list[str]
    table: np.ndarray
    scripts: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count hashed trigrams and scripts of all words by language; rows with a null text or language are left out.

    Each task adds up its rows in arrays of fixed size and hands on only what it has seen, so what meets for one
    language is at most BUCKETS rows a task. Add-half smoothing.
    """
    n_scripts = len(_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in _texts(batch.column(1)):
                by: dict[str, list[str]] = {}
                for lang, t in zip(langs[first:first + len(texts)], texts):
                    by.setdefault(lang, []).append(t)
                for lang, own in by.items():
                    words = [w for t in own for w in _WORD.findall(t)]
                    if not words:
                        continue
                    grams, _, script = _features(words)
                    a = total.setdefault(lang, np.zeros(BUCKETS + n_scripts, np.int64))
                    a[:BUCKETS] += np.bincount(grams, minlength=BUCKETS)
                    a[BUCKETS:] += np.bincount(script, minlength=n_scripts)
        for lang, a in total.items():
            at = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(a[at])],
                                             ["lang", "at", "n"])

    rows = (docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
            .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
            .mapInArrow(count, "lang string, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n")))
    got = rows.toPandas()  # at most BUCKETS + scripts rows a language
    languages = sorted(got["lang"].unique())
    n = np.zeros((BUCKETS + n_scripts, len(languages)))
    if len(got):
        n[got["at"].to_numpy(), np.searchsorted(np.array(languages, object), got["lang"].to_numpy(object))] = got["n"]
    grams = n[:BUCKETS] + 0.5
    share = n[BUCKETS:] / np.maximum(n[BUCKETS:].sum(axis=0), 1)
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), share >= SCRIPT_SHARE)


class _Scorer:
    """Scores of words, remembered while there is room."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.rows = np.zeros((0, len(model.languages)), np.float32)
        self.fits = np.zeros(0, bool)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Relative score of each word for each language, and whether any language is a candidate for its script."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.rows, self.fits = {}, self.rows[:0], self.fits[:0]
        known = self.known
        n = len(known)
        at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        if len(known) > n:
            new = list(known)[n:]
            scores, fits = self._score(new)
            self.rows, self.fits = np.concatenate([self.rows, scores]), np.concatenate([self.fits, fits])
        return self.rows[at], self.fits[at]

    def _score(self, words):
        grams, starts, script = _features(words)
        s = np.add.reduceat(self.model.table[grams], starts, axis=0)
        allowed = self.model.scripts[script]
        fits = allowed.any(axis=1)
        s -= s.max(axis=1, keepdims=True)
        s[fits[:, None] & ~allowed] = -100.0
        s[~fits] = 0.0
        return s, fits


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word: the sum of its text's scores, less ``penalty`` for each change. Texts lie end to end.

    All texts take a step together; they are ordered by length, so those that have ended drop off the end.
    """
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    steps = int(lengths.max(initial=0))
    alive = np.searchsorted(-lengths[order], -np.arange(steps), "left")  # texts longer than t words
    came = np.zeros(scores.shape, np.int16)  # the label before, for each word and label
    own = np.arange(scores.shape[1], dtype=np.int16)
    ended = np.zeros(len(order), np.int16)
    v = np.zeros((alive[0] if steps else 0, scores.shape[1]), np.float32)
    for t in range(steps):
        a = alive[t]
        if t:
            if a < len(v):
                ended[a:len(v)] = v[a:].argmax(axis=1)
                v = v[:a]
            best = v.argmax(axis=1)
            jump = v[np.arange(a), best] - penalty
            stay = v >= jump[:, None]
            came[first[:a] + t] = np.where(stay, own, best[:, None])
            v = np.where(stay, v, jump[:, None])
        v = v + scores[first[:a] + t]
    if steps:
        ended[:len(v)] = v.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        at = first[:a] + t
        labels[at] = ended[:a]
        ended[:a] = came[at, ended[:a]]
    return labels


def label_texts(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_spans`` (lang, start, end; word numbers, end exclusive).

    Words are runs of letters. ``lang_pred`` is the language of most letters on the best path (ties: the smaller code),
    ``score`` the share of the text's letters on it whose script the language uses. Null texts and texts without a letter are
    ``und`` with score 0, as is everything if nothing was learned. A model is BUCKETS x languages numbers. Rows are
    kept one to one; input columns named like a result are replaced; an empty table gives an empty result.
    """
    spans_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    languages = model.languages

    def one_chunk(score, texts):
        words = [_WORD.findall(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        flat = [w for ws in words for w in ws]
        if not flat or not languages:
            return [("und", 0.0, [])] * len(texts)
        scores, fits = score(flat)
        labels = viterbi(scores, lengths, penalty)
        letters = np.fromiter(map(len, flat), np.int64, len(flat))
        text_no = np.repeat(np.arange(len(texts)), lengths)
        cell, shape = text_no * len(languages) + labels, (len(texts), len(languages))
        weight = np.bincount(cell, letters, shape[0] * shape[1]).reshape(shape)
        sure = np.bincount(cell, letters * fits, shape[0] * shape[1]).reshape(shape)
        total = weight.sum(axis=1)
        best = np.where(sure.max(axis=1) > 0, sure.argmax(axis=1), weight.argmax(axis=1))
        change = np.ones(len(flat) + 1, bool)
        change[1:-1] = (labels[1:] != labels[:-1]) | (text_no[1:] != text_no[:-1])
        edges = np.flatnonzero(change)
        start = np.cumsum(lengths) - lengths
        spans: list[list] = [[] for _ in texts]
        for a, b in zip(edges[:-1], edges[1:]):
            d = text_no[a]
            spans[d].append({"lang": languages[labels[a]], "start": int(a - start[d]), "end": int(b - start[d])})
        return [(languages[best[i]], float(sure[i, best[i]] / total[i]), spans[i]) if total[i] else ("und", 0.0, [])
                for i in range(len(texts))]

    @F.arrow_udf("struct<lang_pred:string,score:double,lang_spans:array<struct<lang:string,start:int,end:int>>>")
    def label(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = _Scorer(model)
        for column in texts:
            # texts of like length together: a chunk takes as many steps as its longest text has words
            order = np.argsort(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), kind="stable").tolist()
            rows: list = [None] * len(column)
            for first, part in _texts(column, order):
                for i, r in zip(order[first:first + len(part)], one_chunk(score, part)):
                    rows[i] = r
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], spans_type)], ["lang_pred", "score", "lang_spans"])

    # only the text goes to Python, and only the result comes back
    found = attach(docs, {"__label": label(F.col(f"`{text_col}`").cast("string"))})
    out = attach(found, {c: F.col(f"__label.{c}") for c in ("lang_pred", "score", "lang_spans")})
    return out.drop("__label")


def held_out(id_col: str = "doc_id"):
    """Fixed split of the contract: crc32 of the id as text, modulo 5, is 0. A null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Learn from the rows that are not held out, label all: ``docs`` with ``held_out`` and what ``label_texts`` adds."""
    learn = docs.filter(F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    model = train(learn, text_col, lang_col)
    return attach(label_texts(docs, model, text_col, penalty), {"held_out": held_out(id_col)})
