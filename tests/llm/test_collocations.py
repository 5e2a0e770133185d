"""Phrase collocations against plain counting; chunks against their text."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clusterlens.llm import collocations


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least=10, most=3, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= percent * a and inside(q) for q, b in cand.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((score, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows_[:top])]
    return sorted(out)


def _rows():
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "gamma", "Ünï", "ünï", "the", "of", "a\x1cb", "x y", "naïve", " ", "d's"]
    seps = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", " ;", "\r\n", "\x0b", "?!"]
    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(n))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(150)]
    rows += [("new york city hall " * 40, "en"), ("the the the the " * 300, "en"), ("echo " * 5000, "fr")]
    rows += [rows[0]] * 30 + [(None, "en"), ("", "en"), (" .,\t", "xx"), ("lonely", "yy")]
    return rows


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    for c in ("group", "phrase", "f", "a", "rank", "n", "chunk", "freq", "words"):
        df = df.withColumn(c, F.lit("clash"))
    return df


NAMES = ["group", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("trigger, bits, step", [(32, 1 << 26, 4 << 20), (3, 64, 500), (1, 1 << 12, 2000)])
def test_against_counting(spark, monkeypatch, trigger, bits, step):
    monkeypatch.setattr(collocations, "STEP_BYTES", step)
    rows = _rows()
    got = collocations.collocations(_frame(spark, rows), trigger=trigger, bits=bits).select(*NAMES)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_longer_phrases_and_top(spark):
    rows = _rows()
    got = collocations.collocations(_frame(spark, rows), max_words=5, least=6, percent=80, top=7, trigger=4).select(*NAMES)
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, 5, 80, 7)


def test_empty(spark):
    assert collocations.collocations(_frame(spark, [])).count() == 0
    assert collocations.collocations(_frame(spark, [(None, None), ("  ", "en")])).count() == 0


def test_chunks_cover_their_text():
    rng = random.Random(1)
    for _ in range(50):
        texts = [" ".join(rng.choice(["a", "b", "c", "d."]) for _ in range(rng.choice([0, 0, 1, 2, 80]))).encode() for _ in range(5)]
        for overlap in (1, 2, 3):
            found, n = collocations.chunks(texts, overlap, 3)
            at = 0
            for t, k in zip(texts, n):
                parts = [c.split(b" ") for c in found[at:at + k]]
                at += k
                assert [x for c in parts for x in c[:-overlap]] == collocations.words(t)
                assert all(a[-overlap:] == b[:overlap] for a, b in zip(parts, parts[1:]))
            assert at == len(found)


def test_equal_passages_share_chunks():
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(400))
    made = [set(collocations.chunks([(lead + passage).encode()], 2, 16)[0])
            for lead in ("one two three ", "quite another beginning of a text ")]
    assert len(made[0] & made[1]) >= len(made[0]) - 2


def test_scores_are_exact(spark):
    big = 2_345_678_901_234_567
    rows = [("g", "x", 1, big * 7 + 3), ("g", "y", 1, big * 5 + 1), ("g", "x y", 2, big)]
    got = collocations.score_phrases(spark.createDataFrame(rows, "group string, phrase string, words int, f bigint")).first()
    assert got["score"] == 1_000_000 * big * big // ((big * 7 + 3) * (big * 5 + 1))
