"""Merkle manifest against a plain recursive version, with nulls, repeated rows, one group and none."""

import random
import zlib

import pytest
from brute import sha
from pyspark.sql import functions as F

from clusterlens.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf(row, lower=False):
    doc, source, lang, n, text = row
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if lower and text is not None else text
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(field(v) for v in (doc, source, lang, n, text)))


def _tree(digests, fanout):
    """Root, and for each leaf the siblings before and after its place on every level."""
    at, steps = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        runs = [digests[i:i + fanout] for i in range(0, len(digests), fanout)]
        for k, p in enumerate(at):
            run = runs[p // fanout]
            steps[k].append(("".join(run[:p % fanout]), "".join(run[p % fanout + 1:])))
        at = [p // fanout for p in at]
        digests = [sha("".join(r)) for r in runs]
    return digests[0], steps


def brute(rows, fanout=8):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        parts[lang] = (own, *_tree([_leaf(r) for r in own], fanout))
    root, high = _tree([parts[x][1] for x in langs], fanout)
    out = []
    for lang, above in zip(langs, high):
        own, subroot, steps = parts[lang]
        for r, s in zip(own, steps):
            proof = s + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = _leaf(r, changed)
            for before, after in proof:
                node = sha(before + node + after)
            out.append((r[0], _leaf(r), subroot, root, sha("".join(a + b for a, b in proof)), node, node == root))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "abc", "ABC d", "Ünï Ωx", "x" * 30_000, f"Some Text {rng.random()}"])
    rows = [(i, f"s{i % 3}", lang, 3, text()) for lang, n in (("en", 75), ("de", 8), ("fr", 9), ("x", 1), (None, 3), ("", 2), ("Ω", 65))
            for i in (rng.randrange(10**6) for _ in range(n))]
    rows += [(None, None, "en", None, None)] * 3 + [(5, "s", "en", 1, "Same")] * 4 + [(5, "s", "en", 1, "Other"), (5, "s", None, 1, "Same")]
    return rows


@pytest.mark.parametrize("fanout", [8, 2])
def test_manifest(spark, fanout):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    for c in ("pos", "size", "digest", "child", "path", "root", "c0", "id", "part"):
        df = df.withColumn(c, F.lit("clash"))
    m = merkle.build_manifest(df, COLUMNS, "lang", "doc_id", fanout, {"text": merkle.lowered()}, merkle.tampered())
    got = sorted(map(tuple, merkle.verify(m).collect()), key=str)
    assert got == brute(rows, fanout)
    assert m.root().collect()[0][0] == got[0][3]
    top = m.nodes().filter("tree = 'rows' and group = '=en'").orderBy(F.desc("level")).first()
    assert top["digest"] == next(r[2] for r in got if r[0] == 5 and r[1] == _leaf((5, "s", "en", 1, "Other")))


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 2, "Ab")], [(None, None, None, None, None)]])
def test_small_manifests(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    m = merkle.build_manifest(df, COLUMNS, "lang", "doc_id", altered={"text": merkle.lowered()}, where=merkle.tampered())
    assert sorted(map(tuple, merkle.verify(m).collect()), key=str) == (brute(rows) if rows else [])
    assert m.root().count() == bool(rows)


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "z")], "k string, v string").withColumn("g", F.lit("g"))
    m = merkle.build_manifest(df, ["k", "v"], "g", "k")
    assert [r["id"] for r in merkle.verify(m).select(F.col("doc_id").alias("id"), "verified").collect() if r["verified"]].count("a") == 1
