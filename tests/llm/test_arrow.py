"""Language ID, licenses, decontamination, suffix dedup and the n-gram join against plain Python and planted cases."""

import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001, SF01, ordered
from pyspark.sql import functions as F

from clusterlens.llm import decontam, langid, licenses, ngram_join, queries, suffix_dedup
from clusterlens.llm.common import stored


def _prose(rng, n, letters="abcdeilnorst"):
    return [" " .join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))]


# ---- language ID

def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = langid.identify(docs.select("doc_id", "text", "lang")).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    n, good, held = out.filter("held_out").agg(F.count("*"), F.avg((F.col("lang_pred") == F.col("truth")).cast("int")),
                                               F.max("score")).first()
    assert n > 150 and good > 0.95 and held <= 1.0


def test_language_edges_and_spans(make_docs):
    rng = random.Random(2)
    en = lambda n: " ".join(rng.choice(["the", "house", "which", "with", "water", "thing"]) for _ in range(n))
    de = lambda n: " ".join(rng.choice(["und", "schön", "nicht", "zwischen", "wasser", "auch"]) for _ in range(n))
    rows = [(i, en(40), "en") for i in range(1, 30)] + [(i, de(40), "de") for i in range(30, 60)]
    rows += [(100, en(30) + " " + de(10), None), (101, None, "de"), (102, "", "de"), (103, "12 34 !?", "de"), (104, "привет мир", None),
             (None, en(5), "xx"), (105, "the", None), (105, "und", None), (106, en(30_000), None)]
    out = langid.identify(make_docs(rows, extra=True)).filter("doc_id >= 100 or doc_id is null")
    got = ordered(out, "lang_pred", "score", "lang_spans", "held_out")
    by = {k: v for k, v in zip([None, 100, 101, 102, 103, 104], got)}
    assert by[100][0] == "en" and [s["lang"] for s in by[100][2]] == ["en", "de"]
    assert (by[100][2][0]["start"], by[100][2][0]["end"], by[100][2][1]["end"]) == (0, 30, 40)
    assert all(by[k][:3] == ["und", 0.0, []] for k in (101, 102, 103))
    assert by[104][0] in ("en", "de") and by[104][1] == 0.0  # no learned language uses the script
    assert by[None][0] == "en" and by[None][3] is False       # null ids teach nothing
    assert [g[0] for g in got[6:9]] == ["de", "en", "en"] or [g[0] for g in got[6:9]] == ["en", "de", "en"]
    assert langid.identify(make_docs([])).count() == 0
    assert langid.identify(make_docs([(1, "word", None)])).first()["lang_pred"] == "und"


def test_viterbi_is_best_path():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(0, 7, 4)
        scores = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
        labels = langid.viterbi(scores, lengths, 0.7)
        at = 0
        for n in lengths:
            s, own = scores[at:at + n], labels[at:at + n]
            value = lambda p: sum(s[i, p[i]] for i in range(n)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            best = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
            assert value(list(own)) == pytest.approx(best, abs=1e-4)
            at += n


# ---- licenses

def test_licenses(make_docs):
    rng = random.Random(4)
    body = " ".join(_prose(rng, 300))
    t = licenses.TEMPLATES
    rows = [(0, None), (1, ""), (2, body), (3, body + "\nLicensed under the Apache License, Version 2.0.\n" + body),
            (4, t["MIT-grant"].replace("free of charge", "free of any charge").upper()), (5, "the License, under the License the"),
            (6, "Released under the MIT License. " * 3), (7, body + " " + t["BSD-disclaimer"][:60]), (8, "x " * 40_000 + t["CC-BY-NC-4.0"])]
    out = licenses.summary(licenses.find_licenses(make_docs(rows, extra=True)))
    got = dict(zip(range(9), ordered(out, "license", "coverage", "n_spans", "spans")))
    assert all(got[k] == [None, 0.0, 0, ""] for k in (0, 1, 2, 5, 7))
    assert got[3] == ["Apache-2.0", 1.0, 1, "Apache-2.0:300:308"]
    assert got[4][0] == "MIT-grant" and got[4][1] == 1.0 and got[4][3] == f"MIT-grant:0:{len(licenses.words(rows[4][1].encode()))}"
    assert got[6][2] == 3 and got[6][3] == "MIT:0:5,MIT:5:10,MIT:10:15"
    assert got[8][3].startswith("CC-BY-NC-4.0:40000:")
    assert licenses.find_licenses(make_docs([])).count() == 0


INDEX = licenses.TemplateIndex(licenses.TEMPLATES)


def _found(text):
    return [f[0] for f in licenses.scan_text(text.encode(), INDEX, licenses.COVERAGE, licenses.BAND)]


def test_confusable_licenses():
    """Each notice is itself and no other license, also with a word around it."""
    for name, text in licenses.TEMPLATES.items():
        got = licenses.scan_text(f"some words before {text} and after".encode(), INDEX, licenses.COVERAGE, licenses.BAND)
        assert [f[:2] for f in got] == [(name, 1.0)], (name, got)
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    gnu = "This work is licensed under the GNU {}General Public License, version {}"
    for text, want in ((cc.format(""), "CC-BY-4.0"), (cc.format("-NonCommercial"), "CC-BY-NC-4.0-long"), (cc.format("-ShareAlike"), "CC-BY-SA-4.0"),
                       (cc.format(" Non Commercial"), "CC-BY-NC-4.0-spaced"), (gnu.format("Lesser ", 3), "LGPL-3.0"), (gnu.format("", 2), "GPL-2.0"),
                       (gnu.format("", 3), "GPL-3.0"), (gnu.format("Affero ", 3), "AGPL-3.0"), (gnu.format("Lesser ", 2.1), "LGPL-2.1")):
        assert _found(text) == [want]
    for text in (gnu.format("", 7), cc.format("-Sampling"), "Released under the Python License", "Licensed under CC BY-XY-NC-SA 9.0",
                 "Licensed under the Apache License, Version 1.1"):
        assert _found(text) == []


def test_edited_full_texts():
    rng = random.Random(2)
    for name in ("GPL-2.0-text", "LGPL-2.1-text", "BSD-3-Clause-text", "ISC-text", "CC-BY-SA-4.0-text"):
        w = licenses.TEMPLATES[name].split()
        edited = [x if rng.random() > 0.03 else rng.choice(["foo", "", x + " bar"]) for x in w]
        edited[len(w) // 2:len(w) // 2] = ["added"] * (len(w) // 15)  # more than the band of short notices
        assert name in _found("prose " * 50 + " ".join(edited))
    for name in ("GPL-2.0-text", "BSD-3-Clause-text"):  # a third of the text is no license text
        assert name not in _found(" ".join(licenses.TEMPLATES[name].split()[:len(licenses.TEMPLATES[name].split()) // 3]))


def test_edit_distance_against_full_table():
    rng = random.Random(12)
    for _ in range(100):
        a, b = [np.array([rng.randint(0, 3) for _ in range(rng.randint(3, 9))]) for _ in range(2)]
        cost = np.zeros((len(b) + 1, len(a) + 1), int)
        cost[:, 0] = range(len(b) + 1)
        for i, j in itertools.product(range(len(b)), range(len(a))):
            cost[i + 1, j + 1] = min(cost[i, j] + (a[j] != b[i]), cost[i, j + 1] + 1, cost[i + 1, j] + 1)
        assert licenses.edit_distance(a, b, 0, 12, 99) == cost[-1].min()


def test_alignment_against_full_table():
    rng = random.Random(9)
    for _ in range(200):
        a, b = [np.array([rng.randint(0, 3) for _ in range(rng.randint(3, 9))]) for _ in range(2)]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        n, first, end = licenses.align(a, b, 0, 12)
        assert n == table[-1, -1]
        assert n == 0 or 0 <= first < end <= len(a)


# ---- decontamination

def _contamination_case():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["é", "Straße", "The"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ". ", "\n", "--"]) for _ in range(n))
    items = [(1, text(30)), (2, text(13)), (3, "One short ITEM"), (4, ""), (5, None), (10, text(60)), (2, "twice listed é"), (7, "9")]
    docs = [(i, text(rng.randint(0, 200))) for i in range(40)]
    docs += [(50, items[0][1].upper()), (51, "a " + items[1][1] + " b"), (52, "one-short item and"), (53, None), (54, ""),
             (55, text(900) + items[5][1] + text(900)), (None, items[0][1]), (50, items[0][1]), (56, "one short"), (57, "9 " * 30_000),
             (58, "item one short item one short")]
    return docs, items


def _check_contamination(spark, make_docs, d):
    docs, items = _contamination_case()
    out = queries.op7_decontamination(spark, d)
    assert out.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"),
                          ("items_sha256", "string"), ("contaminated", "boolean")]
    got = sorted(([r[0] if r[0] is not None else -1, *list(r)[1:]] for r in out.collect()), key=str)
    want = sorted(([d[0] if d[0] is not None else -1, *r] for d, r in zip(docs, brute.contamination(docs, items))), key=str)
    assert got == want


def test_contamination(spark, make_docs, write_tables, monkeypatch):
    docs, items = _contamination_case()
    d = write_tables(documents=make_docs(docs, extra=True), benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 500)
    _check_contamination(spark, make_docs, d)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 20)
    monkeypatch.setattr(decontam, "VOCABULARY_BOUND", 3)
    _check_contamination(spark, make_docs, d)


def test_contamination_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = make_docs([(1, "a b")])
    assert [r["n_hit"] for r in decontam.find_contamination(one, none).collect()] == [0]
    assert decontam.find_contamination(make_docs([]), one.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_proximity(make_docs):
    docs = make_docs([(1, "x quick lazy brown fox jumps"), (2, "quick brown fox"), (3, "fox a b c d e f quick brown")])
    index = decontam.build_index(docs)
    phrase = [(0, (b"quick", b"brown", b"fox"))]
    found = lambda slop: {(r["ordinal"], r["segment"]) for r in decontam.search(index, phrase, slop).collect()}
    assert len(found(0)) == 1 and len(found(1)) == 2 and len(found(9)) == 3


# ---- suffix dedup

def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(3)
    for size in (2, 3, 256):
        for n in (1, 2, 50, 3000):
            buf = np.append(rng.integers(0, size, n).astype(np.uint8), np.uint8(0))
            order = suffix_dedup.suffix_order(buf, 100)
            assert sorted(order) == list(range(n + 1))
            raw = buf.tobytes() + b"\0" * 200
            keys = [raw[i:i + 100] for i in order]
            assert keys == sorted(keys)
            got = suffix_dedup.common_prefixes(buf, order[1:], order[:-1], 100)
            for g, a, b in zip(got, keys, keys[1:]):
                assert g == next((i for i in range(100) if a[i] != b[i]), 100)


def _repeat_docs():
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdeilnorstéß") for _ in range(rng.randint(1, 6))) for _ in range(n))
    passage, base = prose(60), prose(300)
    docs = [(9, base), (2, base[:600] + "X" + base[600:]), (5, base), (30, prose(40) + passage + prose(40)), (31, passage), (4, passage[3:] + prose(5)),
            (40, "z" * 5000), (41, "z" * 99), (42, "z" * 100), (43, "ab" * 400), (50, None), (51, ""), (52, "\0" * 300), (None, base[100:400])]
    docs += [(100 + i, prose(rng.randint(1, 60)) + passage[:rng.randint(90, 300)] + prose(3)) for i in range(40)]
    docs += [(200 + i, prose(8) + base[i * 7:i * 7 + 260] + prose(8)) for i in range(30)]
    return docs


@pytest.mark.parametrize("small", [False, True])
def test_removed_repeats(make_docs, monkeypatch, small):
    if small:  # many pieces, sorts and hot minimisers
        monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 700)
        monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 800)
        monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 3)
    docs = _repeat_docs()
    out = suffix_dedup.remove_repeats(make_docs(docs, extra=True).repartition(5))
    got = {r[0]: list(r)[1:] for r in out.collect()}
    want = dict(zip([d for d, _ in docs], brute.repeats(docs)))
    assert got == want


def test_repeated_rows_are_one_document(make_docs):
    text = " ".join(_prose(random.Random(1), 80))
    docs = make_docs([(1, text), (1, text), (2, text), (2, text), (3, "short")]).repartition(3)
    got = ordered(suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans")
    n = len(text)
    assert got == [[n, 0, 0], [n, 0, 0], [n, n, 1], [n, n, 1], [5, 0, 0]]
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


def test_many_texts_under_one_id(make_docs):
    """Null and repeated ids: a passage goes from all texts but one, unique texts keep every byte."""
    rng = random.Random(6)
    passage = _prose(rng, 40)[0]
    rows = [(None if i % 3 else 7, f"{i} " + rng.randbytes(60).hex() + (passage if i % 2 else "")) for i in range(6000)]
    rows += [(i, f"own {i} " + passage) for i in (-3, 9)]
    got = suffix_dedup.remove_repeats(make_docs(rows).repartition(4)).collect()
    assert len(got) == len(rows)
    shared = [r for r in got if r["n_bytes"] > 200]
    assert len(shared) == 3002 and sum(r["n_removed"] == 0 for r in shared) == 1
    # the passage goes, and the few random digits before it that another text has there too
    assert {r["n_removed"] for r in shared if r["n_removed"]} <= set(range(len(passage), len(passage) + 12))
    assert all(r["n_removed"] == 0 for r in got if r["n_bytes"] <= 200)
    assert next(r for r in shared if r["n_removed"] == 0)["doc_id"] is None  # null ids come first


def test_text_ids(make_docs):
    docs = [(i, t) for i, t in _repeat_docs() if i is not None]
    want = {f"k{r[0] + 1000:09d}": list(r)[1:] for r in suffix_dedup.remove_repeats(make_docs(docs)).collect()}
    named = make_docs(docs).withColumn("doc_id", F.format_string("k%09d", F.col("doc_id") + 1000))
    assert {r[0]: list(r)[1:] for r in suffix_dedup.remove_repeats(named).collect()} == want


def test_only_wanted_suffixes_are_sorted():
    rng = np.random.default_rng(5)
    for size, share in ((2, 0.5), (3, 0.02), (256, 0.1), (1, 0.3), (2, 0.0)):
        buf = np.append(rng.integers(0, size, 2000).astype(np.uint8), np.uint8(0))
        wanted = rng.random(len(buf)) < share
        order = suffix_dedup.suffix_order(buf, 100)
        assert suffix_dedup.suffix_order(buf, 100, wanted).tolist() == order[wanted[order]].tolist()


def test_packed_runs_in_small_batches(make_docs, monkeypatch):
    """Runs travel in a row for each bucket; buckets go over several batches, and each text still gets what was found of it."""
    for name, value in (("RUNS", 40), ("RUN_BYTES", 900), ("BUCKET_BITS", 3), ("DOC_BITS", 1)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setitem(suffix_dedup._WHILE_STORED, "spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    docs = _repeat_docs()
    table = make_docs(docs).repartition(3)
    got = {r[0]: list(r)[1:] for r in suffix_dedup.remove_repeats(table).collect()}
    assert got == dict(zip([d for d, _ in docs], brute.repeats(docs)))
    monkeypatch.setattr(suffix_dedup, "RUNS", 1 << 18)
    base = table.select("doc_id", F.xxhash64("text").alias("name"), F.lit(0).cast("bigint").alias("tie"), F.col("text").cast("binary")).coalesce(1)
    assert suffix_dedup._runs(base.filter("text is not null"), 100, 32).count() <= 8 < len(docs)


def test_cut_strings_leave_no_memory_behind():
    data = np.frombuffer(pa.array([bytes(range(250)) * 4000]).buffers()[2], np.uint8)
    before, of = pa.total_allocated_bytes(), np.arange(0, 900_000, 1000)
    args = (data, of, of // 1000, of, of + 50, of, of % 2000 == 0, 100)
    for _ in range(3):
        doc, key, first, strings = suffix_dedup._contexts(*args)
    assert len(strings) == 450 * 51 + 450 and strings[0].as_py() == data[:100].tobytes()
    assert len(np.unique(key[:51])) == 51 and first[:51].tolist() == list(range(51)) and (np.diff(doc) >= 0).all()
    del strings
    assert pa.total_allocated_bytes() == before
    del args, data
    assert pa.total_allocated_bytes() <= before - 1_000_000


# ---- n-gram join

def _near_docs():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 6)))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 400))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    docs += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(40)]
    docs += [None, "", " \n", "one two", "one  two\n", "two one", "a b c d e", "a b c d e f", "a b a b a b a b a b a b", "a b " * 5000]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [2048, 5])
def test_near_duplicates(make_docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    docs = _near_docs()
    out = ngram_join.near_duplicates(make_docs(docs, extra=True).repartition(4))
    assert ordered(out, "class_id", "n_links") == brute.near_duplicates(docs)


def test_near_duplicates_edges(make_docs):
    assert ngram_join.near_duplicates(make_docs([])).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "q r s t u v"), (None, "x y")]
    got = ordered(ngram_join.near_duplicates(make_docs(rows)), "class_id", "n_links")
    assert sorted(got, key=str) == sorted([[5, 0], [5, 0], [5, 0], [None, 0], [7, 0], [None, 0]], key=str)


def test_band_recall():
    n = ngram_join.bands_for(0.8, 0.9995, 8)
    assert 1 - (1 - 0.8 ** 8) ** n >= 0.9995 > 1 - (1 - 0.8 ** 8) ** (n - 1)


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [(f"{rng.randint(100, 400)}", f"{rng.randint(100, 400)}") for _ in range(150)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    from tools.oracle_check import compare, duck
    ok, said = compare(spark, duck(SF001), name, SF001, queries.QUERIES, queries.ORACLES)
    assert ok, said


def test_stored_tables_keep_their_schema(spark):
    df = spark.range(3).select(F.col("id").alias("a"), F.lit("x").alias("b"))
    assert sorted(stored(df).collect()) == sorted(df.collect())
