"""Stages of the corpus pipeline against plain Python, with null and repeated ids."""

import hashlib
import random

import brute
from pyspark.sql import functions as F

import corpus_pipeline


def _rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(3, 6)))
    base = [[word() for _ in range(60)] for _ in range(14)]
    ids = [None, None, None, 1, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9]
    rows = [(i, " ".join(b)) for i, b in zip(ids, base)]
    # exact and near copies: of documents with ids under a null id, under an id that is taken, and of null ids under null
    rows += [(None, rows[5][1]), (1, rows[0][1]), (None, rows[1][1]), (2, " ".join(base[6][:-1])), (3, " ".join(base[10][:-1])),
             (9, rows[13][1]), (None, None), (None, ""), (5, " \n"), (5, "")]
    return rows


def test_one_of_each_class(make_docs):
    rows = _rows()
    at = brute.near_duplicates([(i, t) for i, (_, t) in enumerate(rows)])
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    classes = {}
    for (class_id, _), r in zip(at, rows):
        wordless = not (r[1] or "").split()
        classes.setdefault(("none", *key(r)) if wordless else class_id, []).append(key(r))
    want = sorted(min(c) for c in classes.values())
    got = corpus_pipeline.keep_one_of_each(None, make_docs(rows).repartition(4), "")
    assert sorted(key((r["doc_id"], r["text"])) for r in got.collect()) == want


def test_contaminated_rows_only(spark, make_docs, write_tables):
    rows = [r for r in _rows() if r[1]]
    bad = {0, 3}  # a null id and a repeated one
    items = [(k, rows[i][1]) for k, i in enumerate(bad)]
    d = write_tables(benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    want = [r for r, b in zip(rows, brute.contamination(rows, items)) if not b[-1]]
    got = corpus_pipeline.drop_contaminated(spark, make_docs(rows).repartition(3), d).select("doc_id", F.col("text"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[0] is None for r in want) >= 2 and any(r[0] == 1 for r in want)
