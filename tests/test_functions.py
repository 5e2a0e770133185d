import pandas as pd
from pyspark.sql import functions as F

from clusterlens.functions import text as T
from clusterlens.operators import clean as C
from clusterlens.operators import metrics as M
from clusterlens.operators import validate as V


def test_snake_case():
    assert T.snake_case("Scored By") == "scored_by"
    assert T.snake_case("animeID") == "anime_id"
    assert T.snake_case("  English name ") == "english_name"


def test_whitespace_and_labels(spark):
    df = spark.createDataFrame([("a 　b\x1c c ",), ("   ",), (None,)], "t string")
    got = [r[0] for r in df.select(T.clean_label("t")).collect()]
    assert got == ["a b c", None, None]


def test_duration_and_numeric(spark):
    df = spark.createDataFrame([("1 hr 30 min",), ("24 min per ep",), ("0 min",), ("abc",), (None,)], "t string")
    got = [r[0] for r in df.select(T.parse_duration_minutes("t")).collect()]
    assert got == [90.0, 24.0, None, None, None]
    nums = spark.createDataFrame([(" 7.5 ",), ("1e3",), ("1d",), ("1_000",), ("UNKNOWN",)], "t string")
    assert [r[0] for r in nums.select(T.coerce_numeric("t")).collect()] == [7.5, 1000.0, None, None, None]


def test_multilabel_and_season(spark):
    df = spark.createDataFrame([("Action, comedy ,unknown,, Action",), (None,), ("Unknown",)], "t string")
    assert [r[0] for r in df.select(T.normalize_multilabel("t")).collect()] == ["action|comedy", "missing", "missing"]
    s = spark.createDataFrame([("Spring 2009",), ("UNKNOWN",), (None,)], "t string")
    assert [r[0] for r in s.select(T.leading_token("t")).collect()] == ["spring", "missing", "missing"]


def test_dedup_keeps_null_key_group(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, 5, "c"), (4, 5, "d"), (5, 6, "e")],
                               "seq int, k int, v string")
    first = {r["k"]: r["v"] for r in C.dedup(df, ["k"], "seq", "first").collect()}
    assert first == {None: "a", 5: "c", 6: "e"}
    last = {r["k"]: r["v"] for r in C.dedup(df, ["k"], "seq", "last").collect()}
    assert last == {None: "b", 5: "d", 6: "e"}
    assert [r["v"] for r in C.dedup(df, ["k"], "seq", "none").collect()] == ["e"]


def test_validation_reasons(spark):
    df = spark.createDataFrame([(1, "x", 11.0), (1, " ", 5.0), (None, "z", -1.0)], "id int, name string, score double")
    report, rejected = V.validate(df, "id", "name", ranges={"score": (0, 10)})
    r = report.first()
    assert (r["rows"], r["missing_id"], r["missing_name"], r["invalid_score"], r["duplicate_id"]) == (3, 1, 1, 2, 2)
    assert r["rejected_rows"] == 2 and r["warning_rows"] == 3
    reasons = sorted(tuple(x["rejection_reasons"]) for x in rejected.collect())
    assert reasons == [("missing_id", "invalid_score"), ("missing_name", "duplicate_id")]


def test_ari_nmi_properties():
    import numpy as np
    ct = np.array([[5, 0], [0, 7]])
    assert M.ari_nmi_from_table(ct) == (1.0, 1.0)
    assert M.ari_nmi_from_table(np.array([[12]])) == (1.0, 1.0)
    a, n = M.ari_nmi_from_table(np.array([[3, 3], [3, 3]]))
    assert abs(n) < 1e-12 and a <= 0.0
