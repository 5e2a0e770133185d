"""Dedup, distinct counts and duplicate flags by digests, and agreement measures in one plan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clusterlens.operators import clean as C
from clusterlens.operators import metrics as M
from clusterlens.operators import profile as P
from clusterlens.operators import validate as V


def _table(spark):
    rows = [("a", 1, 5), ("a", 1, 3), ("a", None, 9), (None, 1, 2), (None, 1, 4), ("b", 2, 7), ("a", None, 1), (None, None, 8),
            ("c", 3, None), ("c", 3, None), ("d", 4, 6), ("d", 4, 6)]
    return spark.createDataFrame(rows, "k string, j int, o int").repartition(3)


@pytest.mark.parametrize("keep", ["first", "last", "none"])
def test_dedup_from_files_and_from_rows(spark, tmp_path, keep):
    df = _table(spark)
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for source in (df, stored, stored.filter("o is not null").select("k", "j", "o")):
        got = sorted(map(tuple, C.dedup(source, ["k", "j"], "o", keep).collect()), key=str)
        pdf = source.toPandas().sort_values("o")
        want = pdf.drop_duplicates(["k", "j"], keep=False if keep == "none" else keep)
        assert len(got) == len(want)
        norm = lambda v: None if v is None or v != v else v
        assert got == sorted((tuple(norm(v) if isinstance(v, str) or v is None else norm(v) and int(v) for v in r)
                              for r in want.itertuples(index=False)), key=str)
    with pytest.raises(ValueError):
        C.dedup(df, ["k"], "o", "some")


def test_dedup_of_files_aggregates_narrow_rows_in_hash_tables(spark, tmp_path):
    _table(spark).write.parquet(str(tmp_path / "t"))
    plan = C.dedup(spark.read.parquet(str(tmp_path / "t")), ["k"], "o")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ShuffledHashJoin" in plan


def test_distinct_counts_move_no_values(spark):
    df = spark.createDataFrame([("x", 1.0, "ab"), ("x", float("nan"), None), (None, float("nan"), "ab"), ("", -0.0, "c"), ("y", 0.0, None)],
                               "a string, b double, c string")
    out = P.null_distinct_profile(df)
    got = {r["column"]: (r["rows"], r["null_count"], r["distinct_count"]) for r in out.collect()}
    assert got == {"a": (5, 1, 3), "b": (5, 0, 3), "c": (5, 2, 2)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    empty = P.null_distinct_profile(df.limit(0)).collect()
    assert [(r["rows"], r["distinct_count"]) for r in empty] == [(0, 0)] * 3
    assert P.duplicate_key_count(df, "a").first()[0] == 1


def test_duplicate_flags_and_blank_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), (" \t  ",), ("b",), ("\x1c",)], "k string")
    flagged, names = V.flag_frame(df, "k")
    got = sorted((r["k"] or "~", r["missing_k"], r["duplicate_k"]) for r in flagged.collect())
    assert names == ["missing_k", "duplicate_k"]
    assert got == sorted([("a", False, True)] * 2 + [("~", True, True)] * 2 + [(" \t  ", True, False), ("b", False, False), ("\x1c", True, False)])


@pytest.mark.parametrize("a, b", [([0, 0, 1, 1, 2], [1, 1, 0, 0, 2]), ([0, 0, 0], [0, 0, 0]), ([0, 1, 0, 1], [0, 0, 1, 1]), ([0, 0, 1], [0, 1, 2]),
                                  ([0], [3]), ([], []), ([0, 0, 0, 0], [0, 1, 2, 3]), ([0, 1, 2, 2, 1, 0, 1], [1, 1, 2, 0, 1, 0, 0])])
def test_agreement_in_one_plan(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    got = M.ari_nmi(df, "a", "b").first()
    if not a:
        assert tuple(got) == (1.0, 1.0)
        return
    table = pd.crosstab(pd.Series(a), pd.Series(b)).to_numpy()
    assert tuple(got) == pytest.approx(M.ari_nmi_from_table(table), abs=1e-12)


def test_pairs_of_clusters_meet_once(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"x": list(rng.normal(size=(120, 2))), "c": np.arange(120) % 40}))
    got = M.close_means(df, "x", "c", 0.3)
    assert got.count() == 40 * 39 // 2 and got.select("cluster_a", "cluster_b").distinct().count() == 780
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter(F.col("cluster_a") >= F.col("cluster_b")).count() == 0
