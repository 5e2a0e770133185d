import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from clusterlens.operators import quantiles
from clusterlens.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [40, 2000])
def test_exact_quantiles_match_numpy(spark, monkeypatch, accuracy):
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame({
        "g": rng.integers(0, 3, n),
        "a": np.round(rng.lognormal(3, 2, n), 3),
        "b": rng.integers(0, 5, n).astype(float),
    })
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)  # 40: brackets of the sketch, 2000: all values
    got = exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75], by=["g"]).toPandas()
    assert len(got) == 18
    for _, r in got.iterrows():
        vals = pdf.loc[pdf.g == r["g"], r["column"]].dropna()
        assert abs(vals.quantile(r["prob"]) - r["value"]) < 1e-9
        assert r["n"] == len(vals)


def test_exact_quantiles_global_single_value(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [5.0, 5.0, 5.0]}))
    got = exact_quantiles(df, ["x"], [0.5]).collect()
    assert got[0]["value"] == 5.0


def test_approx_quantiles_are_close_and_same_shape(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 5000), "a": rng.normal(size=5000)})
    df = spark.createDataFrame(pdf)
    ex = quantiles.quantiles(df, ["a"], [0.25, 0.5], by=["g"]).toPandas().sort_values(["g", "prob"]).reset_index(drop=True)
    ap = quantiles.quantiles(df, ["a"], [0.25, 0.5], by=["g"], method="approx").toPandas()
    ap = ap.sort_values(["g", "prob"]).reset_index(drop=True)
    assert list(ex.columns) == list(ap.columns)
    assert (abs(ex["value"] - ap["value"]) < 0.01).all()


@pytest.mark.parametrize("accuracy", [100, 2000])
def test_exact_quantiles_with_infinite_and_extreme_values(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    inf = float("inf")
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=6000), [inf] * 900, [-inf] * 300, 2.0 ** np.arange(-100.0, 100.0, 25.0),
                             [1.7e308, -1.7e308]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.87, 0.95, 1.0]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], probs).collect()}
    ordered = np.sort(values)
    for p in probs:
        h = (len(ordered) - 1) * p
        lo, hi = ordered[int(np.floor(h))], ordered[int(np.ceil(h))]
        want = lo if lo == hi else lo + (hi - lo) * (h - np.floor(h))
        assert got[p] == want or abs(got[p] - want) <= 1e-9 * abs(want), p


def test_exact_quantiles_between_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(0, inf), (0, inf), (1, -inf), (1, 3.0), (2, -inf), (2, inf)], "g int, x double")
    got = {r["g"]: r["value"] for r in exact_quantiles(df, ["x"], [0.5], by=["g"]).collect()}
    assert got[0] == inf and got[1] == -inf and np.isnan(got[2])


def test_many_groups_null_keys_and_no_values(spark):
    """No limit on groups, NULL groups kept, columns without values left out, nothing collected on the way."""
    df = spark.range(30_000).select((F.col("id") % 10_000).alias("id"), F.when(F.col("id") % 10_000 > 0, F.col("id") % 10_000).alias("g"),
                                    F.col("id").cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    got = exact_quantiles(df, ["x", "y"], [0.5], by=["g"])
    row = got.agg(F.count("*"), F.count_if(F.col("value") == F.coalesce("g", F.lit(0)) + 10_000), F.count_if(F.col("g").isNull())).first()
    assert tuple(row) == (10_000, 10_000, 1)
    assert exact_quantiles(df.limit(0), ["x"], [0.5]).count() == 0
