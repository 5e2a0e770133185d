"""Records of a search: ragged unions, aggregation by type, best rows, adapters."""

import json

import numpy as np
import pandas as pd
import pytest

from clusterlens.operators import mixture as MX
from clusterlens.operators import models as MOD
from clusterlens.operators import records as REC
from clusterlens.operators import select as SEL


def test_aggregation_by_type(spark):
    rows = [(1, 0, {"a": 1, "b": True, "s": "x", "t": "u", "l": [{"c": 1}], "n": None, 'q"k': 2.5, "m": None}),
            (1, 1, {"a": 2.5, "b": False, "s": "x", "t": "v", "l": [{"c": 1}], "n": None, 'q"k': 2.5, "m": 7}),
            (2, 0, {"a": 4, "b": True, "extra": 1e-12})]
    records = REC.from_dicts(spark, [(c, s, json.dumps(r)) for c, s, r in rows], "c int, seed int")
    got = {r[0]: json.loads(r[1]) for r in REC.aggregate_records(records, ["c"]).selectExpr("c", "to_json(record)").collect()}
    assert got[1] == {"a": 1.75, "a_std": 0.75, "b": False, "s": "x", "l": [{"c": 1}], "n": None, 'q"k': 2.5, 'q"k_std': 0.0, "m": 7.0}
    assert got[2] == {"a": 4.0, "b": True, "extra": 1e-12}
    wide = REC.columns_of(REC.aggregate_records(records, ["c"]), {"a": "double", "b": "boolean", "extra": "double", "s": "string"})
    assert sorted(map(tuple, wide.collect())) == [(1, 1.75, False, None, "x"), (2, 4.0, True, 1e-12, None)]


def test_ragged_union(spark):
    a = REC.as_records(spark.createDataFrame([(1, 2.0, None)], "id int, x double, y string"), ["id"])
    b = REC.as_records(spark.createDataFrame([(2, True)], "id int, z boolean"), ["id"])
    got = {(r["id"], r["key"]): r["kind"] for r in REC.fields(REC.union_records(a, b)).collect()}
    assert set(got) == {(1, "x"), (1, "y"), (2, "z")} and got[1, "y"] == "VOID" and got[2, "z"] == "BOOLEAN"


def test_best_row_and_seeds(spark):
    ranked = spark.createDataFrame([(2, 5, "diag"), (1, 4, "full"), (3, 6, None)], "selection_rank int, k int, covariance_type string")
    assert SEL.best_row(ranked, {"k": 5, "covariance_type": "diag", "other": 1}).first()["selection_rank"] == 2
    assert SEL.best_row(ranked, {"k": 5, "covariance_type": "full"}).first()["selection_rank"] == 1
    assert SEL.best_row(ranked, {"covariance_type": None}).first()["selection_rank"] == 3
    assert SEL.seed_sequence(42, 3, 10) == [42, 52, 62] and SEL.seed_sequence(7, 1) == [7]


@pytest.mark.parametrize("family, seeds", [("kmeans", (1, 2, 3)), ("gmm", (1,))])
def test_adapters(spark, family, seeds):
    rng = np.random.default_rng(0)
    X = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(60, 2)) + 9])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "x": list(X)}))
    adapter = MOD.get_adapter("gmm" if family == "gmm" else "kmeans_reduced")
    with MX.Matrix.of(df, "x", "id") as m:
        ranked, best, _ = adapter.search(m, (2, 3), seeds, max_iter=50)
        assert len(adapter.selection_candidates((2, 3))) == ranked.count()
        params = adapter.pick_best_params(ranked)
        assert params["k"] == 2 and adapter.best_row(ranked, params)["selection_rank"] == 1 == best["selection_rank"]
        for c in ("stability_ari_mean", "stability_nmi_std", "silhouette_std", "degenerate_any_seed", "seed_values"):
            assert c in ranked.columns  # also with one seed
        assert (best["stability_ari_mean"] is None) == (len(seeds) == 1)
        summary = SEL.selection_summary(ranked, adapter.scoring).first()
        assert summary["best_k"] == 2 and summary["candidate_count"] == ranked.count()
        model, record = adapter.fit_candidate(m, {**params, "max_iter": 50}, 1)
        assert record["k"] == 2
        if family == "kmeans":
            lab = MX._sq_dists(X, model["centres"]).argmin(1)
            between = sum((lab == j).sum() * ((X[lab == j].mean(0) - X.mean(0)) ** 2).sum() for j in range(2))
            within = sum(((X[lab == j] - X[lab == j].mean(0)) ** 2).sum() for j in range(2))
            assert record["calinski_harabasz"] == pytest.approx(between / (within / 118))
    assert adapter.predict(model, df, "x", "id").groupBy("cluster").count().count() == 2
    with pytest.raises(NotImplementedError):
        MOD.Adapter().fit(None, {}, 1)
