"""Property tests: shares sum to 1, ARI / NMI invariant to relabelling, ARI(x, x) = 1."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from clusterlens.operators import evaluate as EV
from clusterlens.operators import lift as L
from clusterlens.operators.metrics import ari_nmi_from_table


def _table(a, b):
    ua, ub = sorted(set(a)), sorted(set(b))
    ct = np.zeros((len(ua), len(ub)))
    for x, y in zip(a, b):
        ct[ua.index(x), ub.index(y)] += 1
    return ct


labels = st.lists(st.integers(0, 4), min_size=2, max_size=60)


@settings(max_examples=60, deadline=None)
@given(labels, st.permutations(range(5)))
def test_ari_nmi_invariant_to_relabelling(a, perm):
    rng = np.random.default_rng(len(a))
    b = list(rng.integers(0, 3, len(a)))
    relabelled = [perm[x] for x in a]
    r1 = ari_nmi_from_table(_table(a, b))
    r2 = ari_nmi_from_table(_table(relabelled, b))
    assert np.allclose(r1, r2)
    assert np.allclose(ari_nmi_from_table(_table(a, a)), (1.0, 1.0))


def test_cluster_shares_sum_to_one(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"cluster": rng.integers(0, 4, 400),
                        "cat": rng.choice(["a", "b", "c", None], 400)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "cluster long, cat string")
    rec = L.category_lift(df, "cluster", "cat", top_n=None).toPandas()
    assert np.allclose(rec.groupby("cluster")["cluster_share"].sum(), 1.0)
    assert np.isclose(rec.groupby("value")["global_share"].first().sum(), 1.0)
    sizes = EV.cluster_sizes(df, "cluster", k=6).toPandas()
    assert np.isclose(sizes["proportion"].sum(), 1.0) and (sizes.loc[sizes.cluster >= 4, "size"] == 0).all()
