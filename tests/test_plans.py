"""Plan-shape checks for the scale properties the operators rely on."""

from pyspark.sql import functions as F

from clusterlens.operators import clean as C
from clusterlens.operators import evaluate as EV
from clusterlens.plans import catalog as CAT
from clusterlens.plans.registry import tbl

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_is_partial_aggregation(spark):
    e = tbl(spark, SF, "events").select("event_id", "user_id", "value")
    p = _plan(C.dedup(e, ["user_id"], "event_id", "first"))
    assert "HashAggregate" in p and "partial_min_by" in p and "Window" not in p and "SortAggregate" not in p


def test_top_n_per_cluster_limits_before_shuffle(spark):
    e = tbl(spark, SF, "embeddings").withColumn("p", F.col("vec_id") * 1.0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(EV.top_rows(e, "label", "p", "vec_id", 3))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_lift_prunes_columns_and_uses_partial_aggregation(spark):
    df = CAT.q_lift_by_cluster(spark, SF)
    p = _plan(df)
    assert "partial_count" in p
    assert "ReadSchema: struct<lang:string,source:string>" in df._jdf.queryExecution().toString() or \
        "struct<lang:string,source:string>" in p


def test_no_percentile_value_maps_in_profiles(spark):
    for q in (CAT.q_profile_numeric, CAT.q_cluster_numeric, CAT.q_median_impute):
        plan = _plan(q(spark, SF)).lower().replace("percentile_approx", "sketch")
        assert "percentile" not in plan and "median(" not in plan
