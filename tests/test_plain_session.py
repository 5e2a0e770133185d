"""Queries without a SQL twin must run in a plain session, without Arrow conversion."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
PLAIN = sorted(q for q in set(E.queries()) - set(E.oracle_sql()) if not q.startswith("op") and q != "pipeline")


@pytest.fixture
def plain(spark):
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", PLAIN)
def test_runs_without_arrow_conversion(plain, name):
    assert E.queries()[name](plain, SF).collect()


def test_final_metrics_of_one_cluster(plain):
    from pyspark.sql import functions as F
    from clusterlens.plans import workflow as W
    m = plain.range(20).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    a = m.select("id", F.lit(0).alias("cluster"), F.array(F.lit(1.0)).alias("prob"), F.lit(1.0).alias("max_probability"),
                 F.lit(0.0).alias("assignment_entropy"), F.lit(0.0).alias("log_density"))
    assert W.final_metrics(a, m, "id").first()["silhouette"] is None
