import math

import pytest
from pyspark.sql import functions as F

from fieldwire.llm import mixing
from odd import docs, empty, rows


def test_cumulative_is_the_poisson_distribution(spark):
    for rate in (0.0, 0.01, 0.7, 3.0, 40.0, 900.0):
        cdf = spark.range(1).select(mixing.cumulative(F.lit(rate)).alias("c")).first()["c"]
        total, want = 0.0, []
        for k in range(len(cdf)):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
            want.append(total)
        assert cdf == pytest.approx(want, abs=1e-9) and cdf[-1] == pytest.approx(1, abs=1e-9)


def test_sources_meet_their_weights(spark):
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 9).cast("string"))).alias("source"), F.lit("t").alias("text"))
    weights = spark.createDataFrame([("big", 1.0), ("s2", 2.0), ("s5", 0.5), ("s8", 0.0), ("absent", 9.0)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.mix(many, weights).groupBy("source").count().collect()}
    for source, weight in (("big", 1.0), ("s2", 2.0), ("s5", 0.5)):
        want = 40_000 * weight / 3.5
        assert abs(got[source] - want) < 5 * math.sqrt(want)
    assert "s8" not in got
    twice = mixing.mix(many, weights).collect()
    assert twice == mixing.mix(many, weights).collect()


def test_global_order(spark):
    df = mixing.mix(docs(spark), mixing.temperature_weights(docs(spark)), rows=500).withColumn("p", F.spark_partition_id())
    for keys in df.groupBy("p").agg(F.collect_list("mix_key").alias("k")).collect():
        assert keys.k == sorted(keys.k)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark):
    got = mixing.mix(docs(spark), mixing.temperature_weights(docs(spark)), rows=400)
    assert got.columns[-2:] == ["copy_no", "mix_key"] and "digest" in got.columns
    by = {}
    for r in got.collect():
        by.setdefault((r.doc_id, r.text), []).append(r.copy_no)
    assert by[1, rows()[0][1]] == list(range(1, max(by[1, rows()[0][1]]) + 1)) or sorted(by[1, rows()[0][1]]) == list(range(1, len(by[1, rows()[0][1]]) + 1))
    assert mixing.mix(empty(spark), mixing.temperature_weights(empty(spark))).count() == 0
    null = spark.createDataFrame([("a", None), (None, -1.0)], "source string, weight double")
    assert mixing.mix(docs(spark), null).count() == 0
