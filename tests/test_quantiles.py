import math

import numpy as np
from pyspark.sql import functions as F

from orbweave.operators.running import quantiles


def test_quantiles_equal_numpy(spark):
    """Ties, a group of one, a null group, null values, a group without any."""
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 40, 500)] + [("b", 7.0), ("b", None), (None, 1.0), (None, 4.0), ("empty", None)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, x double"), "x", {"q05": 0.05, "q50": 0.5, "q99": 0.99}, ("g",)).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        values = [x for k, x in rows if k == g and x is not None]
        assert r.n == len(values)
        assert np.allclose([r.q05, r.q50, r.q99], np.quantile(values, [0.05, 0.5, 0.99]))


def test_quantiles_of_a_whole_table(spark):
    df = spark.range(10_001).select((F.col("id") * 37 % 10_001).cast("double").alias("x"))
    assert quantiles(df, "x", {"p": 0.25}).first().p == 2500.0
    assert quantiles(df.where("x < 0"), "x", {"p": 0.25}).count() == 0
    odd = spark.createDataFrame([(1.0,), (math.inf,), (math.nan,)], "x double")
    assert quantiles(odd, "x", {"p": 0.5}).first().p == math.inf


def test_no_task_gathers_a_group(spark):
    plan = quantiles(spark.range(100).withColumn("x", F.rand(1)), "x", {"p": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect" not in plan.lower()
