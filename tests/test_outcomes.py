import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drivelaws.operators import likelihood as L
from drivelaws.operators import ranking as R
from drivelaws.operators.scale import settle
from drivelaws.plans import modelling as M


def sample_of(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [("w", float(x)) for x in 5 * rng.weibull(1.7, n)] + [("g", float(x)) for x in rng.gumbel(60, 3, n)]
    return spark.createDataFrame(rows, "criteria string, x double")


def outcomes(models):
    return {(r.criteria, r.method, r.status) for r in models.select("criteria", "method", "status").distinct().collect()}


def test_status_says_what_the_gate_came_to(spark, monkeypatch):
    """Criteria whose estimate fails keep their class rows and say so, in the model table as well."""
    sample = sample_of(spark).unionByName(spark.createDataFrame([("few", 1.0), ("few", 2.0)], "criteria string, x double"))
    assert outcomes(M.model_sample(sample, 8, "weibull", threshold=1e9)) == {
        ("w", "class", "success"), ("g", "class", "success"), ("few", "empirical", None)}
    assert outcomes(M.model_sample(sample, 8, "weibull", threshold=-1.0)) == {
        ("w", "estimation", "fallback"), ("g", "estimation", "fallback"), ("few", "empirical", None)}
    estimate = M.estimate

    def none_of_w(*given, **options):
        found = estimate(*given, **options)
        return found.withColumn("params", F.when(F.col("criteria") != "w", F.col("params")))

    monkeypatch.setattr(M, "estimate", none_of_w)
    models = M.model_sample(sample, 8, "weibull", threshold=-1.0)
    assert outcomes(models) == {("w", "class", "failed"), ("g", "estimation", "fallback"), ("few", "empirical", None)}
    table = M.model_table(models, "[X] s", {})
    assert {(r.criteria, r.status) for r in table.filter("is_best").collect()} == {("w", "failed"), ("g", "fallback"), ("few", None)}


def test_roots_settle_from_far_starts_or_are_left_out(spark, monkeypatch):
    sample = sample_of(spark)
    stats = settle(R.ranking_stats(sample))
    bounds = settle(stats.select("criteria", "n", "data_min", "data_max").withColumn("shift", F.lit(0.0)))
    near = {r.criteria: r for r in L.weibull_mle(sample, bounds).collect()}
    near_gumbel = {r.criteria: r for r in L.gumbel_mle(sample, stats).collect()}
    assert all(r.residual <= L.RESIDUAL for r in [*near.values(), *near_gumbel.values()])

    for far in (0.02, 50.0):
        start = F.pandas_udf(lambda sizes, means, far=far: pd.Series([far] * len(sizes), dtype=float), T.DoubleType())
        monkeypatch.setattr(L, "_weibull_start", start)
        monkeypatch.setattr(L, "_gumbel_start", start)
        for r in L.weibull_mle(sample, bounds).collect():
            assert abs(r.beta_shape / near[r.criteria].beta_shape - 1) < 1e-9 and abs(r.lambda_scale / near[r.criteria].lambda_scale - 1) < 1e-9
    monkeypatch.setattr(L, "MOST_PASSES", 1)
    assert L.weibull_mle(sample, bounds).isEmpty()
