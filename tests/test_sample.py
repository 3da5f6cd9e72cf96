import numpy as np
import pytest
from pyspark.sql import functions as F

from drivelaws.operators import sample as S
from drivelaws.operators import scale

PS = [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]


def groups():
    rng = np.random.default_rng(11)
    return {
        "normal": rng.normal(50, 3, 4000), "heavy": rng.lognormal(0, 4, 5000), "ties": rng.integers(1, 4, 3000).astype(float),
        "constant": np.full(2000, 7.0), "mostly": np.concatenate([np.full(3000, 1.0), rng.random(50)]), "one": np.array([3.0]),
        "few": rng.random(29),
    }


@pytest.mark.parametrize("gather", [0, 20, 1000, 10**6])
def test_percentiles_are_exact_whatever_is_gathered(spark, gather):
    data = groups()
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("normal", None), ("normal", float("nan"))]
    df = spark.createDataFrame(rows, "criteria string, x double").repartition(7)
    got = {r.criteria: r.pct for r in S.percentiles(df, PS, gather=gather).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        assert np.allclose(got[k], np.percentile(values, [100 * p for p in PS]), rtol=1e-13), k


def test_percentiles_with_a_null_group(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(10)], "criteria string, x double")
    for hot in (0, 100):
        rows = S.percentiles(df, [0.5], gather=hot).collect()
        assert [(r.criteria, r.pct) for r in rows] == [(None, [4.5])]


def test_salted_attach_equals_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([("a" if i % 3 else None, float(i)) for i in range(300)], "criteria string, x double")
    table = scale.settle(spark.createDataFrame([("a", 1), (None, 2)], "criteria string, m int"))
    plain = sorted(map(str, scale.attach(df, table, ["criteria"]).collect()))
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    salted = scale.attach(df, table, ["criteria"])
    assert sorted(map(str, salted.collect())) == plain and len(plain) == 300
    got = {r.criteria: r.pct for r in S.percentiles(df, PS, gather=0).collect()}
    a = [float(i) for i in range(300) if i % 3]
    assert np.allclose(got["a"], np.percentile(a, [100 * p for p in PS]))


def test_percentiles_of_a_wide_range(spark):
    values = [1e-300, 1e-5, 1.0, 2.0, 3.0, 1e10, 1e200, 1e307, 1.5e308] + [5.0] * 4000
    df = spark.createDataFrame([("w", v) for v in values], "criteria string, x double")
    got = S.percentiles(df, [0.0, 0.0005, 0.5, 0.999, 1.0], gather=3).first().pct
    order = sorted(values)
    at = [(len(order) - 1) * p for p in (0.0, 0.0005, 0.5, 0.999, 1.0)]
    want = [order[int(a)] + ((order[min(int(a) + 1, len(order) - 1)] - order[int(a)]) * (a % 1) if a % 1 else 0.0) for a in at]
    assert got == pytest.approx(want)


def test_hot_equal_values_spread(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    table = scale.settle(spark.createDataFrame([("a", 1)], "criteria string, m int"))
    df = spark.range(0, 40_000, 1, 8).select(F.lit("a").alias("criteria"), F.lit(1.0).alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        used = scale.attach(df, table, ["criteria"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(used) >= 6 and max(r["count"] for r in used) < 20_000


def test_running_totals_across_chunks(spark):
    df = spark.createDataFrame([(i % 2 or None, i // 5, i, i * i % 7) for i in range(60)], "g int, c int, i int, v int")
    got = scale.running(df, ["g"], "c", ["i"], sums={"s": F.col("v")}, maxima={"m": F.col("v")}).collect()
    for r in got:
        before = [q.v for q in got if q.g == r.g and q.i < r.i]
        assert r.s == sum(before) and r.m == max(before, default=None)
    assert len(got) == 60


def test_to_sample_keeps_positive_numbers_only(spark):
    df = spark.createDataFrame([("g", 1.0, 2), ("g", -1.0, 0), ("h", float("nan"), None), (None, 0.0, 3)], "k string, `a:R` double, b int")
    got = S.to_sample(df, ["a:R", "b"]).collect()
    assert sorted((r.criteria, r.x) for r in got) == [("a:R", 1.0), ("b", 2.0), ("b", 3.0)]
    assert [(r.criteria, r.x) for r in S.to_sample(df, ["a:R"], "k").collect()] == [("g", 1.0)]


def test_density_hist_matches_numpy(spark):
    values = np.random.default_rng(2).gamma(2, 3, 3000)
    df = spark.createDataFrame([("c", float(v)) for v in values], "criteria string, x double")
    want, _ = np.histogram(values, bins=30, density=True)
    got = sorted((r.bin, r.density) for r in S.density_hist(df).collect())
    assert np.allclose([d for _, d in got], want) and len(got) == 30
