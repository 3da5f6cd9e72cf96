"""Nothing is lost without a word: odd JSON, odd numbers, missing keys, emptied matrices, large shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from drivelaws.functions import scalars as X
from drivelaws.functions import special as sp
from drivelaws.operators import projections as P
from drivelaws.operators import reshape as H
from drivelaws.operators.kpis import signal_kpis
from drivelaws.plans.insights import store_insights
from drivelaws.sources import read as R
from drivelaws.sources.store import Store, extend_registry, write_csv

CELLS = ['{"a":NaN,"b":1}', '{"a":1,"a":2}', '{"a":{"b":NaN,"c":Infinity}}', '{"a":"12f","b":"1.5d","c":" 2 "}', '{"a":1',
         '{"q\\"uote":"x\\"y","t":true,"n":null}']


def test_lenient_cells(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "id int, cell string")
    got = {}
    for r in H.explode_drivers(df, ["id"], ["cell"]).collect():
        got.setdefault(r.id, []).append((r.dimension, r.classA, r.classB, r.correspondant_value))
    assert sorted(x[1] for x in got[0]) == ["a", "b"] and any(math.isnan(x[3]) for x in got[0])
    assert got[1] == [("H1D", "a", "none", 2.0)]
    assert {x[2] for x in got[2]} == {"b", "c"} and {x[0] for x in got[2]} == {"H2D"}
    assert sorted((x[1], x[3]) for x in got[3] if x[3] is not None) == [("c", 2.0)] and len(got[3]) == 3
    assert got[4] == [("H0D", "none", "none", None)]
    assert {(x[1], x[3]) for x in got[5]} == {('q"uote', None), ("t", 1.0), ("n", None)}
    melted = {r.id: (r.dimension, r.correspondant_value) for r in H.melt_trips(df, ["id"], ["cell"]).collect()}
    assert melted[1] == ("H1D", '{"a":2}') and melted[2][0] == "H2D" and melted[4][0] == "H0D"
    assert [(r.column, r.cell, r.rows) for r in H.unreadable(df, ["cell"]).collect()] == [("cell", '{"a":1', 1)]


def test_nan_leaf_keeps_its_matrix(spark):
    text = '{"x_axis":"u","matrix":{"A":{"B":{"C":NaN,"D":"3","E":"7f"}}}}'
    df = spark.createDataFrame([("s", "l", text)], "ref string, label string, m string")
    got = {r.ClassC: r.Correspondant_value for r in H.explode_matrix(df, "m", "ref", "label").collect()}
    assert set(got) == {"C", "D"} and math.isnan(got["C"]) and got["D"] == 3.0


def test_wrap_tells_repeats_and_fills_classes(spark):
    columns = "Study_ref string, Criteria_label string, ClassA string, ClassB string, ClassC string, Correspondant_value double"
    one = [("s", "l", "a", None, None, 1.0), ("s", "l", "b", "x", None, 2.0)]
    text = H.wrap_matrix(spark.createDataFrame(one, columns)).first().dfmatrix
    assert '"a":{"none":{"none":1.0}}' in text and '"b":{"x":{"none":2.0}}' in text
    with pytest.raises(Exception, match="more than once"):
        H.wrap_matrix(spark.createDataFrame([*one, one[0]], columns)).collect()


def test_numbers_as_text(spark):
    texts = ["12", " 1.5 ", "-2e3", ".5", "5.", "12f", "1.5d", "0x1F", "nan", "Infinity", "", "1_000", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", X.as_number(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(5)] == [12.0, 1.5, -2000.0, 0.5, 5.0]
    assert all(got[i] is None for i in (5, 6, 7, 10, 11, 12)) and math.isnan(got[8]) and got[9] == math.inf


def test_large_shapes():
    p = np.array([0.01, 0.5, 0.99])
    for shape in (1e3, 1e4, 1e5, 1e6, 1e7, 1e8, 1e9):
        a = np.full(3, shape)
        assert np.allclose(sp.gamma_cdf(a, sp.gamma_ppf(a, p)), p, rtol=1e-9)
        assert np.allclose(sp.beta_cdf(a, 2 * a, sp.beta_ppf(a, 2 * a, p)), p, rtol=1e-9)
        # the median of a gamma law is a - 1/3 + 8 / (405 a) + ...
        assert sp.gamma_cdf([shape], [shape - 1 / 3 + 8 / (405 * shape)])[0] == pytest.approx(0.5, abs=1e-9)
        assert sp.beta_cdf([shape], [shape], [0.5])[0] == pytest.approx(0.5, abs=1e-11)
    assert sp.gamma_ppf([1e8], [0.01])[0] == pytest.approx(99976738, abs=1)
    assert np.allclose(sp.lgamma([0.1, 1.0, 2.0, 7.5, 1e5]), [math.lgamma(v) for v in (0.1, 1.0, 2.0, 7.5, 1e5)], atol=1e-12)


def test_series_that_do_not_converge_say_so():
    assert np.isnan(sp.gamma_cdf([1500.0], [1400.0], rounds=5)).all()
    assert np.isnan(sp.beta_cdf([1500.0], [1.5], [0.999], rounds=3)).all()


@pytest.fixture
def store(spark, tmp_path):
    spark.sql(f"CREATE DATABASE losses LOCATION '{tmp_path}/db'")
    yield Store(spark)
    spark.sql("DROP DATABASE losses CASCADE")


def test_studies_are_told_apart_and_replaced(spark, store):
    tables = {"table": "losses.studies", "matrix_table": "losses.cells"}
    matrix = '{"matrix":{"A":{"B":{"C":1}}}}'
    columns = "Study_title string, Criteria_label string, region_country string, dfmatrix string"
    both = spark.createDataFrame([("t", "c", "EU", matrix), ("t", "c", "US", matrix)], columns)
    store_insights(both, "PFM", store, overwrite=True, **tables)
    assert store.read("losses.studies").count() == 2 and store.read("losses.cells").count() == 2
    # published again without cells: only the other study's are left
    store_insights(both.filter("region_country = 'EU'").withColumn("dfmatrix", F.lit(None).cast("string")), "PFM", store, overwrite=True, **tables)
    assert store.read("losses.studies").count() == 2 and store.read("losses.cells").count() == 1
    with pytest.raises(ValueError, match="same study"):
        store_insights(both.unionByName(both), "PFM", store, overwrite=True, **tables)


def test_replacing_needs_keys_and_prunes(spark, store):
    rows = spark.range(1000).select(
        F.col("id").cast("string").alias("DRIVER_ID"), F.col("id").cast("double").alias("TRIP_ID"), F.lit("c").alias("criteria"),
        (2000 + F.col("id") % 10).cast("int").alias("year"), F.lit(1).alias("month"), F.lit(0.0).alias("v"))
    store.create(rows, "losses.trips", ["year", "month"])
    new = rows.filter("year = 2003").withColumn("v", F.lit(1.0))
    with pytest.raises(ValueError, match="TRIP_ID"):
        store_insights(new.drop("TRIP_ID"), "TRIP_ID", store, overwrite=True, table="losses.trips")
    keys = ["DRIVER_ID", "TRIP_ID", "criteria", "year", "month"]
    old, _ = store.affected("losses.trips", keys, new.select(*keys), new)
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "2003" in plan
    store.replace_slice(new, "losses.trips", keys)
    got = store.read("losses.trips")
    assert got.count() == 1000 and got.filter("v = 1").count() == 100


def test_merges_scan_each_side_once(spark, tmp_path):
    from drivelaws.operators.merge import merge_columns

    for name in ("old", "new"):
        spark.range(100).select(F.col("id").alias("k"), F.lit(name).alias(name)).write.parquet(f"{tmp_path}/{name}")
    merged = merge_columns(spark.read.parquet(f"{tmp_path}/old"), spark.read.parquet(f"{tmp_path}/new"), ["k"])
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Join") == 1


def test_registry_keeps_accents(spark, tmp_path):
    rows = spark.createDataFrame([("température", "10")], "Signal string, Frequence string")
    write_csv(rows, f"{tmp_path}/registry")
    assert R.read_registry(spark, f"{tmp_path}/registry").collect() == rows.collect()
    for _ in range(2):
        extend_registry(rows, f"{tmp_path}/grown")
    assert R.read_registry(spark, f"{tmp_path}/grown").collect() == rows.collect() * 2


def test_kpis_carry_columns_along(spark):
    df = spark.createDataFrame([("s", i, float(i), "c1") for i in range(5)], "signal string, t int, v double, campaign string")
    row = signal_kpis(df, ["signal"], "v", ["t"], carry=["campaign"]).first()
    assert (row.signal, row.campaign, row.COUNT, row.P50) == ("s", "c1", 5, 2.0)


def test_first_row_of_ties(spark):
    rows = [("c", None, "estimation", 2.0), ("c", None, "estimation", 1.0), ("c", None, "empirical", 3.0)]
    df = spark.createDataFrame(rows, "criteria string, class_index int, method string, v double")
    for part in (df, df.orderBy("v"), df.repartition(3)):
        assert [tuple(r) for r in P.first_model_row(part).collect()] == [("c", None, "empirical", 3.0)]


def test_lenient_cells_have_no_level_limit(spark):
    deep = '{"a":' * 40 + '{"n":NaN,"k":1,"k":1.50}' + "}" * 40
    df = spark.createDataFrame([(0, deep), (1, '{"a":{"b":1}}'), (2, None)], "id int, cell string")
    got = {r.id: (r.dimension, r.correspondant_value) for r in H.melt_trips(df, ["id"], ["cell"]).collect()}
    assert got[0][0] == "H2D" and got[0][1].replace("1.50", "1.5") == '{"a":' * 40 + '{"k":1.5,"n":"NaN"}' + "}" * 40
    assert got[1] == ("H2D", '{"a":{"b":1}}') and got[2] == ("H0D", None)


def test_strict_cells_have_a_branch_without_python(spark):
    df = spark.createDataFrame([(0, '{"a":1}')], "id int, cell string")
    strict, lenient = H._long(df, ["id"], ["cell"])
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in (strict, lenient)]
    assert "ArrowEvalPython" not in plans[0] and "ArrowEvalPython" in plans[1]
    assert plans[0].count("from_json") <= 1
