import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from drivelaws.functions import scalars as X
from drivelaws.operators import merge as M
from drivelaws.operators import projections as P
from drivelaws.operators import sizing as Z
from drivelaws.operators import study as Y
from drivelaws.operators.kpis import distinct_on, signal_kpis
from drivelaws.plans import insights as I
from drivelaws.sources import read as R
from drivelaws.sources.store import Store, write_csv


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def versions(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, None, 20), (3, "c", 30)], "k int, v string, only_old int")
    new = spark.createDataFrame([(2, "B", 1.0), (3, None, 2.0), (4, "D", 3.0)], "k int, v string, only_new double")
    return old, new


def test_merge_takes_the_preferred_side_whole(versions):
    old, new = versions
    got = {r.k: (r.v, r.only_old, r.only_new) for r in M.merge_columns(old, new, ["k"]).collect()}
    assert got == {1: (None, 10, None), 2: ("B", 20, 1.0), 3: (None, 30, 2.0), 4: ("D", None, 3.0)}
    got = {r.k: r.v for r in M.merge_columns(old, new, ["k"], prefer="old").collect()}
    assert got == {1: "a", 2: None, 3: "c", 4: None}
    got = {r.k: r.v for r in M.merge_columns(old, new, ["k"], fill_nulls=True).collect()}
    assert got == {1: "a", 2: "B", 3: "c", 4: "D"}
    assert {r.k for r in M.merge_columns(old, new, ["k"], how="left").collect()} == {2, 3, 4}


def test_merges_are_idempotent(versions):
    old, new = versions
    once = M.merge_columns(old, new, ["k"])
    assert rows(M.merge_columns(once, new, ["k"])) == rows(once)
    assert rows(M.merge_columns(once, new, ["k"], prefer="old")) == rows(once)
    replaced = M.anti_replace(old, new, ["k"])
    assert rows(M.anti_replace(replaced, new, ["k"])) == rows(replaced)
    ranked = M.ranked_union(old, new, ["k"])
    assert rows(M.ranked_union(ranked, new, ["k"])) == rows(ranked) and ranked.count() == 4


def test_level_dispatch_rejects_unknown(versions):
    with pytest.raises(ValueError):
        M.merge_level(*versions, "other")


def test_ranked_union_prefers_and_breaks_ties(spark):
    new = spark.createDataFrame([("k", 2, "n"), ("k", 1, "n"), (None, 5, "n")], "key string, v int, s string")
    old = spark.createDataFrame([("k", 0, "o"), ("j", 3, "o"), (None, 4, "o")], "key string, v int, s string")
    assert {r["key"]: (r.v, r.s) for r in M.ranked_union(old, new, ["key"]).collect()} == {"k": (1, "n"), "j": (3, "o"), None: (5, "n")}
    assert {r["key"]: (r.v, r.s) for r in M.ranked_union(old, new, ["key"], prefer="old").collect()} == {"k": (0, "o"), "j": (3, "o"), None: (4, "o")}
    assert distinct_on(new, ["key"]).count() == 2


def test_projections_with_awkward_names(spark):
    df = spark.createDataFrame([(1, 2, 3.5)], "`b:R` int, a int, `p.1%` double")
    assert P.cast_by_name(df).dtypes == [("b:R", "double"), ("a", "int"), ("p.1%", "double")]
    assert P.keys_first(df, ["a"]).columns == ["a", "b:R", "p.1%"]
    assert P.keep_existing(df, ["p.1%", "zz"]).columns == ["p.1%"]
    assert P.slice_eq(df, **{"p.1%": 3.5}).count() == 1


def test_store_replaces_only_the_slice_and_clears_emptied_partitions(spark):
    store, table = Store(spark), "slices"
    df = spark.createDataFrame([("d1", 1, 1.0), ("d1", 2, 2.0), ("d2", 1, 3.0), ("d3", 3, 9.0)], "driver string, month int, v double")
    store.create(df, table, ["month"])
    new = spark.createDataFrame([(5.0, "d1", 1), (6.0, "d1", 4)], "v double, driver string, month int")
    for _ in range(2):
        store.replace_slice(new, table, ["driver"])
        assert sorted(tuple(r) for r in store.read(table).select("driver", "month", "v").collect()) == [
            ("d1", 1, 5.0), ("d1", 4, 6.0), ("d2", 1, 3.0), ("d3", 3, 9.0)]
    store.append(spark.createDataFrame([("d9", 9, "x")], "driver string, month int, extra string"), table)
    got = {r.driver: (r.v, r.extra) for r in store.read(table).collect()}
    assert got["d9"] == (None, "x") and got["d2"] == (3.0, None)
    store.overwrite(store.read(table).filter("driver = 'd2'"), table)
    assert [r.driver for r in store.read(table).collect()] == ["d2"]


def test_replacing_by_a_copy_of_itself_with_null_partition(spark):
    store, table = Store(spark), "nullpart"
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, p string, v int")
    store.create(df, table, ["p"])
    store.replace_slice(spark.createDataFrame([("a", "x", 3)], "k string, p string, v int"), table, ["k"])
    assert sorted((r.k, r.p, r.v) for r in store.read(table).collect()) == [("a", "x", 3), ("b", "x", 2)]


def test_store_run_persists_one_run(spark):
    store = Store(spark)
    tables = {"data": "run_data", "meta": "run_meta", "info": "run_info"}
    keys = "Loan_Conducteur_ID string, VIN string, tcid_runid string, ID string, TIMESTAMP int, TEMPS double"
    first = spark.createDataFrame([("d", "v", "t_1", "i", 1, 0.1, 5), ("d", "v", "t_1", "i", 2, 0.2, 6)], keys + ", `s:R` int")
    second = spark.createDataFrame([("d", "v", "t_1", "i", 2, 0.2, 7), ("d", "v", "t_1", "i", 3, 0.3, 8)], keys + ", `z:R` int")
    meta = spark.createDataFrame([("d", "v", "t_1", "i", "s:R", "km")], "Loan_Conducteur_ID string, VIN string, tcid_runid string, ID string, signal string, unit string")
    other = spark.createDataFrame([("d", "v", "t_1", "i", "s:R", "mi")], meta.schema)
    I.store_run(store, "d", "t_1", tables, data=first, meta=meta)
    I.store_run(store, "d", "t_1", tables, data=second, meta=other)
    data = store.read("run_data")
    assert dict(data.dtypes)["s:R"] == "double"
    assert {r.TIMESTAMP: (r["s:R"], r["z:R"]) for r in data.collect()} == {1: (5.0, None), 2: (6.0, 7.0), 3: (None, 8.0)}
    assert store.read("run_meta").first().unit == "km"
    I.store_run(store, "d", "t_1", tables, meta=other, overwrite=True)
    assert store.read("run_meta").first().unit == "mi"


def test_trip_and_driver_publication(spark):
    store = Store(spark)
    trip = spark.createDataFrame([("d", 1.0, 1, 2024, "c", "5"), ("d", 2.0, 1, 2024, "c", "6")],
                                 "DRIVER_ID string, TRIP_ID double, month int, year int, criteria string, correspondant_value string")
    I.store_insights(trip, "trip_id", store, "s", table="t_ins")
    I.store_insights(trip.filter("TRIP_ID = 1").withColumn("correspondant_value", F.lit("9")), "TRIP_ID", store, "s", overwrite=True, table="t_ins")
    assert {r.TRIP_ID: r.correspondant_value for r in store.read("t_ins").collect()} == {1.0: "9", 2.0: "6"}
    I.store_insights(trip, "TRIP_ID", store, "s", table="t_ins")
    assert store.read("t_ins").count() == 4
    with pytest.raises(ValueError):
        I.store_insights(trip, "other", store)


def test_level_store(spark):
    store = Store(spark)
    a = spark.createDataFrame([("d", 1, 5)], "DRIVER_ID string, month int, v int")
    I.store_level(a, "VIn", "lvl", store)
    I.store_level(spark.createDataFrame([("d", 1, 6, 7)], "DRIVER_ID string, month int, v int, w int"), "VIn", "lvl", store)
    assert store.read("lvl").select("v", "w").first() == (5, 7)


def test_study_refs(spark):
    titles = ["[fleet ] x", "plain", "", None, "a [B c] [d]", "[]"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = [r.r for r in df.select(X.study_ref(F.col("t"), F.coalesce("t", F.lit("-"))).alias("r")).collect()]
    assert [g.rsplit("_", 1)[0] for g in got] == ["FLEET", "PFM", "PFM", "PFM", "B C", "PFM"]
    assert all(len(g.rsplit("_", 1)[1]) == 6 and g.rsplit("_", 1)[1].isalnum() for g in got)
    again = [r.r for r in df.select(X.study_ref(F.col("t"), F.coalesce("t", F.lit("-"))).alias("r")).collect()]
    loose = {r.r for r in spark.range(200).select(X.study_ref(F.lit("t")).alias("r")).collect()}
    assert again == got and len(loose) == 200


def test_scalars(spark):
    df = spark.createDataFrame([("x:R:255", "net", "ch"), ("bad", "net", "ch")], "nom string, net string, ch string")
    assert [r.t for r in df.select(X.chan_title(F.col("nom"), F.col("net"), F.col("ch")).alias("t")).collect()][0] == "CAN@net@0FF@ch"
    stats = spark.createDataFrame([("1", "2.5", None), ("x", "1", "2")], "a string, b string, c string").select(
        X.stats_json(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert json.loads(stats[0].s) == [1.0, 2.5, None] and stats[1].s == "[]"
    dates = spark.createDataFrame([("31/12/2023",), ("2023-12-31",), ("soon",)], "d string").select(X.study_date(F.col("d")).alias("d")).collect()
    assert [str(r.d) for r in dates] == ["2023-12-31", "2023-12-31", "None"]


def test_study_validation_lists_each_missing_field(spark):
    good = {"Study_title": "t", "Criteria_label": "c", "Criteria_description": "d", "Norm_applied": "n", "Energy_category": "e", "Segment": "s",
            "region_country": "r", "Data_source": "x", "Vin_list": "v", "List_of_signal_names": "l", "dimension": "H1D"}
    cases = [good] + [{**good, f: blank} for f in Y.REQUIRED for blank in (None, "")] + [{**good, "dimension": "H4D"}, {**good, "dimension": None}]
    df = spark.createDataFrame([(i, *(c[f] for f in good)) for i, c in enumerate(cases)], "id int, " + ", ".join(f"{f} string" for f in good))
    errors = {r.id: r.errors for r in Y.validate(df).collect()}
    assert errors[0] == [] and all(errors[i] for i in range(1, len(cases)))
    for i, c in enumerate(cases[1:-2], 1):
        field = next(f for f in good if c[f] != good[f])
        assert f"E4 no value for: {field}" in errors[i]
    valid, rejected = Y.build(df)
    assert valid.count() == 1 and rejected.count() == len(cases) - 1
    with pytest.raises(ValueError):
        Y.build(df, strict=True)


def test_sizing_formula(spark):
    df = spark.range(10)
    report = Z.suggest_partitions(df, {"spark.executor.instances": "2", "spark.executor.cores": "4", "spark.executor.memory": "8g"}).first()
    assert (report.core_partitions, report.memory_partitions, report.partitions) == (24, 76, 200)
    assert Z.memory_gb("512m") == 0.5 and Z.memory_gb("8GB") == 8.0 and Z.memory_gb("1t") == 1024.0
    assert Z.suggested(df) == 200 and Z.row_width(df.schema) == 8


def test_readers(spark, tmp_path):
    spark.range(3).withColumn("a", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "x"))
    folder = tmp_path / "in"
    folder.mkdir()
    part = next((tmp_path / "x").glob("*.parquet"))
    (folder / "t_1_speed.parquet").write_bytes(part.read_bytes())
    spark.range(2).withColumn("b", F.lit("z")).coalesce(1).write.parquet(str(tmp_path / "y"))
    (folder / "t_1_gear.parquet").write_bytes(next((tmp_path / "y").glob("*.parquet")).read_bytes())
    (folder / "t_2_speed.parquet").write_bytes(part.read_bytes())
    got = R.load_run(spark, str(folder), "t_1", ["VIN", "id"], VIN="v")
    assert got.columns == ["VIN", "id", "a", "b"] and got.count() == 5 and got.filter("b is null").count() == 3
    assert R.read_matching(spark, str(folder), "t_9") is None
    registry = R.registry_append(None, spark.createDataFrame([("é:R", "10")], "Signal string, Frequence string"))
    write_csv(registry, str(tmp_path / "reg"))
    assert R.records(spark, [("a", 1)], "s string, n int").count() == 1
    assert not R.table_exists(spark, "no_such_table")


def test_files_that_are_folders_of_part_files(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(4).withColumn("b", F.lit("z")).repartition(2).write.parquet(str(folder / "t_1_gear.parquet"))
    spark.range(5).write.parquet(str(folder / "t_2_gear.parquet"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "x"))
    part = next((tmp_path / "x").glob("*.parquet")).read_bytes()
    (folder / "t_1_speed.parquet").write_bytes(part)
    (folder / "c=7").mkdir()
    (folder / "c=7" / "t_1_rest.parquet").write_bytes(part)
    got = R.read_matching(spark, str(folder), "t_1")
    assert sorted(got.columns) == ["b", "c", "id"] and got.count() == 10
    assert got.filter("b = 'z'").count() == 4 and got.filter("c = 7").count() == 3
    assert R.read_matching(spark, str(folder), "t_9") is None
    with pytest.raises(AnalysisException):
        R.read_matching(spark, str(tmp_path / "nowhere"), "t_1")


def test_latin1_registry(spark, tmp_path):
    (tmp_path / "freq.csv").write_bytes("Signal;Frequence\nétat;10\n".encode("ISO-8859-1"))
    assert [tuple(r) for r in R.read_registry(spark, str(tmp_path / "freq.csv"), R.LATIN).collect()] == [("état", "10")]


def test_kpis_hot_and_cold_agree(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("s"), F.col("id").alias("t"), (F.col("id") * 7 % 101).cast("double").alias("v"))
    plain = rows(signal_kpis(df, ["s"], "v", ["t"]))
    assert rows(signal_kpis(df, ["s"], "v", ["t"], gather=10)) == plain and len(plain) == 3


def test_large_and_small_numbers_in_json(spark):
    values = [1.8e7, -2.5e8, 123456789.125, 9999999999999998.0, 1e16, 1.5e300, 1e7, 9999999.0, 0.001, 1.2345678901234567e-4, 1e-5, 1.25e-7, 2.5e-100, 0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.s for r in df.select("v", X.stats_json(F.col("v"), F.lit(None), F.lit("2e7")).alias("s")).collect()]
    assert got == [f"[{json.dumps(v)},null,20000000.0]" for v in values]
    odd = spark.createDataFrame([(float("nan"), float("-inf"))], "a double, b double")
    assert odd.select(X.stats_json(F.col("a"), F.col("b"), F.col("b")).alias("s")).first().s == '["NaN","-Infinity","-Infinity"]'
