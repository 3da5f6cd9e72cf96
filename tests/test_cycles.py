from drivelaws.operators.merge import fold_sources, merge_cycle_sources
from drivelaws.sources.read import read_cycles

SCHEMA = "cycle string, t int, source string, a int, b int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_columns_come_from_the_first_source_that_has_them(spark):
    """A null in the first source that has a column stays; rows that only later sources have fall away."""
    df = spark.createDataFrame([
        ("x", 1, "f1", 10, None), ("x", 2, "f1", None, None), ("x", 1, "f2", 11, 5), ("x", 2, "f2", 12, None), ("x", 3, "f2", 13, 7),
        ("y", 1, "f2", 20, 6), (None, 1, "f1", None, 8)], SCHEMA)
    assert rows_of(fold_sources(df, "cycle", ["cycle", "t"], "source").select("cycle", "t", "a", "b")) == sorted(
        [("x", 1, 10, 5), ("x", 2, None, None), ("y", 1, 20, 6), (None, 1, None, 8)], key=str)


def test_stored_cycles_lead_or_follow(spark):
    files = spark.createDataFrame([("x", 1, "x_1", 1, None), ("x", 2, "x_1", 2, None), ("y", 1, "y_1", 3, None)], SCHEMA)
    stored = spark.createDataFrame([("x", 1, 9, 4), ("x", 5, 9, 4), ("z", 1, 9, 4)], "cycle string, t int, a int, b int")
    keys = ["cycle", "t"]
    over = merge_cycle_sources(files, stored, "cycle", keys, True).select("cycle", "t", "a", "b")
    assert rows_of(over) == [("x", 1, 1, 4), ("x", 2, 2, None), ("y", 1, 3, None)]
    kept = merge_cycle_sources(files, stored, "cycle", keys).select("cycle", "t", "a", "b")
    assert rows_of(kept) == [("x", 1, 9, 4), ("x", 5, 9, 4), ("y", 1, 3, None)]
    empty = merge_cycle_sources(files.limit(0), stored, "cycle", keys)
    assert empty.isEmpty()


def test_files_are_found_by_the_cycle_in_their_name(spark, tmp_path):
    folder = tmp_path / "a folder+1"
    folder.mkdir()
    assert read_cycles(spark, str(folder), "cycle") is None
    for name, cycle in (("x y_1.parquet", "x y"), ("x y.parquet", "x y"), ("other_1.parquet", "x y"), ("run_z_2.parquet", "z")):
        spark.createDataFrame([(cycle, 1)], "cycle string, t int").write.parquet(str(folder / name))
    found = read_cycles(spark, str(folder), "cycle")
    assert rows_of(found.select("cycle", "source")) == [("x y", "x y_1.parquet"), ("z", "run_z_2.parquet")]
