import pytest
from pyspark.sql import functions as F

from drivelaws.operators import sizing as Z


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sizes_of_files_read_no_column(spark, tmp_path):
    path = tmp_path / "rows"
    spark.range(5000).select("id", F.col("id").cast("string").alias("s")).repartition(3).write.partitionBy().parquet(str(path))
    on_disk = sum(f.stat().st_size for f in path.glob("*.parquet"))
    df = spark.read.parquet(str(path))
    size = Z.data_size(df)
    assert size.first().asDict() == {"rows": 5000, "bytes": on_disk}
    assert "ReadSchema: struct<>" in plan(size)
    assert Z.data_size(df.filter("id < 0")).first().asDict() == {"rows": 0, "bytes": 0}
    report = Z.suggest_partitions(df.select("s"), {"spark.executor.instances": "10"}).first()
    assert (report.rows, report.bytes, report.partitions) == (5000, on_disk, 200)


def test_frames_that_are_read_from_no_files(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert Z.file_size(df) is None
    assert Z.data_size(df).first().asDict() == {"rows": 2, "bytes": 2 * (8 + 50)}
    assert Z.data_size(df, by="text").first().bytes == len('{"i":1,"s":"a"}') + len('{"i":2,"s":null}')
    grouped = df.groupBy("s").count()
    assert Z.data_size(grouped).first().rows == 2
    with pytest.raises(ValueError):
        Z.data_size(df, by="files")
    with pytest.raises(ValueError):
        Z.data_size(df, by="pages")
