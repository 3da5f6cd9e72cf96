"""Number of shuffle partitions from data size and cluster."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .projections import quoted

# Target partition size, share of memory to use, tasks per core, bounds, and the
# cluster assumed where the session does not say.
TARGET_MB = 128
MEMORY_SHARE = 0.6
TASKS_PER_CORE = 3
BOUNDS = (200, 10_000)
ASSUMED = {"executors": "2", "cores": "4", "memory": "8g"}
NUMBER_BYTES, OTHER_BYTES = 8, 50
NUMBERS = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType)


def row_width(schema: T.StructType) -> int:
    """Assumed bytes per row, when the text of the rows is not measured."""
    return sum(NUMBER_BYTES if isinstance(f.dataType, NUMBERS) else OTHER_BYTES for f in schema.fields)


def file_size(df: DataFrame) -> DataFrame | None:
    """``(rows, bytes)`` of the files a frame is read from, by the scan's file metadata; None if it is read from none.

    No column is read. A filtered frame counts its own rows and the whole files that hold any of them.
    """
    try:
        files = df.select("_metadata.file_path", "_metadata.file_size")
    except AnalysisException as error:
        if error.getCondition() and error.getCondition().startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND", "INVALID_EXTRACT")):
            return None
        raise
    each = files.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.max("file_size").alias("size"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def data_size(df: DataFrame, by: str | None = None) -> DataFrame:
    """One row ``(rows, bytes)``.

    Bytes are those of the ``files`` read, UTF-8 bytes of the rows as ``text``, nulls included, or rows times the
    assumed ``width``. Unless told, files where the frame is read from files, else the assumed width: only ``text`` reads
    the columns.
    """
    if by not in (None, "files", "text", "width"):
        raise ValueError(f"unknown measure {by!r}, expected files, text or width")
    if by == "text":
        text = F.octet_length(F.to_json(F.struct(*quoted(df.columns)), {"ignoreNullFields": "false"}))
        return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes"))
    files = None if by == "width" else file_size(df)
    if files is not None:
        return files
    if by == "files":
        raise ValueError("the frame is not read from files")
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("bytes", F.col("rows") * F.lit(row_width(df.schema)))


def memory_gb(text: str) -> float:
    text = text.strip().lower()
    number = float(text.rstrip("bkmgt") or 0)
    unit = text.rstrip("b")[-1:]
    return number * {"t": 1024.0, "m": 1 / 1024, "k": 1 / 1024 ** 2}.get(unit, 1.0)


def cluster(df: DataFrame, conf: dict[str, str] | None = None) -> dict[str, float]:
    known = df.sparkSession.sparkContext.getConf()

    def setting(name: str, default: str) -> str:
        return (conf or {}).get(name) or known.get(name, default)

    executors = setting("spark.executor.instances", setting("spark.dynamicAllocation.maxExecutors", ASSUMED["executors"]))
    cores = setting("spark.executor.cores", ASSUMED["cores"])
    memory = memory_gb(setting("spark.executor.memory", ASSUMED["memory"]))
    return {"executors": int(executors), "cores": int(executors) * int(cores), "memory_gb": int(executors) * memory}


def suggest_partitions(df: DataFrame, conf: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """One-row report: what the data asks for, what cores and memory allow, and the suggestion."""
    have = cluster(df, conf)
    by_cores = have["cores"] * TASKS_PER_CORE
    by_memory = int(have["memory_gb"] * 1024 * MEMORY_SHARE / TARGET_MB)
    size = data_size(df, by).withColumn("size_gb", F.col("bytes") / F.lit(float(1024 ** 3)))
    by_data = F.floor(F.col("size_gb") * F.lit(1024.0) / F.lit(float(TARGET_MB))).cast("int")
    wanted = F.least(F.greatest(F.col("data_partitions"), F.lit(by_cores)), F.lit(by_memory))
    low, high = BOUNDS
    return size.select(
        "rows", "bytes", "size_gb",
        F.lit(have["executors"]).alias("executors"), F.lit(have["cores"]).alias("total_cores"),
        F.lit(float(have["memory_gb"])).alias("total_memory_gb"),
        by_data.alias("data_partitions"), F.lit(by_cores).alias("core_partitions"),
        F.lit(by_memory).alias("memory_partitions"),
    ).withColumn("partitions", F.greatest(F.lit(low), F.least(wanted, F.lit(high))))


def suggested(df: DataFrame, conf: dict[str, str] | None = None) -> int:
    return suggest_partitions(df, conf).first().partitions
