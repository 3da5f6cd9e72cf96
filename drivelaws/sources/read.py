"""Readers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.projections import add_constants, keys_first, slice_eq

# One encoding for text files written and read.
ENCODING, LATIN = "UTF-8", "ISO-8859-1"
REGISTRY_SCHEMA = T.StructType([T.StructField("Signal", T.StringType()), T.StructField("Frequence", T.StringType())])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_matching(spark: SparkSession, folder: str, token: str) -> DataFrame | None:
    """All parquet files of a folder whose name holds the token, as one scan; None if there are none.

    A file may also be a folder of part files, known by its own name, and files may lie in partitions of the folder.
    Columns are united by name: a file without one gives nulls.
    """
    pattern = "*" + "".join(f"[{c}]" if c in "*?[{" else c for c in token) + "*.parquet"

    def found(read: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            return read()
        except AnalysisException as error:
            if error.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                return None
            raise

    base = folder.rstrip("/")
    named = found(lambda: spark.read.option("mergeSchema", "true").parquet(f"{base}/{pattern}"))
    parts = found(lambda: spark.read.option("mergeSchema", "true").option("basePath", folder).option("pathGlobFilter", pattern).parquet(f"{base}/*=*"))
    scans = [scan for scan in (named, parts) if scan is not None]
    if not scans:  # an error if there is no such folder
        spark.read.schema("none int").option("recursiveFileLookup", "true").parquet(folder)
    return union_evolving(scans) if scans else None


def read_cycles(spark: SparkSession, folder: str, cycle: str, source: str = "source") -> DataFrame | None:
    """All files of a folder that are named for the cycle of their rows, as one scan; None if the folder has no files.

    Names hold the cycle and an underscore; a file may also be a folder of part files. ``source`` is the name.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "true")
    try:
        rows = reader.parquet(folder)
    except AnalysisException as error:
        if "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    named = rows.select("*", F.regexp_extract(path, r"([^/]*\.parquet)(/[^/]*)?$", 1).alias(source))
    return named.filter(F.contains(F.col(source), F.concat(F.col(f"`{cycle}`").cast("string"), F.lit("_"))))


def load_run(spark: SparkSession, folder: str, token: str, keys: Sequence[str], **constants) -> DataFrame | None:
    """The files of one run with their constant ids, keys first."""
    files = read_matching(spark, folder, token)
    return None if files is None else keys_first(add_constants(files, **constants), keys)


def union_evolving(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def read_slice(spark: SparkSession, table: str, **equals) -> DataFrame:
    """Rows of a table equal to the given values; partition columns prune its files."""
    return slice_eq(spark.table(table), **equals)


def records(spark: SparkSession, rows: Sequence[dict | tuple], schema: T.StructType | str) -> DataFrame:
    """A few records of the caller as a table, always by an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def read_registry(spark: SparkSession, path: str, encoding: str = ENCODING) -> DataFrame:
    """The ``;``-separated signal-frequency registry; files from before may need ``LATIN``."""
    return spark.read.csv(path, sep=";", encoding=encoding, header=True, schema=REGISTRY_SCHEMA)


def registry_append(registry: DataFrame | None, new: DataFrame) -> DataFrame:
    entries = new.select(F.col("Signal").cast("string").alias("Signal"), F.col("Frequence").cast("string").alias("Frequence"))
    return entries if registry is None else registry.unionByName(entries)
