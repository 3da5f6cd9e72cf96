"""How the operators stay whole and balanced at size.

``settle``  makes a small table once, on reliable storage, so later passes over the data neither
            recompute it nor lose it with an executor.
``attach``  brings a per-group table to every row: broadcast when its measured size is small,
            otherwise a join salted so that one hot group spreads over many tasks.
``running`` running totals per group, in chunks, so no group is ordered in a single task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; a temporary one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _width(df: DataFrame) -> Column:
    """Bytes of a row."""
    width = F.lit(0)
    for field in df.schema.fields:
        c, kind = F.col("`" + field.name.replace("`", "``") + "`"), field.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind in ("array", "map", "struct"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            width = width + 16
    return width.cast("long")


def settle(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, computed once; its bytes are measured in the same job."""
    spark = df.sparkSession
    path, seen = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).write.parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_bytes = seen.get["bytes"]
    return settled


def within(settled: DataFrame, derived: DataFrame) -> DataFrame:
    """``derived``, known to hold at most the rows of a settled table, with as many columns or fewer."""
    derived.settled_bytes = bytes_of(settled)
    return derived


def bytes_of(settled: DataFrame) -> int:
    """Bytes of a settled table's rows, measured, not guessed."""
    known = vars(settled).get("settled_bytes")
    return (settled.agg(F.sum(_width(settled))).first()[0] or 0) if known is None else known


def is_small(settled: DataFrame) -> bool:
    return bytes_of(settled) <= BROADCAST_BYTES


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key; the right keys are dropped."""
    hidden = {k: f"__{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(hidden)
    condition = None
    for k, h in hidden.items():
        same = left[f"`{k}`"].eqNullSafe(other[h])
        condition = same if condition is None else condition & same
    return left.join(other, condition, how).drop(*hidden.values())


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of the data with a settled table that has one row per group.

    Broadcast when its measured size is small. Otherwise the rows take turns at ``SALTS`` copies of
    their group, by their place and not by their content, so equal rows spread as well.
    """
    if is_small(groups):
        return null_safe(rows, F.broadcast(groups), keys)
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return null_safe(rows.withColumn("__salt", turn), copies, [*keys, "__salt"]).drop("__salt")


def running(df: DataFrame, by: Sequence[str], chunk: str, order_by: Sequence[str],
            sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Add, per group, running sums and maxima over the rows strictly before each row.

    ``chunk`` is a column that cuts a group into ordered pieces of bounded size. Only one total per
    piece meets its neighbours in a window over the group; rows are ordered within their piece.
    Sums start at 0, maxima at null.
    """
    sums, maxima = sums or {}, maxima or {}
    # one struct key is never null, so plain equi-joins keep the windows' partitioning
    df = df.withColumn("__key", F.struct(*(F.col(f"`{k}`") for k in by)) if by else F.struct(F.lit(0)))
    pieces = ["__key", chunk]
    totals = df.groupBy(*pieces).agg(
        *(F.sum(e).alias(f"__{n}") for n, e in sums.items()),
        *(F.max(e).alias(f"__{n}") for n, e in maxima.items()),
    )
    earlier = Window.partitionBy("__key").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *pieces,
        *(F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums),
        *(F.max(f"__{n}").over(earlier).alias(f"__{n}") for n in maxima),
    )
    within = Window.partitionBy(*pieces).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*",
        *(F.coalesce(F.sum(e).over(within), F.lit(0)).alias(n) for n, e in sums.items()),
        *(F.max(e).over(within).alias(n) for n, e in maxima.items()),
    )
    joined = local.join(offsets, pieces)
    for n in sums:
        joined = joined.withColumn(n, F.col(n) + F.col(f"__{n}"))
    for n in maxima:
        joined = joined.withColumn(n, F.greatest(n, f"__{n}"))
    return joined.select(*(f"`{c}`" for c in df.columns if c != "__key"), *sums, *maxima)
