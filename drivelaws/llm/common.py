"""What the operators share: settled tables, measured joins, batches of bounded size."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
SALTS = 64
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder: made once, not lost with an executor.

    With ``batch_bytes``, Python takes the rows in Arrow batches of at most about so much, or what the session allows if that is less.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    held = {SHUFFLE_CLEANUP: "true"}  # the shuffle files of the write are of no use after it
    if batch_bytes:
        allowed = int(spark.conf.get(ARROW_BYTES).rstrip("b"))
        held[ARROW_BYTES] = str(min(batch_bytes, allowed) if allowed > 0 else batch_bytes)
    before = {name: spark.conf.get(name, None) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    return spark.read.schema(df.schema).parquet(path)


def size_of(spark: SparkSession, settled: DataFrame) -> int:
    """Bytes of a settled table's rows, from its rows as they are in memory."""
    width = F.lit(0)
    for field in settled.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        width = width + (F.coalesce(F.octet_length(c), F.lit(0)) + 32 if kind in ("string", "binary") else F.lit(24))
    return settled.agg(F.sum(width.cast("long"))).first()[0] or 0


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the right keys are dropped."""
    hidden = {k: f"__right_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(hidden)
    condition = None
    for k, h in hidden.items():
        same = left[f"`{k}`"].eqNullSafe(other[h])
        condition = same if condition is None else condition & same
    return left.join(other, condition, how).drop(*hidden.values())


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join with a settled table of one row per group.

    Broadcast when its measured size is within ``BROADCAST_BYTES``. Otherwise every group is copied
    to ``SALTS`` salts and the rows take turns, so that a hot group spreads over as many tasks.
    """
    if size_of(rows.sparkSession, groups) <= BROADCAST_BYTES:
        return null_safe_join(rows, F.broadcast(groups), keys)
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return null_safe_join(rows.withColumn("__salt", turn), copies, [*keys, "__salt"]).drop("__salt")


def unclashed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names that clash with none of an operator's own, and what each column is called there."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def text_of(column: Column | str = "text") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def text_key(column: Column | str = "text") -> list[Column]:
    """128 bits that stand for a text, in two longs."""
    text = text_of(column)
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def bounded(batches: Iterable[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most`` bytes; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        yield batch.slice(first)


def worker_state(name: str, make: Callable[[], object]):
    """An object that outlives the task in a reused Python worker, such as a loaded tokenizer."""
    home = sys.modules.setdefault("drivelaws_worker_state", types.ModuleType("drivelaws_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def crowded_cells(rows: DataFrame, cell: str, most: int) -> DataFrame | None:
    """``(cell, blocks)`` of the cells with more than ``most`` rows, settled; none if there are none."""
    counts = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    crowd = settle(counts.select(cell, F.ceil(F.col("n") / F.lit(most)).cast("int").alias("blocks")))
    return None if crowd.isEmpty() else crowd


def with_blocks(rows: DataFrame, crowd: DataFrame, cell: str) -> DataFrame:
    """The rows with the number of blocks of their cell (1 if it is not crowded)."""
    small = size_of(rows.sparkSession, crowd) <= BROADCAST_BYTES
    return rows.join(F.broadcast(crowd) if small else crowd, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def block_of(*columns: str) -> Column:
    """A block below ``blocks``, dealt by the columns."""
    return F.pmod(F.xxhash64(*columns), F.col("blocks").cast("long")).cast("int")


def in_groups(batches: Iterable[pa.RecordBatch], group: str, least: int = 10_000) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole groups, of ``least`` rows or more but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(group).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(group)[-1].as_py() != keys[0]:
            change = np.append(0, change)
        full = sum(b.num_rows for b in held)
        if len(change) and full + change[-1] >= least:
            yield pa.Table.from_batches([*held, batch.slice(0, change[-1])])
            held, batch = [], batch.slice(change[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
