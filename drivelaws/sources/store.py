"""Catalog tables and file sinks.

Tables are partitioned parquet. A rewrite touches only the partitions that hold affected rows: the
merged rows are first cut from their lineage, then overwrite those partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projections import quoted
from ..operators.scale import null_safe, settle
from .read import ENCODING, registry_append


# Touched partitions up to this many become literal filters; beyond, a join finds their rows.
MOST_LITERALS = 2000


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows on reliable storage, independent of the tables they were read from."""
    return settle(df)


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = ENCODING) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True, encoding=encoding)


def extend_registry(new: DataFrame, path: str, encoding: str = ENCODING) -> None:
    """Add signals to a registry, which is made where there is none yet."""
    registry_append(None, new).write.mode("append").csv(path, sep=";", header=True, encoding=encoding)


def write_parquet(df: DataFrame, path: str) -> None:
    """Overwrite a path other than the ones ``df`` reads."""
    df.write.mode("overwrite").parquet(path)


class Store:
    def __init__(self, spark: SparkSession, format: str = "parquet"):
        self.spark = spark
        self.format = format

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table)

    def read(self, table: str) -> DataFrame:
        return self.spark.table(table)

    def partition_columns(self, table: str) -> list[str]:
        return [c.name for c in self.spark.catalog.listColumns(table) if c.isPartition]

    def create(self, df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
        """New table; rows are gathered by partition first, so each has few files. The rebalance
        splits a large partition over as many tasks as its measured size asks for."""
        parts = list(partition_by)
        if parts:
            df = df.hint("rebalance", *(F.col(q) for q in quoted(parts)))
        df.write.format(self.format).partitionBy(*parts).mode("overwrite").saveAsTable(table)

    def _aligned(self, df: DataFrame, table: str) -> DataFrame:
        """Rows in the table's column order; columns it lacks are added to it, null so far."""
        stored = self.read(table).columns
        added = [f for f in df.schema.fields if f.name not in stored]
        if added:
            listed = ", ".join(f"{q} {f.dataType.simpleString()}" for q, f in zip(quoted([f.name for f in added]), added))
            self.spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({listed})")
        schema = self.spark.table(table).schema
        return df.select(*(
            (F.col(quoted([f.name])[0]) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields))

    def _insert_over(self, rows: DataFrame, table: str, mode: str) -> None:
        """Overwrite all of a table (static) or the partitions of the rows (dynamic)."""
        name = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, mode)  # inserts into a table follow the session, not the writer
        try:
            rows.select(*quoted(self.read(table).columns)).write.insertInto(table, overwrite=True)
        finally:
            self.spark.conf.set(name, before)

    def append(self, df: DataFrame, table: str) -> None:
        self._aligned(df, table).write.insertInto(table)

    def overwrite(self, df: DataFrame, table: str) -> None:
        """Replace all rows; ``df`` may derive from the table."""
        if not self.exists(table):
            self.create(df, table)
            return
        self._insert_over(cut_lineage(self._aligned(df, table)), table, "static")

    def replace_slice(self, df: DataFrame, table: str, keys: Sequence[str], taken: DataFrame | None = None) -> None:
        """Replace the rows whose key is in ``df``, or in ``taken`` where given, rewriting only the partitions concerned."""
        new = cut_lineage(self._aligned(df, table))
        gone = cut_lineage((new if taken is None else taken).select(*quoted(keys)).distinct())

        def replaced(old: DataFrame) -> DataFrame:
            return old.join(gone, list(keys), "left_anti").unionByName(new)

        self._rewrite(table, keys, gone, new, replaced)

    def merge_slice(self, df: DataFrame, table: str, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Merge ``df`` into the stored rows of its partitions; a key must not move between partitions.

        ``merge(old, new)`` gives the rows that replace those partitions, new columns included.
        """
        new = cut_lineage(df)
        parts = self.partition_columns(table)
        if not all(p in new.columns for p in parts):
            raise ValueError(f"rows to merge need the partition columns {parts}")
        stored = self.read(table)
        self._aligned(new.limit(0), table)  # columns the table lacks

        def merged(old: DataFrame) -> DataFrame:
            return merge(old.select(*quoted(stored.columns)), new)

        self._rewrite(table, keys, cut_lineage(new.select(*quoted(keys)).distinct()), new, merged)

    def affected(self, table: str, keys: Sequence[str], gone: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stored rows of the partitions that hold a key of ``gone`` or take rows of ``new``, and those partitions.

        The partitions become literal filters, so no other folder is opened. Where the keys name them,
        none is opened even to find them.
        """
        parts, old = self.partition_columns(table), self.read(table)
        touched = new.select(*quoted(parts))
        if set(parts) <= set(keys):
            touched = touched.unionByName(gone.select(*quoted(parts)))
        else:
            touched = touched.unionByName(old.join(gone, list(keys), "left_semi").select(*quoted(parts)))
        touched = settle(touched.distinct())
        known = touched.limit(MOST_LITERALS + 1).collect()
        if len(known) > MOST_LITERALS:
            return null_safe(old, touched, parts, "left_semi"), touched
        return old.filter(_any_of(parts, known)), touched

    def _rewrite(self, table: str, keys: Sequence[str], gone: DataFrame, new: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        parts = self.partition_columns(table)
        if not parts:
            self._insert_over(cut_lineage(self._aligned(change(self.read(table)), table)), table, "static")
            return
        old, touched = self.affected(table, keys, gone, new)
        rows = cut_lineage(self._aligned(change(old), table))
        self._insert_over(rows, table, "dynamic")
        # partitions left without rows are not overwritten; there are at most as many as touched
        emptied = null_safe(touched, rows.select(*quoted(parts)).distinct(), parts, "left_anti")
        specs = [", ".join(f"{q} = {_literal(row[p])}" for p, q in zip(parts, quoted(parts))) for row in emptied.toLocalIterator()]
        if specs:
            self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION ({s})" for s in specs))


def _any_of(parts: Sequence[str], rows: Sequence) -> Column:
    """The partitions of the rows as one predicate on partition columns; false if there are none."""
    found = F.lit(False)
    for row in rows:
        each = F.lit(True)
        for p, q in zip(parts, quoted(parts)):
            each = each & (F.col(q).isNull() if row[p] is None else F.col(q) == F.lit(row[p]))
        found = found | each
    return found


def _literal(value) -> str:
    if value is None:
        return "null"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "\\'") + "'"
