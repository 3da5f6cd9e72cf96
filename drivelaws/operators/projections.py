"""Column and row selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stored names of the fitted and empirical customers.
CLIENT_NAMES = {
    "percentile_1%": "client1%", "percentile_50%": "client50%", "percentile_99%": "client99%",
    "percentile_1%_emp": "sample_client1%", "percentile_50%_emp": "sample_client50%",
    "percentile_99%_emp": "sample_client99%",
}


def quoted(names: Sequence[str]) -> list[str]:
    """Column names safe to select: they may hold dots, colons and percent signs."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def add_constants(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def keys_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in their order, then the other columns by name."""
    return df.select(*quoted([*keys, *sorted(c for c in df.columns if c not in keys)]))


def cast_by_name(df: DataFrame, pattern: str = ":", type: str = "double") -> DataFrame:
    """Cast every column whose name holds the pattern."""
    return df.select(*(
        F.col(q).cast(type).alias(name) if pattern in name else F.col(q)
        for name, q in zip(df.columns, quoted(df.columns))))


def drop_common(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``right`` without the non-key columns that ``left`` has."""
    return right.select(*quoted([c for c in right.columns if c in keys or c not in left.columns]))


def rename_clients(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(CLIENT_NAMES)


def keep_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*quoted([c for c in cols if c in df.columns]))


def slice_eq(df: DataFrame, **equals) -> DataFrame:
    """Rows equal to the given values; reaches the scan as pushed filters."""
    for name, value in equals.items():
        df = df.filter(F.col(quoted([name])[0]) == F.lit(value))
    return df


def not_in(df: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the new ones."""
    return df.join(new.select(*quoted(keys)), list(keys), "left_anti")


def first_model_row(models: DataFrame, criteria: str | None = None) -> DataFrame:
    """One row per criterion: the best one where marked, else the lowest class count; ties go to the smallest row."""
    if criteria is not None:
        models = models.filter(F.col("criteria") == criteria)
    best = (~F.coalesce("is_best", F.lit(False))) if "is_best" in models.columns else F.lit(False)
    # maps have no order; as text they do
    plain = [F.to_json(q) if f.dataType.typeName() == "map" else F.col(q) for q, f in zip(quoted(models.columns), models.schema)]
    order = F.struct(best, F.col("class_index"), *(c.alias(f"c{i}") for i, c in enumerate(plain)))
    row = F.struct(*quoted(models.columns))
    picked = models.groupBy("criteria").agg(F.min_by(row, order).alias("__row"))
    return picked.select(*(F.col("__row").getField(c).alias(c) for c in models.columns))
