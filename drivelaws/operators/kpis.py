"""Key figures of each signal of each trip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import elapsed
from .sample import GATHER, percentiles
from .scale import null_safe, settle

# Percentiles reported per signal.
KPI_PERCENTILES = {"P1": 0.01, "P10": 0.1, "P25": 0.25, "P50": 0.5, "P75": 0.75, "P90": 0.9, "P99": 0.99}


def signal_kpis(df: DataFrame, by: Sequence[str], value: str, order_by: Sequence[str],
                gather: int = GATHER, carry: Sequence[str] = ()) -> DataFrame:
    """DUREE, COUNT, MEAN, STD, MIN, MAX, FIRST, LAST and percentiles per group.

    ``order_by`` starts with the time column and decides first and last. Values that are null or
    NaN are left out; STD is the sample one. ``carry`` are columns that say the same in all rows of a
    group and go along (the smallest value, should they not).
    """
    x = F.col(f"`{value}`").cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x)).select(
        *(f"`{k}`" for k in [*by, *carry]), x.alias("__x"), *(F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order_by)))
    when = F.struct(*(f"__o{i}" for i in range(len(order_by))))
    base = settle(rows.groupBy(*by).agg(
        F.min("__o0").alias("__start"), F.max("__o0").alias("__end"),
        F.count("__x").alias("COUNT"), F.avg("__x").alias("MEAN"), F.stddev_samp("__x").alias("STD"),
        F.min("__x").alias("MIN"), F.max("__x").alias("MAX"),
        *(F.min(f"`{c}`").alias(c) for c in carry), F.min_by("__x", when).alias("FIRST"), F.max_by("__x", when).alias("LAST"),
    ))
    sizes = base.select(*by, F.col("COUNT").alias("n"), F.col("MIN").alias("lo"), F.col("MAX").alias("hi"))
    pct = percentiles(rows, list(KPI_PERCENTILES.values()), by=by, value="__x", gather=gather, sizes=sizes)
    return null_safe(base, pct, list(by)).select(
        *(f"`{k}`" for k in [*by, *carry]),
        elapsed(df.schema[order_by[0]].dataType, "__start", "__end").alias("DUREE"),
        "COUNT", "MEAN", "STD", "MIN", "MAX", "FIRST", "LAST",
        *(F.col("pct")[i].alias(name) for i, name in enumerate(KPI_PERCENTILES)),
    )


def distinct_on(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or one row per key: the smallest of its rows, so the pick is repeatable."""
    if keys is None:
        return df.distinct()
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*(f"`{c}`" for c in rest))
    return df.groupBy(*(f"`{k}`" for k in keys)).agg(F.min(row).alias("__row")).select(
        *(F.col(f"`{c}`") if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns))


def dimension_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("Dimension").count()
