"""Maximum likelihood where it needs iterated sums over the data (Weibull, Gumbel).

A fixed number of cells per criterion summarises the sample; a few numpy steps on those cells give
a start close to the optimum, and exact Newton passes over the data finish it: two as a rule, more
where the last step was not small. A step stays within a third and three times the value, and what
has not settled after the last pass has no estimate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import attach, null_safe, settle, within

CELLS = 1024
# A pass is the last one if its steps, relative to the value, are at most this; and passes at most.
RESIDUAL, MOST_PASSES = 1e-7, 12


def cell_of(value: Column, low: Column, high: Column) -> Column:
    scaled = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    return F.least(F.floor(scaled * CELLS), F.lit(CELLS - 1))


@F.pandas_udf(T.DoubleType())
def _gumbel_start(sizes: pd.Series, means: pd.Series) -> pd.Series:
    out = []
    for size, z in zip(sizes, means):
        w, z = np.asarray(size, float), np.asarray(z, float)
        mean = np.average(z, weights=w)
        beta = np.sqrt(np.average((z - mean) ** 2, weights=w)) * np.sqrt(6) / np.pi
        for _ in range(50 if beta > 0 else 0):
            e = w * np.exp(-z / beta)
            tilted = np.sum(e * z) / np.sum(e)
            spread = np.sum(e * (z - tilted) ** 2) / np.sum(e)
            step = (beta - mean + tilted) / (1.0 + spread / beta**2)
            beta = max(beta - step, beta / 3)
            if abs(step) <= 1e-14 * beta:
                break
        out.append(beta)
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.DoubleType())
def _weibull_start(sizes: pd.Series, means: pd.Series) -> pd.Series:
    """Shape from cells of ln(y), y scaled to at most 1."""
    out = []
    for size, ln_y in zip(sizes, means):
        w, ln_y = np.asarray(size, float), np.asarray(ln_y, float)
        mean = np.average(ln_y, weights=w)
        sd = np.sqrt(np.average((ln_y - mean) ** 2, weights=w))
        c = np.pi / np.sqrt(6) / sd if sd > 0 else np.nan
        for _ in range(50 if sd > 0 else 0):
            e = w * np.exp(c * ln_y)
            tilted = np.sum(e * ln_y) / np.sum(e)
            spread = np.sum(e * (ln_y - tilted) ** 2) / np.sum(e)
            step = (tilted - 1.0 / c - mean) / (spread + 1.0 / c**2)
            c = max(c - step, c / 3)
            if abs(step) <= 1e-14 * c:
                break
        out.append(c)
    return pd.Series(out, dtype=float)


def _cells(rows: DataFrame) -> DataFrame:
    """``(criteria, sizes, means)`` of the values ``v`` over equal cells of ``[v_low, v_high]``."""
    place = cell_of(F.col("v"), F.col("v_low"), F.col("v_high"))
    cells = rows.groupBy("criteria", place.alias("cell")).agg(
        F.count(F.lit(1)).cast("double").alias("size"), F.avg("v").alias("mean"))
    # bounded: at most CELLS entries per criterion
    listed = F.array_sort(F.collect_list(F.struct("cell", "size", "mean")))
    return cells.groupBy("criteria").agg(listed.alias("c")).select(
        "criteria", F.col("c.size").alias("sizes"), F.col("c.mean").alias("means"))


def _tilted_sums(rows: DataFrame, weight: Column, by: list[str]) -> DataFrame:
    """Sums of w, w v and w v² of the values ``v``."""
    v = F.col("v")
    return rows.select(*by, "v", weight.alias("w")).groupBy(*by).agg(
        F.sum("w").alias("s0"), F.sum(F.col("w") * v).alias("s1"), F.sum(F.col("w") * v * v).alias("s2"))


def _solved(values, spread: DataFrame, fit: DataFrame, name: str, weight: Column, step: Column, ln_slope: Column) -> DataFrame:
    """``spread`` with the root ``name``, the log of the sum of weights there, and the relative last step as ``residual``.

    ``fit`` is settled and has the start, with columns that the step needs besides the sums s0, s1 and s2.
    """
    root, carried = F.col(name), [c for c in fit.columns if c != "criteria"]
    for _ in range(MOST_PASSES):
        groups = settle(null_safe(spread, fit.select("criteria", *carried), ["criteria"]))
        sums = _tilted_sums(values(groups), weight, [*groups.columns])
        moved = F.least(F.greatest(root - step, root / 3.0), root * 3.0)
        # ln of the sum moves with its own derivative, so no further pass is needed
        fit = settle(sums.withColumn("moved", moved).select(
            *(c for c in groups.columns if c != name), (F.ln("s0") + ln_slope * (F.col("moved") - root)).alias("ln_sum"),
            F.abs(F.col("moved") / root - 1.0).alias("residual"), F.col("moved").alias(name)))
        # a start that is null or NaN stays so: it has no root that further passes could find
        if fit.filter((F.col("residual") > RESIDUAL) & ~F.isnan("residual")).isEmpty():
            break
    return fit.filter(F.col("residual") <= RESIDUAL)


def gumbel_mle(sample: DataFrame, summary: DataFrame) -> DataFrame:
    """``(criteria, loc, scale, loglik, residual)``; ``summary`` is settled with n, data_min, data_max, data_mean."""
    spread = summary.filter("data_max > data_min").select("criteria", "n", "data_min", "data_max", "data_mean")
    bounds = within(summary, spread.select("criteria", "data_min", (F.col("data_max") - F.col("data_min")).alias("v_high")))

    def values(groups: DataFrame) -> DataFrame:
        return attach(sample, groups, ["criteria"]).withColumn("v", F.col("x") - F.col("data_min"))

    cells = _cells(values(bounds).withColumn("v_low", F.lit(0.0)))
    start = settle(cells.select("criteria", _gumbel_start("sizes", "means").alias("b")))
    mean = F.col("data_mean") - F.col("data_min")
    b, s0, s1, s2 = (F.col(c) for c in ("b", "s0", "s1", "s2"))
    tilted = s1 / s0
    step = (b - mean + tilted) / (F.lit(1.0) + (s2 / s0 - tilted * tilted) / (b * b))
    fit = _solved(values, spread, start, "b", F.exp(-F.col("v") / b), step, tilted / (b * b))
    n = F.col("n").cast("double")
    shift = -b * (F.col("ln_sum") - F.ln(n))
    return fit.select(
        "criteria", (F.col("data_min") + shift).alias("loc"), b.alias("scale"),
        (-n * F.ln(b) - n * (mean - shift) / b - n).alias("loglik"), "residual",
    )


def weibull_mle(sample: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(criteria, beta_shape, lambda_scale, residual)`` with location ``shift``.

    ``bounds`` is settled: criteria, n, data_min, data_max, shift with data_min > shift.
    """
    usable = within(bounds, bounds.filter("data_max > data_min"))
    top = F.col("data_max") - F.col("shift")

    def values(groups: DataFrame) -> DataFrame:
        return attach(sample, groups, ["criteria"]).withColumn("v", F.ln((F.col("x") - F.col("shift")) / top))

    ends = F.ln((F.col("data_min") - F.col("shift")) / top)
    cells = _cells(values(usable).withColumn("v_low", ends).withColumn("v_high", F.lit(0.0)))
    means = values(usable).groupBy("criteria").agg(F.avg("v").alias("mean_ln"))
    start = settle(null_safe(cells.select("criteria", _weibull_start("sizes", "means").alias("c")), means, ["criteria"]))
    spread = usable.select("criteria", "n", "data_min", "data_max", "shift")
    c, s0, s1, s2 = (F.col(name) for name in ("c", "s0", "s1", "s2"))
    tilted = s1 / s0
    step = (tilted - F.lit(1.0) / c - F.col("mean_ln")) / ((s2 / s0 - tilted * tilted) + F.lit(1.0) / (c * c))
    fit = _solved(values, spread, start, "c", F.exp(c * F.col("v")), step, tilted)
    scale = top * F.exp((F.col("ln_sum") - F.ln(F.col("n").cast("double"))) / c)
    return fit.select("criteria", c.alias("beta_shape"), scale.alias("lambda_scale"), "residual")
