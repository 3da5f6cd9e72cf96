"""Direct estimates of the six laws, used when no class regression is good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.laws import law_params, quantiles
from ..functions.scalars import minmax_clip
from .classes import DIFF_COLUMNS, EMP_COLUMNS, FIT_COLUMNS, MODEL_COLUMNS, beta_mle, grid_marks
from .likelihood import weibull_mle
from .sample import CUSTOMER_PS, GATHER, percentiles, sizes_of
from .scale import attach, null_safe, settle

SHIFT_MARGIN = 1e-6


def _stats(sample: DataFrame, d: float) -> DataFrame:
    """Moments per criterion, with the location that keeps every value above it."""
    stats = sample.groupBy("criteria").agg(
        F.count("x").alias("n"), F.min("x").alias("data_min"), F.max("x").alias("data_max"),
        F.avg("x").alias("data_mean"), F.stddev_pop("x").alias("std_pop"),
        F.stddev_samp("x").alias("std"), F.var_samp("x").alias("var"),
    )
    low = F.col("data_min")
    shift = F.when(low - F.lit(float(d)) <= 0.0, low - F.lit(SHIFT_MARGIN)).otherwise(F.lit(float(d)))
    return settle(stats.withColumn("shift", shift))


def _beta_fit(sample: DataFrame, stats: DataFrame) -> DataFrame:
    """Moments on the scaled, clipped sample; likelihood where they do not belong to a beta law."""
    bounds = stats.filter("data_max > data_min").select("criteria", "data_min", "data_max")
    u = minmax_clip(F.col("x"), F.col("data_min"), F.col("data_max"))
    scaled = attach(sample, bounds, ["criteria"]).groupBy("criteria").agg(
        F.avg(u).alias("m"), F.var_samp(u).alias("v"))
    m, v = F.col("m"), F.col("v")
    fits = settle(scaled.withColumn("regular", (v > 0.0) & (v < m * (F.lit(1.0) - m))))
    common = m * (F.lit(1.0) - m) / v - F.lit(1.0)
    moment = fits.filter("regular").select(
        "criteria", (m * common).alias("alpha"), ((F.lit(1.0) - m) * common).alias("beta"))
    odd = settle(null_safe(bounds, fits.filter(~F.coalesce("regular", F.lit(False))).select("criteria"), ["criteria"]))
    return moment if odd.isEmpty() else moment.unionByName(beta_mle(sample, odd))


def _params(sample: DataFrame, law: str, stats: DataFrame) -> DataFrame:
    """``stats`` with the law's parameters, null where it has none."""
    mean, var = F.col("data_mean"), F.col("var")
    at = mean - F.col("shift")

    def valid(condition: Column, *values: Column) -> DataFrame:
        return stats.withColumn("params", F.when(condition, law_params(law, *values)))

    if law == "lognormal":
        ratio = F.try_divide(F.col("std_pop"), mean)
        inflation = F.lit(1.0) + ratio * ratio
        return valid(mean > 0.0, F.sqrt(F.ln(inflation)), F.ln(mean / F.sqrt(inflation)))
    if law == "normal":
        return valid(F.col("std") > 0.0, mean, F.col("std"))
    if law == "exponential":
        return valid(at > 0.0, at)
    if law == "gamma":
        return valid((var > 0.0) & (at > 0.0), F.try_divide(at * at, var), F.try_divide(var, at))
    if law == "weibull":
        fit, names = weibull_mle(sample, stats), ("beta_shape", "lambda_scale")
    elif law == "beta":
        fit, names = _beta_fit(sample, stats), ("alpha", "beta")
    else:
        raise ValueError(f"no direct estimate for law {law!r}")
    joined = null_safe(stats, fit, ["criteria"], "left")
    found = F.when(F.col(names[0]).isNotNull(), law_params(law, *(F.col(c) for c in names)))
    return joined.withColumn("params", found).drop(*names, "residual")


def estimate(sample: DataFrame, law: str, d: float = 0.0, grid_from: int = 0, gather: int = GATHER) -> DataFrame:
    """One model row per criterion, without classes; null parameters where the law does not apply.

    A difference to an empirical percentile of 0 counts as 0, and the mean difference is always
    over three points. The MSE is over the percentile grid, over the three points for lognormal.
    """
    stats = _stats(sample, d)
    ps = [*CUSTOMER_PS, *grid_marks(grid_from)]
    moved = F.col("shift") if law in ("weibull", "gamma", "exponential") else F.lit(0.0)
    fitted = F.transform(quantiles(law, F.col("params"), ps, F.col("data_min"), F.col("data_max")), lambda q: q + moved)
    models = _params(sample, law, stats).withColumn("fit", F.when(F.col("params").isNotNull(), fitted))
    both = null_safe(models, percentiles(sample, ps, gather=gather, sizes=sizes_of(stats)), ["criteria"])

    k = len(CUSTOMER_PS)
    start, size = (1, k) if law == "lognormal" else (k + 1, len(ps) - k)
    squares = F.zip_with(F.slice("pct", start, size), F.slice("fit", start, size), lambda e, f: (e - f) * (e - f))
    square = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)

    def off(i: int) -> Column:
        gap = F.lit(100.0) * F.try_divide(F.col("fit")[i] - F.col("pct")[i], F.col("pct")[i])
        return F.when(F.col("fit").isNotNull(), F.when(F.col("pct")[i] == 0.0, F.lit(0.0)).otherwise(gap))

    some = sum((F.when(F.col("pct")[i] != 0.0, 1).otherwise(0) for i in range(k)), F.lit(0)) > 0
    total = sum((F.abs(off(i)) for i in range(k)), F.lit(0.0))
    return both.select(
        "criteria", "n", "data_min", "data_max", "data_mean", F.lit(law).alias("loi"),
        F.lit(None).cast("int").alias("class_index"), "params", F.lit(None).cast("double").alias("R2"),
        *(F.col("fit")[i].alias(c) for i, c in enumerate(FIT_COLUMNS)),
        *(F.col("pct")[i].alias(c) for i, c in enumerate(EMP_COLUMNS)),
        (square / F.lit(float(size))).alias("MSE"),
        F.when(some, total / F.lit(3.0)).alias("Mean relat diff"),
        *(off(i).alias(c) for i, c in enumerate(DIFF_COLUMNS)),
    ).select(*(f"`{c}`" for c in MODEL_COLUMNS))
