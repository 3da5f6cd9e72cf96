"""Quality gates on class sweeps and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classes import DIFF_COLUMNS, EMP_COLUMNS, FIT_COLUMNS, MODEL_COLUMNS
from .sample import percentiles, sample_summary, sizes_of
from .scale import attach, null_safe, settle, within

# Sample size below which nothing is fitted, the name such rows carry, the default
# threshold (in percent).
MIN_SAMPLE = 30
UNMODELLED = "Non modelisable"
THRESHOLD = 0.1


def gate_mrd(models: DataFrame, threshold: float = THRESHOLD, rule: str = "percentiles") -> DataFrame:
    """``success`` or ``fallback`` per criterion, with the figures that decided it.

    Rule ``percentiles`` falls back only when, over all classes, the smallest absolute difference
    exceeds the threshold at 1, 50 and 99 % alike; rule ``mrd`` when the smallest mean difference does.
    """
    mrd = F.col("`Mean relat diff`")
    smallest = [F.min(F.abs(F.col(f"`{c}`"))).alias(f"min_{c.split('_')[2][:-1]}") for c in DIFF_COLUMNS]
    mins = models.groupBy("criteria").agg(
        *smallest, F.min(mrd).alias("min_mrd"),
        F.min_by("class_index", F.when(mrd.isNotNull(), F.struct(mrd, "class_index"))).alias("mrd_class"),
    )
    if rule == "percentiles":
        over = (F.col("min_1") > threshold) & (F.col("min_50") > threshold) & (F.col("min_99") > threshold)
    elif rule == "mrd":
        over = F.col("min_mrd") > threshold
    else:
        raise ValueError(f"unknown gate rule {rule!r}")
    over = F.coalesce(over, F.lit(False))
    return mins.select(
        "criteria", "min_1", "min_50", "min_99", "min_mrd",
        F.when(~over, F.col("mrd_class")).alias("mrd_class"),
        F.when(over, "fallback").otherwise("success").alias("status"),
        over.alias("use_fallback"),
    )


def gate_small_sample(sample: DataFrame, n_min: int = MIN_SAMPLE, summary: DataFrame | None = None) -> DataFrame:
    """Model rows of the criteria that are not fitted: too few values, or no spread.

    Their fitted customers are the empirical ones, with no difference.
    """
    summary = settle(sample_summary(sample)) if summary is None else summary
    small = settle(summary.filter((F.col("n") < n_min) | (F.col("data_max") <= F.col("data_min"))).select(
        "criteria", "n", "data_min", "data_max", "data_mean"))
    rows = attach(sample, within(small, small.select("criteria")), ["criteria"])
    pct = percentiles(rows, sizes=sizes_of(small))
    nothing = F.lit(None).cast("double")
    return null_safe(small, pct, ["criteria"]).select(
        "criteria", "n", "data_min", "data_max", "data_mean",
        F.lit(UNMODELLED).alias("loi"), F.lit(None).cast("int").alias("class_index"),
        F.lit(None).cast("map<string,double>").alias("params"), nothing.alias("R2"),
        *(F.col("pct")[i].alias(c) for cols in (FIT_COLUMNS, EMP_COLUMNS) for i, c in enumerate(cols)),
        nothing.alias("MSE"), F.lit(0.0).alias("Mean relat diff"), *(F.lit(0.0).alias(c) for c in DIFF_COLUMNS),
    ).select(*(f"`{c}`" for c in MODEL_COLUMNS))
