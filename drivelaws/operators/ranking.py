"""Ranking of candidate laws by likelihood, from sums over the sample."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.laws import PARAMETERS, law_params, lgamma, pdf
from ..functions.special import gamma_shape
from .classes import beta_fit
from .likelihood import gumbel_mle
from .sample import percentiles, sizes_of
from .scale import attach, null_safe, settle

# The candidates, and the free parameters each likelihood counts.
DEFAULT_LAWS = ("normal", "lognormal", "beta", "gamma", "exponential", "gumbel")
FREE_PARAMETERS = {"normal": 2, "lognormal": 2, "beta": 2, "gamma": 2, "exponential": 1, "gumbel": 2, "weibull": 2}
UNRANKED_CHOICE = "lognormal"


@F.pandas_udf(T.DoubleType())
def _gamma_shape(gap: pd.Series) -> pd.Series:
    values = gap.to_numpy(float)
    out = np.full(len(values), np.nan)
    ok = values > 0
    if ok.any():
        out[ok] = gamma_shape(values[ok])
    return pd.Series(out)


def ranking_stats(sample: DataFrame) -> DataFrame:
    """The one pass that the closed-form laws need."""
    ln_x = F.ln("x")
    return sample.groupBy("criteria").agg(
        F.count("x").alias("n"), F.min("x").alias("data_min"), F.max("x").alias("data_max"),
        F.avg("x").alias("data_mean"), F.var_pop("x").alias("var_pop"),
        F.avg(ln_x).alias("mean_ln"), F.var_pop(ln_x).alias("var_ln"),
    )


def _closed(law: str, stats: DataFrame) -> DataFrame:
    n, mean = F.col("n").cast("double"), F.col("data_mean")
    half_ln_tau = F.lit(float(np.log(2 * np.pi) / 2))
    half = F.lit(0.5)
    if law == "normal":
        var = F.col("var_pop")
        loglik = -n * (half_ln_tau + half * F.ln(var) + half)
        params = law_params(law, mean, F.sqrt(var))
    elif law == "lognormal":
        var = F.col("var_ln")
        loglik = -n * (half_ln_tau + half * F.ln(var) + half + F.col("mean_ln"))
        params = law_params(law, F.sqrt(var), F.col("mean_ln"))
    elif law == "exponential":
        scale = mean - F.col("data_min")
        loglik = -n * (F.ln(scale) + F.lit(1.0))
        params = law_params(law, scale)
    elif law == "gamma":
        k = F.col("k")
        stats = stats.withColumn("k", _gamma_shape(F.ln(mean) - F.col("mean_ln")))
        theta = mean / k
        loglik = n * ((k - F.lit(1.0)) * F.col("mean_ln") - k - k * F.ln(theta) - lgamma(k))
        params = law_params(law, k, theta)
    else:
        raise ValueError(f"law {law!r} cannot be ranked")
    return stats.select("criteria", "n", F.lit(law).alias("law"), loglik.alias("loglik"), params.alias("params"))


def _beta(sample: DataFrame, stats: DataFrame) -> DataFrame:
    bounds = stats.filter("data_max > data_min")
    fits = null_safe(bounds.select("criteria", "n", "data_min", "data_max"), beta_fit(sample, bounds), ["criteria"])
    a, b, n = F.col("alpha"), F.col("beta"), F.col("n").cast("double")
    norm = lgamma(a) + lgamma(b) - lgamma(a + b) + F.ln(F.col("data_max") - F.col("data_min"))
    loglik = n * ((a - F.lit(1.0)) * F.col("ln_u") + (b - F.lit(1.0)) * F.col("ln_rest") - norm)
    return fits.select("criteria", "n", F.lit("beta").alias("law"), loglik.alias("loglik"), law_params("beta", a, b).alias("params"))


def rank_laws(sample: DataFrame, laws: Sequence[str] = DEFAULT_LAWS, stats: DataFrame | None = None) -> DataFrame:
    """``(criteria, law, k, loglik, aic, bic, params)`` per candidate.

    The location is fixed: 0 for lognormal and gamma, the minimum for exponential, the range for
    beta. A law that cannot be fitted keeps null parameters and ranks last.
    """
    stats = settle(ranking_stats(sample)) if stats is None else stats
    parts = []
    for law in laws:
        if law == "beta":
            parts.append(_beta(sample, stats))
        elif law == "gumbel":
            fit = gumbel_mle(sample, stats).select(
                "criteria", F.lit(law).alias("law"), "loglik", law_params(law, F.col("loc"), F.col("scale")).alias("params"))
            parts.append(null_safe(stats.select("criteria", "n"), fit, ["criteria"]))
        else:
            parts.append(_closed(law, stats))
    fits = parts[0]
    for part in parts[1:]:
        fits = fits.unionByName(part)

    names = F.array(*(F.lit(law) for law in laws))
    every = stats.select("criteria", "n", F.explode(names).alias("law"))
    joined = null_safe(every, fits.drop("n"), ["criteria", "law"], "left")
    free = F.create_map(*(part for law in laws for part in (F.lit(law), F.lit(FREE_PARAMETERS[law]))))
    finite = F.col("loglik").isNotNull() & ~F.isnan("loglik") & (F.abs("loglik") != float("inf"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    loglik = F.coalesce("loglik", F.lit(float("-inf")))
    return (
        joined.withColumn("k", free[F.col("law")])
        .withColumn("params", F.when(finite, F.col("params")))
        .withColumn("loglik", F.when(finite, F.col("loglik")))
        .select(
            "criteria", "law", "k", loglik.alias("loglik"),
            (F.lit(2.0) * k - F.lit(2.0) * loglik).alias("aic"),
            (k * F.ln(n) - F.lit(2.0) * loglik).alias("bic"),
            "params",
        )
    )


def top_law(ranking: DataFrame) -> DataFrame:
    """Law of the lowest AIC per criterion."""
    return ranking.groupBy("criteria").agg(F.min_by("law", F.struct("aic", "law")).alias("law"))


def choose_law(ranking: DataFrame, choice: str = "auto") -> DataFrame:
    """``(criteria, loi)``: the best law or the named one; one without class fit becomes lognormal."""
    fits = [law for law in PARAMETERS if law != "gumbel"]
    if choice == "auto":
        best = top_law(ranking)
        return best.select("criteria", F.when(F.col("law").isin(fits), F.col("law")).otherwise(UNRANKED_CHOICE).alias("loi"))
    law = choice if choice in fits else UNRANKED_CHOICE
    return ranking.select("criteria").distinct().withColumn("loi", F.lit(law))


def auto_bins(n: Column, width: Column, iqr: Column) -> Column:
    """Number of histogram bins by numpy's ``auto`` rule."""
    fd = F.lit(2.0) * iqr / F.cbrt(n)
    root = width / F.sqrt(n) / F.lit(2.0)
    sturges = width / (F.log2(n) + F.lit(1.0))
    return F.ceil(width / F.least(F.greatest(fd, root), sturges)).cast("long")


def hist_rmse(sample: DataFrame, fits: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``(criteria, law, rmse)`` between the density histogram and the fitted density at its centres."""
    stats = settle(ranking_stats(sample)) if stats is None else stats
    quartiles = percentiles(sample, (0.25, 0.75), sizes=sizes_of(stats))
    spread = null_safe(stats.filter("data_max > data_min"), quartiles, ["criteria"])
    n, width = F.col("n").cast("double"), F.col("data_max") - F.col("data_min")
    bins = settle(spread.select(
        "criteria", "n", "data_min", "data_max", auto_bins(n, width, F.col("pct")[1] - F.col("pct")[0]).alias("bins")))
    place = F.least(F.floor((F.col("x") - F.col("data_min")) / width * F.col("bins")), F.col("bins") - 1)
    counts = attach(sample, bins, ["criteria"]).groupBy("criteria", place.alias("bin")).agg(
        F.count(F.lit(1)).alias("freq"))
    every = bins.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    hist = null_safe(every, counts, ["criteria", "bin"], "left").select(
        "criteria", "data_min", "data_max",
        (F.col("data_min") + (F.col("bin") + F.lit(0.5)) * width / F.col("bins")).alias("centre"),
        (F.coalesce("freq", F.lit(0)) * F.col("bins") / (F.col("n") * width)).alias("density"),
    )
    usable = settle(fits.filter(F.col("params").isNotNull()).select("criteria", "law", "params"))
    laws = tuple(FREE_PARAMETERS)
    at = F.when(F.col("law") == "exponential", F.col("centre") - F.col("data_min")).otherwise(F.col("centre"))
    joined = null_safe(hist, usable, ["criteria"])
    gap = F.col("density") - pdf(F.col("law"), at, F.col("params"), F.col("data_min"), F.col("data_max"), laws)
    rmse = joined.groupBy("criteria", "law").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))
    every_fit = fits.select("criteria", "law")
    return null_safe(every_fit, rmse, ["criteria", "law"], "left").withColumn(
        "rmse", F.coalesce("rmse", F.lit(float("inf"))))
