"""Class regressions: the sweep over class counts, law by law.

With n classes the upper limits are ``min + (max - min) * (9 + 10 i) / (10 n - 2)``. In units of the
range they are the same numbers for every criterion, so the limits of all class counts form one
fixed ascending table. A row is located in it once, by binary search, and a single partial
aggregate over (criterion, slot) serves the whole sweep.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.laws import LAWS, PARAMETERS, law_params, quantiles
from ..functions.normal import probit
from ..functions.scalars import minmax_clip, plotting_position
from ..functions.special import beta_shapes
from .sample import CUSTOMER_PS, GATHER, locate, ols, percentiles, sample_summary, sizes_of
from .scale import attach, null_safe, settle, within

GRID_STEP = 5
FIT_COLUMNS = ("percentile_1%", "percentile_50%", "percentile_99%")
EMP_COLUMNS = tuple(f"{c}_emp" for c in FIT_COLUMNS)
DIFF_COLUMNS = ("relat_diff_1%", "relat_diff_50%", "relat_diff_99%")
MODEL_COLUMNS = ("criteria", "n", "data_min", "data_max", "data_mean", "loi", "class_index", "params", "R2",
                 *FIT_COLUMNS, *EMP_COLUMNS, "MSE", "Mean relat diff", *DIFF_COLUMNS)


def _limit_table(n_min: int, n_max: int) -> tuple[list[Fraction], dict[Fraction, int]]:
    limits = sorted({Fraction(9 + 10 * i, 10 * n - 2) for n in range(n_min, n_max + 1) for i in range(n)})
    return limits, {limit: place for place, limit in enumerate(limits)}


def _numbers(values: list, kind: str) -> Column:
    """A constant array; folded to one literal, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def class_limit(low: Column, high: Column, n: Column, i: Column) -> Column:
    """Upper limit of class i out of n."""
    place = (F.lit(9.0) + F.lit(10.0) * i) / (F.lit(10.0) * n - F.lit(2.0))
    return low + (high - low) * place


def class_histogram(sample: DataFrame, n_max: int, n_min: int = 2, summary: DataFrame | None = None) -> DataFrame:
    """Counts per class for every class count n_min..n_max.

    One row per (criteria, class_index, i): the class limit, ``freq`` between it and the limit
    before, and the cumulative ``i_rank`` = number of values below it. The open class i = n above
    the last limit closes the total. Criteria without spread have no classes.
    """
    limits, place = _limit_table(n_min, n_max)
    depth = len(limits).bit_length()
    padded = [float(limit) for limit in limits] + [float("inf")] * (2 ** depth - 1 - len(limits))
    table = _numbers(padded, "double")

    if summary is None:
        summary = settle(sample_summary(sample))
    spread = summary.filter("data_max > data_min").select("criteria", "n", "data_min", "data_max", "data_mean")
    bounds = within(summary, spread.select("criteria", "data_min", (F.col("data_max") - F.col("data_min")).alias("width")))
    slotted = locate(
        attach(sample.select("criteria", "x"), bounds, ["criteria"]), "slot", depth,
        lambda j: F.col("x") >= F.col("data_min") + F.col("width") * table[j],
    )
    tally = slotted.groupBy("criteria", "slot").agg(F.count(F.lit(1)).alias("size"))

    # every limit, as (class count, position, place in the table); the open class sits past them all
    entries = [(n, i, place[Fraction(9 + 10 * i, 10 * n - 2)]) for n in range(n_min, n_max + 1) for i in range(n)]
    entries += [(n, n, len(limits)) for n in range(n_min, n_max + 1)]
    grid = F.arrays_zip(*(_numbers(list(part), "int").alias(name)
                          for part, name in zip(zip(*entries), ("class_index", "i", "slot"))))
    points = spread.select("*", F.inline(grid).alias("class_index", "i", "slot"))
    below = Window.partitionBy("criteria").orderBy("slot").rangeBetween(Window.unboundedPreceding, 0)
    ranked = (
        tally.unionByName(points.withColumn("size", F.lit(0)), allowMissingColumns=True)
        .withColumn("i_rank", F.sum("size").over(below))
        .filter(F.col("i").isNotNull())
    )
    order = Window.partitionBy("criteria", "class_index").orderBy("i")
    return ranked.select(
        "criteria", "n", "data_min", "data_max", "data_mean", "class_index", "i",
        F.when(F.col("i") < F.col("class_index"),
               class_limit(F.col("data_min"), F.col("data_max"), F.col("class_index"), F.col("i"))).alias("limit"),
        (F.col("i_rank") - F.coalesce(F.lag("i_rank").over(order), F.lit(0))).alias("freq"),
        "i_rank",
    )


def cumulative_rank(hist: DataFrame) -> DataFrame:
    """Running count over the classes of each (criteria, class count) from their ``freq``."""
    order = Window.partitionBy("criteria", "class_index").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("i_rank", F.sum("freq").over(order))


def fit_points(hist: DataFrame, law: str | Column, d: float = 0.0, first_extra: int = 0) -> DataFrame:
    """Linearised points (x, y) of the class limits; null where the law has no value there."""
    limit, shift = F.col("limit"), F.lit(float(d))
    rank = plotting_position(F.col("i_rank") + F.lit(first_extra), F.col("n"))
    width = F.col("data_max") - F.col("data_min")
    name = F.lit(law) if isinstance(law, str) else law
    x = (
        F.when(name.isin("weibull", "gamma"), F.ln(limit))
        .when(name == "lognormal", F.ln(limit - shift))
        .when(name == "beta", (limit - F.col("data_min")) / width)
        .otherwise(limit - shift)
    )
    survival = F.lit(1.0) - F.col("F")
    y = (
        F.when(name == "weibull", F.ln(-F.ln(survival)))
        .when(name == "exponential", -F.ln(survival))
        .otherwise(probit(F.col("F")))
    )
    return (
        hist.filter(F.col("i") < F.col("class_index"))
        .withColumn("F", rank)
        .withColumn("x", x).withColumn("y", y)
    )


def recovered(law: str, slope: Column, intercept: Column) -> Column:
    """Law parameters from the regression line (the beta law has its own estimate)."""
    inverse = F.try_divide(F.lit(1.0), slope)
    values = {
        "lognormal": lambda: (inverse, -intercept * inverse),
        "normal": lambda: (-intercept * inverse, inverse),
        "weibull": lambda: (slope, F.exp(F.try_divide(-intercept, slope))),
        "gamma": lambda: (inverse * inverse, F.exp(-intercept * slope)),
        "exponential": lambda: (inverse,),
    }[law]()
    return law_params(law, *values)


@F.pandas_udf(T.StructType([T.StructField("alpha", T.DoubleType()), T.StructField("beta", T.DoubleType())]))
def _solve_beta(mean: pd.Series, var: pd.Series, ln_u: pd.Series, ln_rest: pd.Series) -> pd.DataFrame:
    a, b = beta_shapes(*(np.asarray(c, dtype=float) for c in (mean, var, ln_u, ln_rest)))
    return pd.DataFrame({"alpha": np.atleast_1d(a), "beta": np.atleast_1d(b)})


def beta_fit(sample: DataFrame, summary: DataFrame) -> DataFrame:
    """(criteria, alpha, beta) by maximum likelihood on the scaled, clipped sample, with the means
    of ln u and ln(1 - u) that the likelihood is made of."""
    bounds = within(summary, summary.filter("data_max > data_min").select("criteria", "data_min", "data_max"))
    u = minmax_clip(F.col("x"), F.col("data_min"), F.col("data_max"))
    stats = attach(sample, bounds, ["criteria"]).select("criteria", u.alias("u")).groupBy("criteria").agg(
        F.avg("u").alias("m"), F.var_pop("u").alias("v"),
        F.avg(F.ln("u")).alias("ln_u"), F.avg(F.ln(F.lit(1.0) - F.col("u"))).alias("ln_rest"),
    )
    solved = stats.select("criteria", "ln_u", "ln_rest", _solve_beta("m", "v", "ln_u", "ln_rest").alias("fit"))
    return solved.select("criteria", "fit.*", "ln_u", "ln_rest")


def beta_mle(sample: DataFrame, summary: DataFrame) -> DataFrame:
    return beta_fit(sample, summary).select("criteria", "alpha", "beta")


def grid_marks(grid_from: int = 0) -> list[float]:
    return [m / 100 for m in range(grid_from, 100, GRID_STEP)]


def with_quality(models: DataFrame, empirical: DataFrame, grid_from: int = 0,
                 laws: tuple[str, ...] = LAWS) -> DataFrame:
    """Fitted and empirical customers, their relative differences in percent, MSE and mean
    difference over the percentile grid.

    ``empirical`` is ``(criteria, pct)`` at the three customer percentiles, then the grid.
    """
    ps = [*CUSTOMER_PS, *grid_marks(grid_from)]
    law = laws[0] if len(laws) == 1 else F.col("loi")
    fitted = models.withColumn(
        "fit", quantiles(law, F.col("params"), ps, F.col("data_min"), F.col("data_max"), laws))
    both = null_safe(fitted, empirical, ["criteria"])
    k, size = len(CUSTOMER_PS), F.lit(float(len(ps) - len(CUSTOMER_PS)))

    def off(i: int) -> Column:
        return F.try_divide(F.lit(100.0) * (F.col("fit")[i] - F.col("pct")[i]), F.col("pct")[i])

    def mean(term) -> Column:
        tail = F.zip_with(F.slice("fit", k + 1, len(ps)), F.slice("pct", k + 1, len(ps)), term)
        return F.aggregate(tail, F.lit(0.0), lambda acc, v: acc + v) / size

    return both.select(
        *(c for c in models.columns),
        *(F.col("fit")[i].alias(c) for i, c in enumerate(FIT_COLUMNS)),
        *(F.col("pct")[i].alias(c) for i, c in enumerate(EMP_COLUMNS)),
        mean(lambda f, e: (e - f) * (e - f)).alias("MSE"),
        mean(lambda f, e: F.abs(F.try_divide(F.lit(100.0) * (f - e), e))).alias("Mean relat diff"),
        *(off(i).alias(c) for i, c in enumerate(DIFF_COLUMNS)),
    )


def fit_lines(hist: DataFrame, law: str, d: float = 0.0, first_extra: int = 0) -> DataFrame:
    """One regression per (criteria, class count) with the law's parameters."""
    by = ["criteria", "n", "data_min", "data_max", "data_mean", "class_index"]
    lines = ols(fit_points(hist, law, d, first_extra), "y", "x", by)
    params = F.lit(None).cast("map<string,double>") if law == "beta" else recovered(
        law, F.col("slope"), F.col("intercept"))
    return lines.select(*by, F.lit(law).alias("loi"), params.alias("params"), "R2")


def attach_beta(models: DataFrame, shapes: DataFrame) -> DataFrame:
    """Give the beta rows their class-independent shapes."""
    joined = null_safe(models, shapes, ["criteria"], "left")
    filled = F.when(F.col("loi") == "beta", law_params("beta", F.col("alpha"), F.col("beta"))).otherwise(F.col("params"))
    return joined.withColumn("params", filled).drop(*PARAMETERS["beta"])


def empirical_points(sample: DataFrame, summary: DataFrame, grid_from: int = 0, gather: int = GATHER) -> DataFrame:
    return percentiles(sample, [*CUSTOMER_PS, *grid_marks(grid_from)], gather=gather,
                       sizes=sizes_of(summary))


def fit_classes(sample: DataFrame, law: str, n_max: int, d: float = 0.0, grid_from: int = 0,
                n_min: int = 2, gather: int = GATHER) -> DataFrame:
    """Class sweep of one law: a model row per (criteria, class count)."""
    summary = settle(sample_summary(sample))
    models = fit_lines(class_histogram(sample, n_max, n_min, summary), law, d)
    if law == "beta":
        models = attach_beta(models, beta_mle(sample, summary))
    empirical = empirical_points(sample, summary, grid_from, gather)
    return with_quality(models, empirical, grid_from, (law,)).select(*(f"`{c}`" for c in MODEL_COLUMNS))


def fit_classes_shifted(sample: DataFrame, n_max: int, d: float = 0.0, n_min: int = 2) -> DataFrame:
    """The older lognormal sweep: limits shifted by d, one added to the first class."""
    models = fit_lines(class_histogram(sample, n_max, n_min), "lognormal", d, first_extra=1)
    fitted = quantiles("lognormal", F.col("params"), CUSTOMER_PS, F.col("data_min"), F.col("data_max"))
    return models.withColumn("fit", fitted).select(
        "criteria", "class_index", "R2", F.col("params")["slnx"].alias("slnx"), F.col("params")["mulnx"].alias("mulnx"),
        *(F.col("fit")[i].alias(c) for i, c in enumerate(FIT_COLUMNS)),
    )


def drop_first_classes(models: DataFrame, k: int = 3) -> DataFrame:
    """Leave out the k lowest class counts of a sweep that has more than k of them."""
    last = Window.partitionBy("criteria")
    counted = models.withColumn("__first", F.min("class_index").over(last)).withColumn(
        "__last", F.max("class_index").over(last))
    short = F.col("__last") - F.col("__first") + 1 <= k
    return counted.filter(short | (F.col("class_index") >= F.col("__first") + k)).drop("__first", "__last")


def best_row(df: DataFrame, by: list[str], score: Column, pick: str = "class_index") -> DataFrame:
    """Per group the ``pick`` of the lowest score, ties to the lowest pick; null and NaN scores lose."""
    usable = score.isNotNull() & ~F.isnan(score)
    return df.groupBy(*by).agg(F.min_by(pick, F.when(usable, F.struct(score, F.col(pick)))).alias(pick))


def best_class(models: DataFrame) -> DataFrame:
    """Class counts closest to the sample at 1 and 50 %, at 50 and 99 %, and at all three; the last
    one is the choice."""
    gaps = [F.abs(F.col(f"`{f}`") - F.col(f"`{e}`")) for f, e in zip(FIT_COLUMNS, EMP_COLUMNS)]
    scores = {"index_best_1_50": gaps[:2], "index_best_50_99": gaps[1:], "index_best_1_50_99": gaps}
    choices = []
    for name, parts in scores.items():
        score = reduce(lambda a, b: a + b, parts)
        usable = score.isNotNull() & ~F.isnan(score)
        choices.append(F.min_by("class_index", F.when(usable, F.struct(score, "class_index"))).alias(name))
    return models.groupBy("criteria").agg(*choices).withColumn("best_class", F.col("index_best_1_50_99"))
