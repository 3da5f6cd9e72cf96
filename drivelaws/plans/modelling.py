"""From columns to customer laws: all criteria in one set of jobs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.laws import LAWS, by_law, cdf, pdf
from ..operators.classes import (
    MODEL_COLUMNS, attach_beta, best_class, beta_mle, class_histogram, drop_first_classes, empirical_points,
    fit_classes, fit_points, ols, recovered, with_quality,
)
from ..operators.estimate import estimate
from ..operators.gates import MIN_SAMPLE, THRESHOLD, gate_mrd, gate_small_sample
from ..operators.projections import keep_existing, rename_clients
from ..operators.ranking import choose_law, rank_laws, ranking_stats
from ..operators.sample import GATHER, to_sample
from ..operators.scale import attach, null_safe, settle, within


def model_summary(sample: DataFrame, n_max: int, threshold: float, law: str = "lognormal") -> tuple[DataFrame, DataFrame]:
    """Gate outcome and sweep of one law, the two lowest class counts left out."""
    models = settle(fit_classes(sample, law, n_max).filter(F.col("class_index") >= 4))
    return gate_mrd(models, threshold), models


def _sweep(sample: DataFrame, summary: DataFrame, chosen: DataFrame, laws: tuple[str, ...], n_max: int,
           grid_from: int, gather: int) -> DataFrame:
    """Class sweep in which every criterion follows its own law."""
    hist = attach(class_histogram(sample, n_max, summary=summary), chosen, ["criteria"])
    by = ["criteria", "n", "data_min", "data_max", "data_mean", "loi", "class_index"]
    lines = ols(fit_points(hist, F.col("loi")), "y", "x", by)
    line = {law: (lambda law=law: F.lit(None).cast("map<string,double>") if law == "beta" else recovered(
        law, F.col("slope"), F.col("intercept"))) for law in laws}
    models = lines.select(*by, by_law(F.col("loi"), line).alias("params"), "R2")
    if "beta" in laws:
        of_beta = settle(null_safe(summary, chosen.filter("loi = 'beta'").select("criteria"), ["criteria"], "left_semi"))
        models = attach_beta(models, beta_mle(sample, of_beta))
    empirical = empirical_points(sample, summary, grid_from, gather)
    return with_quality(models, empirical, grid_from, laws).select(*(f"`{c}`" for c in MODEL_COLUMNS))


def model_sample(sample: DataFrame, n_max: int, choice: str = "auto", threshold: float = THRESHOLD,
                 grid_from: int = 0, gather: int = GATHER) -> DataFrame:
    """Model rows of every criterion of a sample.

    ``method`` says how a row came about: ``class`` (one row per class count kept, ``is_best`` on
    the chosen one), ``estimation`` (the gate fell back) or ``empirical`` (too small to fit). ``status`` is the
    gate's outcome: ``success``, ``fallback``, ``failed`` where it fell back and no estimate was found, so that
    the class rows stay, or null where nothing was fitted.
    """
    stats = settle(ranking_stats(sample))
    fit_for = stats.filter((F.col("n") >= MIN_SAMPLE) & (F.col("data_max") > F.col("data_min")))
    unfitted = gate_small_sample(sample, summary=stats)
    parts = [unfitted.withColumns({"method": F.lit("empirical"), "is_best": F.lit(True), "status": F.lit(None).cast("string")})]
    summary = settle(fit_for)
    if not summary.isEmpty():
        rows = attach(sample, within(summary, summary.select("criteria")), ["criteria"])
        ranking = rank_laws(rows, stats=summary) if choice == "auto" else summary
        chosen = settle(choose_law(ranking, choice))
        present = {row.loi for row in chosen.select("loi").distinct().collect()}  # at most the six laws
        laws = tuple(law for law in LAWS if law in present)
        models = settle(drop_first_classes(_sweep(rows, summary, chosen, laws, n_max, grid_from, gather)))
        gate = settle(gate_mrd(models, threshold).select("criteria", "use_fallback"))
        fallen = settle(null_safe(chosen, gate.filter("use_fallback").select("criteria"), ["criteria"], "left_semi"))
        gone = {row.loi for row in fallen.select("loi").distinct().collect()}
        direct = [
            estimate(attach(rows, settle(fallen.filter(F.col("loi") == law).select("criteria")), ["criteria"]),
                     law, grid_from=grid_from, gather=gather)
            for law in laws if law in gone
        ]
        replaced = None
        if direct:
            direct = settle(reduce(DataFrame.unionByName, direct).filter(F.col("params").isNotNull()))
            replaced = direct.select("criteria")
            parts.append(direct.withColumns({"method": F.lit("estimation"), "is_best": F.lit(True), "status": F.lit("fallback")}))
        kept = models if replaced is None else null_safe(models, replaced, ["criteria"], "left_anti")
        best = best_class(kept).select("criteria", "best_class")
        parts.append(
            null_safe(null_safe(kept, best, ["criteria"]), gate, ["criteria"])
            .withColumn("method", F.lit("class"))
            .withColumn("is_best", F.coalesce(F.col("class_index") == F.col("best_class"), F.lit(False)))
            .withColumn("status", F.when(F.col("use_fallback"), "failed").otherwise("success"))
            .drop("best_class", "use_fallback")
        )
    return reduce(DataFrame.unionByName, parts)


def model_columns(df: DataFrame, cols: Sequence[str], n_max: int, choice: str = "auto",
                  threshold: float = THRESHOLD, **options) -> DataFrame:
    """Model rows of several columns of a table; a column without positive values has none."""
    return model_sample(to_sample(df, cols), n_max, choice, threshold, **options)


def params_json(params: Column) -> Column:
    """Parameters that have a value, as JSON text."""
    return F.to_json(F.map_filter(params, lambda _, v: v.isNotNull() & ~F.isnan(v)))


def model_table(models: DataFrame, study: str, description: dict) -> DataFrame:
    """Model rows as stored: study, sample description, law, JSON parameters, customers."""
    columns = ["criteria", "data_min", "data_max", "data_mean", "loi", "parameters", "class_index", "R2",
               "percentile_1%", "percentile_50%", "percentile_99%",
               "percentile_1%_emp", "percentile_50%_emp", "percentile_99%_emp", "method", "is_best", "status"]
    full = models.withColumn("parameters", F.coalesce(params_json(F.col("params")), F.lit("{}")))
    kept = rename_clients(keep_existing(full, columns))
    return kept.select(
        F.lit(study).alias("study_title"),
        F.lit(json.dumps(description)).alias("sample_description"),
        *(f"`{c}`" for c in kept.columns),
    )


def curve_points(models: DataFrame, n: int = 1000) -> DataFrame:
    """Density and distribution of each model row at n equally spaced points of its range.

    The beta law is evaluated on the scaled range and its density brought back to data units.
    """
    low, high = F.col("data_min"), F.col("data_max")
    grid = models.filter(F.col("params").isNotNull()).select(
        "criteria", "loi", "class_index", "params", "data_min", "data_max",
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
    placed = grid.withColumn("x", low + (high - low) * F.col("point") / F.lit(float(n - 1)))
    law, params, x = F.col("loi"), F.col("params"), F.col("x")
    return placed.select("criteria", "loi", "class_index", "point", "x",
                         pdf(law, x, params, low, high).alias("pdf"), cdf(law, x, params, low, high).alias("cdf"))
