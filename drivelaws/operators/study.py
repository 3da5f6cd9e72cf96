"""Study records as tables: one row per study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BLANKS, list_text, safe_cast, stats_json

# What is wrong with a record, by a code of its own.
NO_TITLE, NO_VINS, ODD_DIMENSION, NO_FIELD = "E1 title is blank", "E2 no vehicle listed", "E3 unknown dimension: ", "E4 no value for: "
# Fields a record must have, valid dimensions, customer columns of a model row.
REQUIRED = ("Study_title", "Criteria_label", "Criteria_description", "Norm_applied", "Energy_category", "Segment",
            "region_country", "Data_source", "Vin_list", "List_of_signal_names")
DIMENSIONS = ("H0D", "H1D", "H2D", "H3D")
CLIENTS = ("client1%", "client50%", "client99%", "sample_client1%", "sample_client50%", "sample_client99%")
NO_STATS = "[]"


def study_header(criteria: DataFrame, population: DataFrame, sources: DataFrame, keys: Sequence[str] = ("study",)) -> DataFrame:
    """Head of each record: ``criteria`` (Study_title, Criteria_label, Criteria_description,
    dimension, Norm_applied), ``population`` (vins array, Energy_category, Segment, region_country)
    and ``sources`` (Data_source, signals array, start_date, end_date), by study."""
    joined = criteria.join(population, list(keys), "left").join(sources, list(keys), "left")

    def text(items: str):
        return F.when(F.size(items) > 0, list_text(F.col(items)))

    def dated(name: str):
        return F.when(F.col(name) != "", F.col(name))

    return joined.select(
        *keys,
        F.btrim(F.col("Study_title"), F.lit(BLANKS)).alias("Study_title"), F.lit("").alias("Criteria_ref"),
        "Criteria_label", "Criteria_description", "dimension", "Norm_applied",
        "Energy_category", "Segment", "region_country", "Data_source",
        text("vins").alias("Vin_list"),
        dated("start_date").alias("Period_date_start"), dated("end_date").alias("Period_date_end"),
        text("signals").alias("List_of_signal_names"),
    )


def attach_model(headers: DataFrame, models: DataFrame) -> DataFrame:
    """Add the modelling results of each record's criterion.

    ``models`` holds stored model rows, one per criterion (see ``first_model_row``). Figures that do
    not read as numbers become null; a criterion without model keeps empty results.
    """
    rows = models.select(
        F.col("criteria").alias("__criteria"),
        stats_json(F.col("data_min"), F.col("data_max"), F.col("data_mean")).alias("__stats"),
        F.col("loi").cast("string").alias("loi"), F.col("parameters").cast("string").alias("parameters"),
        safe_cast(F.col("class_index"), "int").alias("class_index"), safe_cast(F.col("R2"), "double").alias("R2"),
        *((safe_cast(F.col(f"`{c}`"), "double") if c in models.columns else F.lit(None).cast("double"))
          .alias(c.replace("%", "pct")) for c in CLIENTS),
    )
    joined = headers.join(rows, headers["Criteria_label"] == rows["__criteria"], "left")
    stats = F.coalesce("__stats", F.lit(NO_STATS)).alias("Final_stats_min_max_moyenne")
    return joined.select(*headers.columns, stats, *(c for c in rows.columns if not c.startswith("__")))


def attach_matrix(headers: DataFrame, matrices: DataFrame, keys: Sequence[str] = ("study",)) -> DataFrame:
    """Add each record's wrapped matrix (``dfmatrix`` by study); an H0D record never has one."""
    joined = headers.join(matrices.select(*keys, "dfmatrix"), list(keys), "left")
    return joined.withColumn("dfmatrix", F.when(F.col("dimension") != "H0D", F.col("dfmatrix")))


def validate(headers: DataFrame) -> DataFrame:
    """Add ``errors``: what is wrong with each record, empty when nothing is."""
    blank_title = F.coalesce(F.btrim(F.col("Study_title"), F.lit(BLANKS)), F.lit("")) == ""
    no_vins = F.coalesce("Vin_list", F.lit("")) == ""
    odd = ~F.coalesce(F.col("dimension").isin(*DIMENSIONS), F.lit(False))
    checks = [
        F.when(blank_title, F.lit(NO_TITLE)),
        F.when(odd, F.concat(F.lit(ODD_DIMENSION), F.coalesce("dimension", F.lit("")))),
        F.when(no_vins, F.lit(NO_VINS)),
        *(F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) == "", F.lit(NO_FIELD + name))
          for name in REQUIRED),
    ]
    return headers.withColumn("errors", F.array_compact(F.array(*checks)))


def build(headers: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid records, and the rejected ones with their errors; ``strict`` raises if any is rejected."""
    checked = validate(headers)
    rejected = checked.filter(F.size("errors") > 0)
    if strict:
        sample = rejected.select("errors").take(1)
        if sample:
            raise ValueError(f"study records are not valid, for example: {'; '.join(sample[0].errors)}")
    return checked.filter(F.size("errors") == 0).drop("errors"), rejected
