"""Merges of a stored table with a new one, as pure functions of the two."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kpis import distinct_on
from .projections import cast_by_name, drop_common, quoted
from .scale import attach, null_safe, settle

# Key columns of each storage level, by the level's name.
LEVEL_KEYS = {
    "Trip_id": ["DRIVER_ID", "trip_id"],
    "VIn": ["DRIVER_ID", "month"],
    "insight_pfm": ["study_title", "criteria", "zone"],
}
TRIP_KEYS = ["DRIVER_ID", "TRIP_ID", "criteria"]
DRIVER_KEYS = ["DRIVER_ID", "month", "year", "criteria"]


def merge_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], prefer: str = "new",
                  how: str = "full", fill_nulls: bool = False) -> DataFrame:
    """Join two versions of a table on its keys; every column of either survives.

    A column both have comes wholly from the preferred side, nulls and one-sided rows included;
    ``fill_nulls`` takes the other side's value there instead. ``how='left'`` keeps only the
    preferred side's rows. Keys identify rows: duplicates on both sides multiply. One scan and one
    shuffle per side.
    """
    if prefer not in ("new", "old"):
        raise ValueError(f"prefer must be 'new' or 'old', not {prefer!r}")
    first, second = (new, old) if prefer == "new" else (old, new)
    names = [*keys, *sorted({*old.columns, *new.columns} - {*keys})]
    shared = [c for c in names if c not in keys and c in first.columns and c in second.columns]
    if fill_nulls:
        second = second.withColumnsRenamed({c: f"__other_{c}" for c in shared})
    else:
        second = drop_common(first, second, keys)
    if how == "left":
        joined = first.join(second, list(keys), "left")
    else:
        joined = first.join(second, list(keys), "full")
    return joined.select(*(
        F.coalesce(quoted([c])[0], quoted([f"__other_{c}"])[0]).alias(c) if fill_nulls and c in shared
        else F.col(quoted([c])[0])
        for c in names))


def merge_level(old: DataFrame, new: DataFrame, level: str, overwrite: bool = False) -> DataFrame:
    """Column merge with the keys of a storage level."""
    if level not in LEVEL_KEYS:
        raise ValueError(f"unknown storage level {level!r}, expected one of {sorted(LEVEL_KEYS)}")
    return merge_columns(old, new, LEVEL_KEYS[level], prefer="new" if overwrite else "old")


def merge_timeseries(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Column merge of signal series; signal columns (their names hold ``:``) become doubles."""
    return cast_by_name(merge_columns(old, new, keys, prefer="new" if overwrite else "old"))


def left_fold(dfs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join frames in turn on the keys; a column met before is not taken again."""
    return reduce(lambda left, right: left.join(drop_common(left, right, keys), list(keys), "left"), dfs)


def merge_cycles(files: Sequence[DataFrame], stored: DataFrame | None, keys: Sequence[str],
                 overwrite: bool = False) -> DataFrame:
    """Fold the files of all lifetime cycles, then left-join with what is stored of them.

    The cycle is one of the keys, so all cycles are merged by the same join.
    """
    merged = left_fold(files, keys)
    if stored is None:
        return merged
    return merge_columns(stored, merged, keys, prefer="new" if overwrite else "old", how="left")


def fold_sources(rows: DataFrame, cycle: str, keys: Sequence[str], source: str) -> DataFrame:
    """Fold the sources of every cycle, in the order of their names, by one keyed aggregate over all cycles.

    A cycle keeps the rows of its first source, and each column from the first of its sources that has it: that
    is, has a value of it in the cycle. Keys identify the rows of a source; of repeated ones the largest value stays.
    """
    columns = [c for c in rows.columns if c not in (*keys, cycle, source)]
    at = F.col(quoted([source])[0])
    held = rows.groupBy(*quoted([cycle, source])).agg(*(F.bool_or(F.col(q).isNotNull()).alias(f"__has{i}") for i, q in enumerate(quoted(columns))), F.count(F.lit(1)))
    first = settle(held.groupBy(*quoted([cycle])).agg(
        F.min(at).alias("__first"), *(F.min(F.when(F.col(f"__has{i}"), at)).alias(f"__from{i}") for i in range(len(columns)))))
    told = attach(rows, first, [cycle])
    merged = told.groupBy(*quoted([cycle, *(k for k in keys if k != cycle)])).agg(
        F.bool_or(at == F.col("__first")).alias("__kept"),
        *(F.max(F.when(at == F.col(f"__from{i}"), F.col(q))).alias(c) for i, (c, q) in enumerate(zip(columns, quoted(columns)))))
    return merged.filter("__kept").select(*quoted([*keys, *columns]))


def merge_cycle_sources(files: DataFrame, stored: DataFrame | None, cycle: str, keys: Sequence[str],
                        overwrite: bool = False, source: str = "source") -> DataFrame:
    """The cycles of the files, folded with what is stored of them.

    With ``overwrite`` what is stored is the last source of a cycle: it adds columns to the files' rows. Else it is
    the first: the files add columns to its rows. A cycle of which nothing is stored is folded from its files alone.
    """
    rows = files.withColumn(source, F.concat(F.lit("1/"), F.col(quoted([source])[0])))
    if stored is not None:
        known = null_safe(stored, files.select(*quoted([cycle])).distinct(), [cycle], "left_semi")
        rows = rows.unionByName(known.withColumn(source, F.lit("2/" if overwrite else "0/")), allowMissingColumns=True)
    return fold_sources(rows, cycle, keys, source)


def ranked_union(old: DataFrame, new: DataFrame, keys: Sequence[str], prefer: str = "new") -> DataFrame:
    """Union by name with one row per key, the preferred side's where it has one.

    Ties go to the smallest row. A plain aggregate picks it, combined before the shuffle, so a key
    with very many rows costs no more than another.
    """
    ranks = {"new": (1, 2), "old": (2, 1)}[prefer]
    both = new.withColumn("__rank", F.lit(ranks[0])).unionByName(
        old.withColumn("__rank", F.lit(ranks[1])), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "__rank"]
    rest = [c for c in columns if c not in keys]
    row = F.struct("__rank", *quoted(rest))
    return both.groupBy(*quoted(keys)).agg(F.min(row).alias("__row")).select(*(
        F.col(quoted([c])[0]) if c in keys else F.col("__row").getField(c).alias(c) for c in columns))


def anti_replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, plus the new rows.

    The new keys are made distinct first, so their repetitions never reach the join.
    """
    taken = new.select(*quoted(keys)).distinct()
    return old.join(taken, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def append_by_name(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def merge_insights(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Trip or driver insights: replace the keys given, or append."""
    return anti_replace(old, new, keys) if overwrite else append_by_name(old, new)


def stamp_insights(new: DataFrame, study_title: str | None) -> DataFrame:
    return new.withColumns({"dt": F.current_date(), "study_title": F.lit(study_title).cast("string")})


def stamp_study(new: DataFrame, stamp: bool = True) -> DataFrame:
    if not stamp:
        return new
    return new.withColumns({"Creation_date": F.current_timestamp(), "Modification_date": F.current_timestamp()})


def merge_studies(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """Population insights: the studies given replace their stored rows, or append.

    A study is known by ``study_key`` where both sides have it, else by its reference; rows that have
    neither can't replace others.
    """
    if not overwrite:
        return append_by_name(old, new)
    keys = [k for k in ("study_key", "Study_ref") if k in new.columns and k in old.columns]
    if not keys:
        raise ValueError("studies that replace others need study_key or Study_ref")
    return anti_replace(old, new, keys[:1])


def replace_id_cards(old: DataFrame, new: DataFrame, driver: str, vin: str) -> DataFrame:
    """KPI cards of one driver: constants set, rows made distinct, the driver's old cards replaced."""
    cards = distinct_on(new.withColumns({"Loan_Conducteur_ID": F.lit(driver), "VIN": F.lit(vin)}))
    return anti_replace(old, cards, ["Loan_Conducteur_ID"])
