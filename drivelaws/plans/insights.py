"""Publication of trip, driver and population insights, and of one run's signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import study_ref
from ..operators.kpis import dimension_counts, distinct_on
from ..operators.merge import (
    DRIVER_KEYS, LEVEL_KEYS, TRIP_KEYS, merge_cycle_sources, merge_level, merge_timeseries, ranked_union, stamp_insights, stamp_study,
)
from ..operators.projections import cast_by_name, keys_first
from ..operators.reshape import explode_matrix
from ..operators.scale import settle
from ..sources.read import read_cycles, read_slice
from ..sources.store import Store

TABLES = {"TRIP_ID": "trip_insights", "DRIVER_ID": "driver_insights", "PFM": "study_insights", "NDIM": "study_matrix_values"}
PARTITIONS = {"TRIP_ID": ["year", "month"], "DRIVER_ID": ["year", "month"], "PFM": [], "NDIM": []}

PARTITIONS_BY_LEVEL = {"Trip_id": ["DRIVER_ID"], "VIn": ["month"], "insight_pfm": ["zone"]}
# What makes a study record itself, where given: one title can be studied over several populations and periods.
IDENTITY = ["Study_title", "Criteria_label", "Energy_category", "Segment", "region_country", "Data_source",
            "Period_date_start", "Period_date_end"]
# Key columns of the stored tables of a run.
DATA_KEYS = ["Loan_Conducteur_ID", "VIN", "tcid_runid", "ID", "TIMESTAMP", "TEMPS"]
META_KEYS = ["Loan_Conducteur_ID", "VIN", "tcid_runid", "ID", "signal"]
INFO_KEYS = ["Loan_Conducteur_ID", "VIN", "tcid_runid", "Channels_name"]
SLICE_KEYS = ["Loan_Conducteur_ID", "tcid_runid"]


@dataclass
class Published:
    """What a publication stored: rows of the main table, and of the matrix table by dimension."""

    main: DataFrame
    matrix: DataFrame | None = None
    dimensions: DataFrame | None = None


def _store(store: Store, rows: DataFrame, table: str, keys: list[str], overwrite: bool, partition_by: list[str]) -> None:
    if not store.exists(table):
        store.create(rows, table, [c for c in partition_by if c in rows.columns])
    elif overwrite:
        missing = [k for k in keys if k not in rows.columns]
        if missing:
            raise ValueError(f"rows that replace others need their keys; missing: {missing}")
        store.replace_slice(rows, table, keys)
    else:
        store.append(rows, table)


def store_insights(new: DataFrame, level: str, store: Store, study_title: str | None = None,
                   overwrite: bool = False, table: str | None = None, matrix_table: str | None = None,
                   add_timestamps: bool = True) -> Published:
    """Publish insights of a level (``TRIP_ID``, ``DRIVER_ID`` or ``PFM``).

    Population level takes study records, any number at once: each gets its reference, its matrix
    goes to the matrix table as long rows, the rest to the main table, both with the time of storing
    unless ``add_timestamps`` is off.
    """
    name = level.upper()
    if name in ("TRIP_ID", "DRIVER_ID"):
        rows = settle(stamp_insights(new, study_title))
        keys = TRIP_KEYS if name == "TRIP_ID" else DRIVER_KEYS
        _store(store, rows, table or TABLES[name], keys, overwrite, PARTITIONS[name])
        return Published(rows)
    if name != "PFM":
        raise ValueError(f"invalid level {level!r}, expected TRIP_ID, DRIVER_ID or PFM")
    title = F.coalesce("Study_title", F.lit("Untitled"))
    known = [c for c in IDENTITY if c in new.columns]
    identity = F.sha2(F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in known))), 256)
    # the short reference is for people and may collide; a study is known by the digest of what makes it itself
    referenced = new.withColumn("study_key", identity)
    referenced = settle(referenced.withColumn("Study_ref", study_ref(title, F.col("study_key"))))
    again = referenced.groupBy("study_key").count().filter("count > 1").limit(1)
    if not again.isEmpty():
        raise ValueError("two records of one call are the same study; publish them one after the other")
    main = settle(stamp_study(referenced.drop("dfmatrix"), add_timestamps))
    _store(store, main, table or TABLES["PFM"], ["study_key"], overwrite, PARTITIONS["PFM"])
    if "dfmatrix" not in new.columns:
        return Published(main)
    cells = explode_matrix(referenced, "dfmatrix", "study_key", "Criteria_label").withColumnRenamed("Study_ref", "study_key")
    refs = main.select("study_key", "Study_ref")
    matrix = settle(stamp_study(keys_first(cells.join(refs, "study_key"), ["Study_ref", "Criteria_label"]), add_timestamps))
    target = matrix_table or TABLES["NDIM"]
    if overwrite and store.exists(target):
        # by the studies published: one whose matrix is empty now keeps none of its old rows
        store.replace_slice(matrix, target, ["study_key"], taken=main.select("study_key"))
    elif not matrix.isEmpty():
        _store(store, matrix, target, ["study_key"], False, PARTITIONS["NDIM"])
    else:
        return Published(main)
    return Published(main, matrix, dimension_counts(matrix))


def store_level(new: DataFrame, level: str, table: str, store: Store, overwrite: bool = False) -> None:
    """Column merge of a results table with what is stored of its level."""
    if level not in LEVEL_KEYS:
        raise ValueError(f"unknown storage level {level!r}, expected one of {sorted(LEVEL_KEYS)}")
    if store.exists(table):
        store.merge_slice(new, table, LEVEL_KEYS[level], lambda old, rows: merge_level(old, rows, level, overwrite))
    else:
        store.create(new, table, [c for c in PARTITIONS_BY_LEVEL[level] if c in new.columns])


def store_cycles(store: Store, folder: str, table: str, cycle: str, keys: list[str], overwrite: bool = False) -> None:
    """Merge the files of all lifetime cycles of a folder into a table with one partition per cycle.

    One scan of the folder, one fold and one write serve all cycles; stored cycles without files are not opened.
    """
    files = read_cycles(store.spark, folder, cycle)
    if files is None:
        return
    stored = store.read(table) if store.exists(table) else None
    merged = merge_cycle_sources(files, stored, cycle, keys, overwrite)
    if stored is None:
        store.create(merged, table, [cycle])
    else:
        store.replace_slice(merged, table, [cycle])


def store_run(store: Store, driver: str, run: str, tables: dict[str, str], data: DataFrame | None = None,
              meta: DataFrame | None = None, info: DataFrame | None = None, overwrite: bool = False) -> None:
    """Persist one run: series, signal metadata and channel list, each replacing its slice."""
    prefer = "new" if overwrite else "old"

    def stored(kind: str) -> DataFrame | None:
        if not store.exists(tables[kind]):
            return None
        rows = read_slice(store.spark, tables[kind], Loan_Conducteur_ID=driver, tcid_runid=run)
        return None if rows.isEmpty() else rows

    def save(rows: DataFrame, kind: str) -> None:
        if store.exists(tables[kind]):
            store.replace_slice(rows, tables[kind], SLICE_KEYS)
        else:
            store.create(rows, tables[kind], ["Loan_Conducteur_ID"])

    if data is not None:
        old = stored("data")
        save(cast_by_name(data) if old is None else merge_timeseries(old, data, DATA_KEYS, overwrite), "data")
    for kind, new, keys in (("meta", meta, META_KEYS), ("info", info, INFO_KEYS)):
        if new is not None:
            old = stored(kind)
            save(distinct_on(new, keys) if old is None else ranked_union(old, new, keys, prefer), kind)
