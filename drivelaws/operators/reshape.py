"""Scalar, map and matrix criteria to long tables and back.

A cell is a scalar or JSON text. It is parsed to a variant, and its levels are opened as rows
one after the other: a branch of another depth never spoils its neighbours, and no matrix is held
as a whole beyond its own text. Objects that the parser refuses, for a repeated key, take a branch of
the plan of their own, so no other cell pays for them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from json.encoder import encode_basestring_ascii

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_number, number_json
from .projections import quoted

NONE = "none"

# Stored schemas of trip and driver insights.
TRIP_BASE = T.StructType([
    T.StructField("DRIVER_ID", T.StringType()), T.StructField("VIN", T.StringType()),
    T.StructField("TRIP_ID", T.DoubleType()),
    T.StructField("month", T.IntegerType()), T.StructField("year", T.IntegerType()),
    T.StructField("trip_start", T.TimestampType()), T.StructField("trip_end", T.TimestampType()),
    T.StructField("duration_trip_h", T.DoubleType()),
    T.StructField("distance_trip_integral_km", T.DoubleType()),
    T.StructField("sum_distance_CITY_km", T.DoubleType()),
    T.StructField("sum_distance_ROAD_km", T.DoubleType()),
    T.StructField("sum_distance_HIGHWAY_km", T.DoubleType()),
    T.StructField("trip_quality_flag", T.IntegerType()),
])
DRIVER_BASE = T.StructType([
    T.StructField("DRIVER_ID", T.StringType()), T.StructField("VIN", T.StringType()),
    T.StructField("month", T.IntegerType()), T.StructField("year", T.IntegerType()),
    T.StructField("first_trip", T.TimestampType()), T.StructField("last_trip", T.TimestampType()),
    T.StructField("total_trips", T.IntegerType()), T.StructField("valid_trips", T.IntegerType()),
    T.StructField("dist_tot_integ_km", T.DoubleType()), T.StructField("total_duration_h", T.DoubleType()),
    T.StructField("sum_distance_driver_year_month_CITY_km", T.DoubleType()),
    T.StructField("sum_distance_driver_year_month_ROAD_km", T.DoubleType()),
    T.StructField("sum_distance_driver_year_month_HIGHWAY_km", T.DoubleType()),
    T.StructField("valid_client", T.IntegerType()),
])


def schema_trips() -> T.StructType:
    names = ("criteria", "dimension", "correspondant_value")
    return T.StructType([*TRIP_BASE.fields, *(T.StructField(n, T.StringType()) for n in names)])


def schema_drivers() -> T.StructType:
    names = ("criteria", "dimension", "classA", "classB", "classC")
    return T.StructType([*DRIVER_BASE.fields, *(T.StructField(n, T.StringType()) for n in names),
                         T.StructField("correspondant_value", T.DoubleType())])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema, cast to its types; the ones missing are null."""
    return df.select(*(
        (F.col(quoted([f.name])[0]) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields))


def _text(df: DataFrame, name: str) -> Column:
    column, kind = F.col(quoted([name])[0]), df.schema[name].dataType
    return F.to_json(column) if isinstance(kind, (T.MapType, T.StructType)) else column.cast("string")


class _Number(str):
    """A number's own text."""


def _strict_json(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{encode_basestring_ascii(k)}:{_strict_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_strict_json, value)) + "]"
    if isinstance(value, str):
        return str(value) if isinstance(value, _Number) else encode_basestring_ascii(value)
    return json.dumps(value)


@F.pandas_udf(T.StringType())
def lenient_text(cells: pd.Series) -> pd.Series:
    """Objects with bare NaN or Infinity (then text) or repeated keys (the last counts) as strict JSON; null if none.

    For the few cells that the strict reader refuses; levels have no limit but the reader's own.
    """
    def read(cell: str) -> str | None:
        try:
            value = json.loads(cell, parse_int=_Number, parse_float=_Number, parse_constant=str)
            return _strict_json(value) if isinstance(value, dict) else None
        except (ValueError, RecursionError):
            return None

    return cells.map(read, na_action="ignore")


def _braced(cell: Column) -> Column:
    return cell.rlike(r"^\s*\{")


def _read(cell: Column) -> Column:
    """The one value of a cell of JSON, bare NaN and Infinity allowed as text: text after a document makes it no document."""
    listed = F.from_json(F.concat(F.lit("["), cell, F.lit("]")), "array<variant>", {"allowSingleQuotes": "false"})
    # within a lambda, so that a cell is parsed once
    return F.transform(F.array(listed), lambda one: F.when(F.size(one) == 1, one[0]))[0]


def _entries(text: Column) -> Column:
    """Entries of the outermost level of an object's text, of a repeated key the last. Null if it is none."""
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false"})
    entries = F.reverse(F.map_entries(F.when(F.size(listed) == 1, listed[0])))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(entries, lambda e: e["value"])
    places = F.transform(entries, lambda e: e["key"])
    return F.transform(keys, lambda k: F.get(values, F.array_position(places, k).cast("int") - 1))


def unreadable(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``(column, cell, rows)``: texts with a brace in front that can't be read as an object, and how often."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), _text(df, c).alias("cell")) for c in cols))
    odd = df.select(F.inline(cells)).filter(_braced(F.col("cell")) & _read(F.col("cell")).isNull())
    return odd.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("rows")).filter(lenient_text("cell").isNull())


def _is_map(cell: Column, parsed: Column) -> Column:
    """Valid JSON that starts with a brace is an object."""
    return parsed.isNotNull() & _braced(cell)


def _number(leaf: Column) -> Column:
    """Number of a leaf's JSON text, in quotes or not; null for anything else."""
    return F.coalesce(as_number(F.btrim(leaf, F.lit('"'))),
                      F.when(leaf == "true", F.lit(1.0)).when(leaf == "false", F.lit(0.0)))


def _open(df: DataFrame, value: Column, key: str, leaf: str, keep: bool = False) -> DataFrame:
    """One row per entry of an object: its key, its value ``__<leaf>`` and that value's JSON text.

    ``keep`` leaves one row without entry where there is none.
    """
    entries = df.withColumn("__open", value)
    functions = df.sparkSession.tvf
    explode = functions.variant_explode_outer if keep else functions.variant_explode
    opened = explode(F.col("__open").outer()).toDF("__pos", key, f"__{leaf}")
    rows = entries.lateralJoin(opened).drop("__pos", "__open")
    return rows.withColumn(leaf, F.to_json(f"__{leaf}"))


def _map_dimension(parsed: Column) -> Column:
    """H2D if a value of the object is an object. Only text that can hold one is looked at closely."""
    values = F.map_values(F.try_variant_get(parsed, "$", "map<string,variant>"))
    nested = F.exists(values, lambda v: F.to_json(v).startswith("{"))
    return F.when(F.to_json(parsed).contains(":{"), F.when(nested, "H2D").otherwise("H1D")).otherwise("H1D")


def cell_dimension(cell: Column) -> Column:
    """H0D for a scalar, H2D for a map that holds a map, else H1D (an empty map too)."""
    parsed, entries = _read(cell), _entries(cell)
    lenient = F.when(F.exists(entries, lambda v: v.startswith("{")), "H2D").when(entries.isNotNull(), "H1D").otherwise("H0D")
    return F.when(~F.coalesce(_braced(cell), F.lit(False)), "H0D").when(parsed.isNotNull(), _map_dimension(parsed)).otherwise(lenient)


def _long(df: DataFrame, base: Sequence[str], cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row per (row, criterion), ``parsed`` null unless the cell is a map: the cells that are strict
    JSON or no map, and the others, which alone pay for the lenient reader."""
    def cells(keep: Column) -> DataFrame:
        each = F.array(*(F.struct(F.lit(c).alias("criteria"), _text(df, c).alias("cell"), _read(_text(df, c)).alias("parsed")) for c in cols))
        # filtered behind the generator, so that a cell is parsed once
        return df.select(*quoted(base), F.inline(each)).filter(keep)

    odd = F.coalesce(_braced(F.col("cell")) & F.col("parsed").isNull(), F.lit(False))
    strict = cells(~odd).withColumn("parsed", F.when(_is_map(F.col("cell"), F.col("parsed")), F.col("parsed")))
    return strict, cells(odd).withColumn("parsed", F.try_parse_json(lenient_text("cell")))


def _united(parts: Sequence[DataFrame], opened: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, map(opened, parts))


def melt_trips(df: DataFrame, base: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide trips to one row per (trip, criterion); a map keeps its canonical JSON text."""
    parsed = F.col("parsed")
    return _united(_long(df, base, cols), lambda long: long.select(
        *quoted(base), "criteria",
        F.when(parsed.isNull(), "H0D").otherwise(_map_dimension(parsed)).alias("dimension"),
        F.when(parsed.isNull(), F.col("cell")).otherwise(F.to_json("parsed")).alias("correspondant_value")))


def explode_drivers(df: DataFrame, base: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide drivers to one row per class. The dimension is that of each key, so a mixed map gives
    rows of both kinds; an empty map gives none; text that is no number gives a null value."""
    nested = F.col("leafA").startswith("{")
    scalar, flat = F.col("parsed").isNull(), F.col("leafA").isNotNull() & ~nested
    none = F.lit(NONE)

    def opened(long: DataFrame) -> DataFrame:
        outer = _open(long, F.col("parsed"), "keyA", "leafA", keep=True)
        inner = _open(outer, F.when(nested, F.col("__leafA")), "keyB", "leafB", keep=True)
        # what is neither is an entry of an inner map, or an empty map's lack of one
        return inner.filter(scalar | flat | F.col("keyB").isNotNull()).select(
            *quoted(base), "criteria",
            F.when(scalar, "H0D").when(flat, "H1D").otherwise("H2D").alias("dimension"),
            F.coalesce("keyA", none).alias("classA"), F.coalesce("keyB", none).alias("classB"), none.alias("classC"),
            F.when(scalar, as_number(F.col("cell"))).when(flat, _number(F.col("leafA")))
            .otherwise(_number(F.col("leafB"))).alias("correspondant_value"),
        )

    return _united(_long(df, base, cols), opened)


def class_dimension(a: Column, b: Column, c: Column) -> Column:
    """H3D, H2D, H1D or H0D by which leading classes are filled."""
    def filled(x: Column) -> Column:
        return ~F.lower(F.coalesce(x.cast("string"), F.lit(NONE))).isin(NONE, "")

    return (
        F.when(filled(a) & filled(b) & filled(c), "H3D")
        .when(filled(a) & filled(b), "H2D")
        .when(filled(a), "H1D")
        .otherwise("H0D")
    )


def matrix_boundaries(wrapper: Column) -> Column:
    """Header of a parsed matrix as one line of text."""
    def field(name: str, default: str) -> Column:
        return F.coalesce(F.try_variant_get(wrapper, f"$.{name}", "string"), F.lit(default))

    return F.format_string("x_axis=%s; y_axis=%s; x_bins=[%s]; y_bins=[%s]",
                           field("x_axis", "unknown"), field("y_axis", "unknown"), field("x_bins", ""), field("y_bins", ""))


def explode_matrix(df: DataFrame, json_col: str, ref: str, label: str) -> DataFrame:
    """Three-level matrices to long rows; branches that are no map and leaves that are no number
    are left out."""
    cell = F.col("cell")
    rows = df.select(F.col(quoted([ref])[0]).alias("Study_ref"), F.col(quoted([label])[0]).alias("Criteria_label"),
                     F.col(quoted([json_col])[0]).alias("cell")).withColumn("parsed", _read(cell))
    wrapper = F.col("parsed")
    # the header becomes text before the levels open, so no cell carries the document
    kept = ["Study_ref", "Criteria_label", "Dimensions_boudaries"]
    # in one pass: the lenient reader is given nulls for the cells that need none
    given = rows.withColumn("odd", F.when(wrapper.isNull() & _braced(cell), cell))
    level = given.withColumn("parsed", F.coalesce("parsed", F.try_parse_json(lenient_text("odd")))).select(
        *kept[:2], matrix_boundaries(wrapper).alias(kept[2]), F.try_variant_get(wrapper, "$.matrix", "variant").alias("value"))
    for name in ("ClassA", "ClassB", "ClassC"):
        # entries of an array have no key and are no branch
        level = _open(level, F.col("value"), name, "leaf").filter(F.col(name).isNotNull())
        kept.append(name)
        level = level.select(*kept, F.col("__leaf").alias("value"), "leaf")
    # through a generator, so that a number is read once and not again by the filter
    numbers = level.select(*kept, F.explode(F.array(_number(F.col("leaf")))).alias("Correspondant_value"))
    return numbers.filter(F.col("Correspondant_value").isNotNull()).select(
        "Study_ref", "Criteria_label",
        class_dimension(F.col("ClassA"), F.col("ClassB"), F.col("ClassC")).alias("Dimension"),
        "Dimensions_boudaries", "ClassA", "ClassB", "ClassC", "Correspondant_value",
    )


def _quoted(text: Column) -> Column:
    """Text as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def wrap_matrix(long: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Long rows back to one JSON text per (Study_ref, Criteria_label): the inverse of
    ``explode_matrix``. ``bounds`` gives axes and bins per study and label; H0D rows have no matrix.

    A matrix is one document, so its size is that of its classes, not of the data behind them. A null
    class is ``none``; a cell given twice is an error.
    """
    keys = ["Study_ref", "Criteria_label"]
    classes = ("ClassA", "ClassB", "ClassC")
    cells = long.filter(class_dimension(*(F.col(c) for c in classes)) != "H0D").withColumns(
        {c: F.coalesce(F.col(c), F.lit(NONE)) for c in classes})
    twice = F.raise_error(F.concat_ws("/", F.lit("a cell is given more than once:"), *keys, *classes))
    nested = cells.groupBy(*keys, *classes).agg(F.count(F.lit(1)).alias("times"), F.max("Correspondant_value").alias("inner"))
    nested = nested.withColumn("inner", F.when(F.col("times") > 1, twice.cast("double")).otherwise(F.col("inner"))).drop("times")
    nested = nested.withColumn("inner", number_json(F.col("inner").cast("double")))
    for name in ("ClassC", "ClassB", "ClassA"):
        above = {"ClassC": ["ClassA", "ClassB"], "ClassB": ["ClassA"], "ClassA": []}[name]
        entries = F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), F.col("inner").alias("v"))),
                               lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
        fields = F.transform(F.col("entries"), lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"]))
        nested = nested.groupBy(*keys, *above).agg(entries.alias("entries")).withColumn(
            "inner", F.concat(F.lit("{"), F.concat_ws(",", fields), F.lit("}"))).drop("entries")
    if bounds is not None:
        nested = nested.join(bounds, keys, "left")

    def field(name: str, default: str) -> Column:
        given = F.col(name) if bounds is not None and name in bounds.columns else F.lit(None).cast("string")
        return F.coalesce(given, F.lit(default)).alias(name)

    header = F.to_json(F.struct(field("x_axis", "unknown"), field("y_axis", "unknown"), field("x_bins", ""), field("y_bins", "")))
    wrapped = F.concat(F.rtrim(header, F.lit("}")), F.lit(',"matrix":'), F.col("inner"), F.lit("}"))
    return nested.select(*keys, wrapped.alias("dfmatrix"))


def parse_bins(spec: Column) -> Column:
    """``min=..;max=..;step=..`` as a struct of doubles."""
    parts = F.str_to_map(spec, F.lit(";"), F.lit("="))
    return F.struct(*(as_number(F.try_element_at(parts, F.lit(n))).alias(n) for n in ("min", "max", "step")))
