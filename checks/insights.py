"""Reshapes, matrices and publication."""

from pyspark.sql import functions as F

from drivelaws.operators import reshape as H
from drivelaws.plans.insights import store_insights

from .common import load, new_store, query

DAY = "CAST(CAST(ts AS DATE) AS VARCHAR)"


def trips(spark, sf):
    """Events as wide trips: a map, a number and a text criterion."""
    return load(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("DRIVER_ID"), F.to_date("ts").cast("string").alias("day"),
        "props", "value", F.col("event_type").alias("kind"))


@query("melt_trips", f"""
SELECT event_id, CAST(user_id AS VARCHAR) AS "DRIVER_ID", {DAY} AS day, 'props' AS criteria, 'H1D' AS dimension, CAST(json(props) AS VARCHAR) AS correspondant_value FROM events
UNION ALL SELECT event_id, CAST(user_id AS VARCHAR), {DAY}, 'kind', 'H0D', event_type FROM events""")
def melt_trips(spark, sf):
    return H.melt_trips(trips(spark, sf), ["event_id", "DRIVER_ID", "day"], ["props", "kind"])


CELL = """CASE l_returnflag WHEN 'A' THEN '{"a":{"b":1}}' WHEN 'N' THEN '{"n":' || l_linenumber || '}' ELSE CAST(l_linenumber AS VARCHAR) END"""


@query("detect_cell_dimension", """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'H2D' WHEN 'N' THEN 'H1D' ELSE 'H0D' END AS dimension FROM lineitem""")
def detect_cell_dimension(spark, sf):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber").cast("string")
    cell = (F.when(flag == "A", '{"a":{"b":1}}').when(flag == "N", F.concat(F.lit('{"n":'), line, F.lit("}"))).otherwise(line))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", H.cell_dimension(cell).alias("dimension"))


@query("explode_drivers", """
SELECT event_id, 'props' AS criteria, 'H1D' AS dimension, 'k' AS "classA", 'none' AS "classB", 'none' AS "classC",
       CAST(json_extract(props, '$.k') AS DOUBLE) AS correspondant_value FROM events
UNION ALL SELECT event_id, 'mixed', 'H1D', event_type, 'none', 'none', value FROM events
UNION ALL SELECT event_id, 'mixed', 'H2D', 'user', CAST(user_id AS VARCHAR), 'none', 1.0 FROM events
UNION ALL SELECT event_id, 'value', 'H0D', 'none', 'none', 'none', value FROM events
UNION ALL SELECT event_id, 'kind', 'H0D', 'none', 'none', 'none', NULL FROM events""")
def explode_drivers(spark, sf):
    mixed = F.format_string('{"%s":%s,"user":{"%s":1}}', F.col("kind"), F.col("value").cast("string"), F.col("DRIVER_ID"))
    return H.explode_drivers(trips(spark, sf).withColumn("mixed", mixed), ["event_id"], ["props", "mixed", "value", "kind"])


# base columns derived from an event, by name: what the check says and what the query says
EVENT_TRIP = {
    "DRIVER_ID": ("CAST(user_id AS VARCHAR)", "CAST(user_id AS STRING)"), "VIN": ("'V' || user_id", "concat('V', user_id)"),
    "TRIP_ID": ("CAST(event_id AS DOUBLE)", "event_id"), "month": ("CAST(month(ts) AS INTEGER)", "month(ts)"),
    "year": ("CAST(year(ts) AS INTEGER)", "year(ts)"), "trip_start": ("ts", "ts"), "trip_end": ("ts + INTERVAL 1 HOUR", "ts + INTERVAL 1 HOUR"),
    "duration_trip_h": ("1.0::DOUBLE", "'1.0'"), "distance_trip_integral_km": ("value", "CAST(value AS STRING)"),
    "sum_distance_CITY_km": ("value / 2", "value / 2"), "sum_distance_ROAD_km": ("value / 4", "value / 4"),
    "sum_distance_HIGHWAY_km": ("value / 4", "value / 4"), "trip_quality_flag": ("CAST(user_id % 2 AS INTEGER)", "user_id % 2"),
}
EVENT_DRIVER = {
    **{k: EVENT_TRIP[k] for k in ("DRIVER_ID", "VIN", "month", "year")}, "first_trip": EVENT_TRIP["trip_start"], "last_trip": EVENT_TRIP["trip_end"],
    "total_trips": ("CAST(event_id % 7 AS INTEGER)", "event_id % 7"), "valid_trips": EVENT_TRIP["trip_quality_flag"],
    "dist_tot_integ_km": EVENT_TRIP["distance_trip_integral_km"], "total_duration_h": EVENT_TRIP["duration_trip_h"],
    "sum_distance_driver_year_month_CITY_km": EVENT_TRIP["sum_distance_CITY_km"],
    "sum_distance_driver_year_month_ROAD_km": EVENT_TRIP["sum_distance_ROAD_km"],
    "sum_distance_driver_year_month_HIGHWAY_km": EVENT_TRIP["sum_distance_HIGHWAY_km"], "valid_client": ("1::INTEGER", "'1'"),
}


def wide(spark, sf, base):
    """Events with the base columns, some still text, and their criteria."""
    return load(spark, sf, "events").select(*(F.expr(c).alias(n) for n, (_, c) in base.items()), "props", "value", F.col("event_type").alias("kind"))


def base_sql(base):
    return ", ".join(f'{text} AS "{name}"' for name, (text, _) in base.items())


@query("schema_trips", f"""
SELECT {base_sql(EVENT_TRIP)}, 'props' AS criteria, 'H1D' AS dimension, CAST(json(props) AS VARCHAR) AS correspondant_value FROM events
UNION ALL SELECT {base_sql(EVENT_TRIP)}, 'kind', 'H0D', event_type FROM events""")
def schema_trips(spark, sf):
    return H.conform(H.melt_trips(wide(spark, sf, EVENT_TRIP), list(EVENT_TRIP), ["props", "kind"]), H.schema_trips())


@query("schema_drivers", f"""
SELECT {base_sql(EVENT_DRIVER)}, 'props' AS criteria, 'H1D' AS dimension, 'k' AS "classA", 'none' AS "classB",
  'none' AS "classC", CAST(json_extract(props, '$.k') AS DOUBLE) AS correspondant_value FROM events
UNION ALL SELECT {base_sql(EVENT_DRIVER)}, 'value', 'H0D', 'none', 'none', 'none', value FROM events""")
def schema_drivers(spark, sf):
    return H.conform(H.explode_drivers(wide(spark, sf, EVENT_DRIVER), list(EVENT_DRIVER), ["props", "value"]), H.schema_drivers())


CELLS = """SELECT l_returnflag AS "ClassA", l_linestatus AS "ClassB", CAST(year(l_shipdate) AS VARCHAR) AS "ClassC", count(*) AS c FROM lineitem GROUP BY 1, 2, 3"""


def cells(spark, sf):
    """Line counts by flag, status and year, as one matrix."""
    return load(spark, sf, "lineitem").groupBy(
        F.lit("R1").alias("Study_ref"), F.lit("lines").alias("Criteria_label"), F.col("l_returnflag").alias("ClassA"),
        F.col("l_linestatus").alias("ClassB"), F.year("l_shipdate").cast("string").alias("ClassC")).agg(
        F.count(F.lit(1)).cast("double").alias("Correspondant_value"))


def bounds(spark, sf):
    return load(spark, sf, "lineitem").agg(
        F.lit("R1").alias("Study_ref"), F.lit("lines").alias("Criteria_label"), F.lit("flag").alias("x_axis"),
        F.concat(F.lit("min=0;max="), F.max("l_linenumber").cast("string"), F.lit(";step=1")).alias("x_bins"))


BOUNDARY = "'x_axis=flag; y_axis=unknown; x_bins=[min=0;max=' || (SELECT max(l_linenumber) FROM lineitem) || ';step=1]; y_bins=[]'"


@query("explode_matrix", f"""
SELECT 'R1' AS "Study_ref", 'lines' AS "Criteria_label", 'H3D' AS "Dimension", {BOUNDARY} AS "Dimensions_boudaries",
       "ClassA", "ClassB", "ClassC", CAST(c AS DOUBLE) AS "Correspondant_value" FROM ({CELLS})""")
def explode_matrix(spark, sf):
    wrapped = H.wrap_matrix(cells(spark, sf), bounds(spark, sf))
    return H.explode_matrix(wrapped, "dfmatrix", "Study_ref", "Criteria_label")


@query("explode_matrix_rows", """
SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS "Study_ref", l_returnflag AS "Criteria_label", 'H2D' AS "Dimension",
       'x_axis=unknown; y_axis=unknown; x_bins=[]; y_bins=[]' AS "Dimensions_boudaries", l_linestatus AS "ClassA",
       CAST(l_suppkey AS VARCHAR) AS "ClassB", 'none' AS "ClassC", l_quantity AS "Correspondant_value" FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber, l_returnflag, 'H3D', 'x_axis=unknown; y_axis=unknown; x_bins=[]; y_bins=[]', l_linestatus,
       CAST(l_suppkey AS VARCHAR), 'n', 'NaN'::DOUBLE FROM lineitem WHERE l_linenumber = 7""")
def explode_matrix_rows(spark, sf):
    """One matrix per line, with branches and leaves that have to be left out, bare NaN and repeated keys."""
    odd = F.when(F.col("l_linenumber") == 7, ',"n":NaN').when(F.col("l_linenumber") == 6, ',"none":-1,"none":"%s"').otherwise("")
    odd = F.replace(odd, F.lit("%s"), F.col("l_quantity").cast("string"))
    text = F.format_string('{"matrix":{"%s":{"%s":{"none":"%s","bad":"x","worse":"12f"%s},"flat":1},"flat":2}}',
                           F.col("l_linestatus"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string"), odd)
    rows = load(spark, sf, "lineitem").select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ref"),
        "l_returnflag", text.alias("m"))
    return H.explode_matrix(rows, "m", "ref", "l_returnflag")


@query("matrix_boundaries", f"SELECT 'R1' AS \"Study_ref\", {BOUNDARY} AS text")
def matrix_boundaries(spark, sf):
    wrapped = H.wrap_matrix(cells(spark, sf), bounds(spark, sf))
    return wrapped.select("Study_ref", H.matrix_boundaries(F.try_parse_json("dfmatrix")).alias("text"))


@query("matrix_wrap", f"""
WITH c AS ({CELLS}),
c2 AS (SELECT "ClassA", "ClassB", string_agg('"' || "ClassC" || '":' || CAST(CAST(c AS DOUBLE) AS VARCHAR), ',' ORDER BY "ClassC") AS t FROM c GROUP BY 1, 2),
c1 AS (SELECT "ClassA", string_agg('"' || "ClassB" || '":{{' || t || '}}', ',' ORDER BY "ClassB") AS t FROM c2 GROUP BY 1)
SELECT 'R1' AS "Study_ref", 'lines' AS "Criteria_label", '{{"x_axis":"flag","y_axis":"unknown","x_bins":"min=0;max='
  || (SELECT max(l_linenumber) FROM lineitem) || ';step=1","y_bins":"","matrix":{{' || string_agg('"' || "ClassA" || '":{{' || t || '}}', ',' ORDER BY "ClassA")
  || '}}}}' AS dfmatrix FROM c1""")
def matrix_wrap(spark, sf):
    return H.wrap_matrix(cells(spark, sf), bounds(spark, sf))


@query("class_dimension", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'H0D' WHEN l_linestatus = 'O' THEN 'H1D' WHEN l_linenumber > 3 THEN 'H2D' ELSE 'H3D' END AS dimension
FROM lineitem""")
def class_dimension(spark, sf):
    a = F.when(F.col("l_returnflag") == "N", "None").otherwise(F.col("l_returnflag"))
    b = F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))
    c = F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber").cast("string"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", H.class_dimension(a, b, c).alias("dimension"))


@query("parse_bin_spec", """
SELECT p_partkey, CAST(-p_size AS DOUBLE) AS "min", p_retailprice AS "max", CASE WHEN p_size > 25 THEN 5.0::DOUBLE END AS step FROM part""")
def parse_bin_spec(spark, sf):
    step = F.when(F.col("p_size") > 25, "5").otherwise("wide")
    spec = F.concat(F.lit("min=-"), F.col("p_size").cast("string"), F.lit(";max="), F.col("p_retailprice").cast("string"), F.lit(";step="), step)
    return load(spark, sf, "part").select("p_partkey", H.parse_bins(spec).alias("b")).select("p_partkey", "b.*")


@query("store_dispatch", """
SELECT p_brand AS "Study_title", p_type AS "ClassA", CAST(p_size AS VARCHAR) AS "ClassB", 'none' AS "ClassC", 'H2D' AS "Dimension",
       CAST(count(*) AS DOUBLE) AS "Correspondant_value" FROM part GROUP BY 1, 2, 3""")
def store_dispatch(spark, sf):
    """Studies with their matrices published twice with overwrite: the second replaces the first."""
    long = load(spark, sf, "part").groupBy(
        F.col("p_brand").alias("Study_ref"), F.lit("parts").alias("Criteria_label"), F.col("p_type").alias("ClassA"),
        F.col("p_size").cast("string").alias("ClassB"), F.lit("none").alias("ClassC")).agg(
        F.count(F.lit(1)).cast("double").alias("Correspondant_value"))
    records = H.wrap_matrix(long).withColumnRenamed("Study_ref", "Study_title")
    store, database = new_store(spark)
    tables = {"table": f"{database}.studies", "matrix_table": f"{database}.cells"}
    for _ in range(2):
        store_insights(records, "PFM", store, overwrite=True, **tables)
    main = store.read(tables["table"]).select("Study_ref", "Study_title")
    return main.join(store.read(tables["matrix_table"]), "Study_ref").select(
        "Study_title", "ClassA", "ClassB", "ClassC", "Dimension", "Correspondant_value")
