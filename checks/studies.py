"""Study records: one study per order, its lines as the population."""

from pyspark.sql import functions as F

from drivelaws.operators import study as Y
from drivelaws.operators.projections import first_model_row
from drivelaws.operators.reshape import wrap_matrix

from .common import load, query


def headers(spark, sf):
    o, lines = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    status = F.col("o_orderstatus")
    criteria = o.select(
        F.col("o_orderkey").alias("study"), F.concat(F.lit("  ["), status, F.lit("] study ")).alias("Study_title"),
        F.col("o_orderpriority").alias("Criteria_label"), F.lit("orders").alias("Criteria_description"),
        F.when(status == "P", "H4D").when(status == "F", "H0D").otherwise("H1D").alias("dimension"), F.lit("7y").alias("Norm_applied"))
    # an order has a handful of lines
    population = lines.groupBy(F.col("l_orderkey").alias("study")).agg(
        F.array_sort(F.collect_list("l_suppkey")).alias("vins"), F.lit("BEV").alias("Energy_category"),
        F.lit("D").alias("Segment"), F.lit("Europe").alias("region_country"))
    sources = o.select(
        F.col("o_orderkey").alias("study"), F.lit("TPC").alias("Data_source"),
        F.array(F.lit("speed:R"), status).alias("signals"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("start_date"), F.lit("").alias("end_date"))
    return Y.study_header(criteria, population, sources)


BODY = """
SELECT o_orderkey AS study, '[' || o_orderstatus || '] study' AS "Study_title", '' AS "Criteria_ref", o_orderpriority AS "Criteria_label",
  'orders' AS "Criteria_description", CASE o_orderstatus WHEN 'P' THEN 'H4D' WHEN 'F' THEN 'H0D' ELSE 'H1D' END AS dimension, '7y' AS "Norm_applied",
  CASE WHEN v IS NULL THEN NULL ELSE 'BEV' END AS "Energy_category", CASE WHEN v IS NULL THEN NULL ELSE 'D' END AS "Segment",
  CASE WHEN v IS NULL THEN NULL ELSE 'Europe' END AS "region_country", 'TPC' AS "Data_source", v AS "Vin_list",
  strftime(o_orderdate, '%d/%m/%Y') AS "Period_date_start", NULL::VARCHAR AS "Period_date_end", 'speed:R,' || o_orderstatus AS "List_of_signal_names"
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


@query("study_header", BODY)
def study_header(spark, sf):
    return headers(spark, sf)


@query("study_attach_model", f"""
WITH m AS (SELECT o_orderpriority AS criteria, min(o_custkey) AS lo, max(o_custkey) AS hi, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT h.*, CASE WHEN m.criteria IS NULL THEN '[]' ELSE '[' || CAST(CAST(lo AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(hi AS DOUBLE) AS VARCHAR) || ','
    || CAST(CAST(n AS DOUBLE) AS VARCHAR) || ']' END AS "Final_stats_min_max_moyenne",
  CASE WHEN m.criteria IS NULL THEN NULL ELSE 'normal' END AS loi, CASE WHEN m.criteria IS NULL THEN NULL ELSE '{{}}' END AS parameters,
  NULL::INTEGER AS class_index, CAST(n AS DOUBLE) AS "R2", CAST(lo AS DOUBLE) AS "client1pct", CAST(hi AS DOUBLE) AS "client50pct",
  NULL::DOUBLE AS "client99pct", NULL::DOUBLE AS "sample_client1pct", NULL::DOUBLE AS "sample_client50pct", NULL::DOUBLE AS "sample_client99pct"
FROM ({BODY}) h LEFT JOIN m ON h."Criteria_label" = m.criteria""")
def study_attach_model(spark, sf):
    models = load(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("criteria")).agg(
        F.min("o_custkey").alias("data_min"), F.max("o_custkey").alias("data_max"), F.count(F.lit(1)).alias("data_mean"),
        F.lit("normal").alias("loi"), F.lit("{}").alias("parameters"), F.lit("Estimation").alias("class_index"),
        F.count(F.lit(1)).alias("R2"), F.min("o_custkey").alias("client1%"), F.max("o_custkey").cast("string").alias("client50%"),
        F.lit("NA").alias("client99%"))
    return Y.attach_model(headers(spark, sf), first_model_row(models))


@query("study_attach_matrix", f"""
WITH c AS (SELECT l_orderkey, l_returnflag AS a, l_linestatus AS b, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
c1 AS (SELECT l_orderkey, a, string_agg('"' || b || '":{{"none":' || CAST(q AS VARCHAR) || '}}', ',' ORDER BY b) AS t FROM c GROUP BY 1, 2),
m AS (SELECT l_orderkey, '{{"x_axis":"unknown","y_axis":"unknown","x_bins":"","y_bins":"","matrix":{{'
        || string_agg('"' || a || '":{{' || t || '}}', ',' ORDER BY a) || '}}}}' AS dfmatrix FROM c1 GROUP BY 1)
SELECT h.*, CASE WHEN dimension = 'H0D' THEN NULL ELSE dfmatrix END AS dfmatrix FROM ({BODY}) h LEFT JOIN m ON l_orderkey = study""")
def study_attach_matrix(spark, sf):
    long = load(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").cast("string").alias("Study_ref"), F.lit("lines").alias("Criteria_label"),
        F.col("l_returnflag").alias("ClassA"), F.col("l_linestatus").alias("ClassB"), F.lit("none").alias("ClassC")).agg(
        F.sum("l_quantity").alias("Correspondant_value"))
    matrices = wrap_matrix(long).select(F.col("Study_ref").cast("long").alias("study"), "dfmatrix")
    return Y.attach_matrix(headers(spark, sf), matrices)


ERRORS = f"""
SELECT study, concat_ws('|',
  CASE WHEN dimension = 'H4D' THEN 'E3 unknown dimension: H4D' END,
  CASE WHEN "Vin_list" IS NULL THEN 'E2 no vehicle listed' END,
  CASE WHEN "Energy_category" IS NULL THEN 'E4 no value for: Energy_category' END,
  CASE WHEN "Segment" IS NULL THEN 'E4 no value for: Segment' END,
  CASE WHEN "region_country" IS NULL THEN 'E4 no value for: region_country' END,
  CASE WHEN "Vin_list" IS NULL THEN 'E4 no value for: Vin_list' END) AS errors FROM ({BODY})"""


@query("study_validate", ERRORS)
def study_validate(spark, sf):
    return Y.validate(headers(spark, sf)).select("study", F.array_join("errors", "|").alias("errors"))


@query("study_build", f"SELECT b.* FROM ({BODY}) b JOIN ({ERRORS}) v USING (study) WHERE errors = ''")
def study_build(spark, sf):
    return Y.build(headers(spark, sf))[0]


@query("study_rejected", f"SELECT * FROM ({ERRORS}) WHERE errors <> ''")
def study_rejected(spark, sf):
    return Y.build(headers(spark, sf))[1].select("study", F.array_join("errors", "|").alias("errors"))
