"""Upserts: every one is a function of the stored and the new table."""

from pyspark.sql import functions as F

from drivelaws.operators import merge as M

from .common import load, query

OLD_SQL = "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'"
NEW_SQL = "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice + 1 AS price, o_orderpriority AS priority FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"


def versions(spark, sf, keys=("k", "c")):
    """Stored and new orders: they overlap in time, and each has a column of its own."""
    o = load(spark, sf, "orders")
    ids = [F.col("o_orderkey").alias(keys[0]), F.col("o_custkey").alias(keys[1])]
    old = o.filter("o_orderdate < timestamp_ntz'1998-01-01'").select(
        *ids, F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    new = o.filter("o_orderdate >= timestamp_ntz'1996-01-01'").select(
        *ids, (F.col("o_totalprice") + 1).alias("price"), F.col("o_orderpriority").alias("priority"))
    return old, new


def merged_sql(price: str, k: str = "k", c: str = "c") -> str:
    return f"""SELECT k AS "{k}", c AS "{c}", {price} AS price, n.priority, o.status
FROM ({OLD_SQL}) o FULL JOIN ({NEW_SQL}) n USING (k, c)"""


@query("upsert_colmerge", merged_sql("n.price"))
def upsert_colmerge(spark, sf):
    return M.merge_columns(*versions(spark, sf), ["k", "c"])


@query("upsert_colmerge_keep", merged_sql("o.price"))
def upsert_colmerge_keep(spark, sf):
    return M.merge_columns(*versions(spark, sf), ["k", "c"], prefer="old")


@query("upsert_colmerge_fill", merged_sql("coalesce(n.price, o.price)"))
def upsert_colmerge_fill(spark, sf):
    return M.merge_columns(*versions(spark, sf), ["k", "c"], fill_nulls=True)


@query("upsert_colmerge_trip", merged_sql("n.price", "DRIVER_ID", "trip_id"))
def upsert_colmerge_trip(spark, sf):
    return M.merge_level(*versions(spark, sf, ("DRIVER_ID", "trip_id")), "Trip_id", overwrite=True)


@query("upsert_colmerge_driver", """
WITH o AS (SELECT o_custkey AS "DRIVER_ID", month(o_orderdate) AS "month", count(*) AS trips, max(o_totalprice) AS top
           FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
     n AS (SELECT o_custkey AS "DRIVER_ID", month(o_orderdate) AS "month", count(*) AS trips, min(o_totalprice) AS low
           FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
SELECT "DRIVER_ID", "month", o.trips, o.top, n.low FROM o FULL JOIN n USING ("DRIVER_ID", "month")""")
def upsert_colmerge_driver(spark, sf):
    o = load(spark, sf, "orders").withColumns({"DRIVER_ID": F.col("o_custkey"), "month": F.month("o_orderdate").cast("long")})
    keys = ["DRIVER_ID", "month"]
    old = o.filter("o_orderstatus <> 'P'").groupBy(*keys).agg(F.count(F.lit(1)).alias("trips"), F.max("o_totalprice").alias("top"))
    new = o.filter("o_orderstatus <> 'F'").groupBy(*keys).agg(F.count(F.lit(1)).alias("trips"), F.min("o_totalprice").alias("low"))
    return M.merge_level(old, new, "VIn")


INSIGHT = """
WITH o AS (SELECT p_brand AS study_title, p_type AS criteria, CAST(p_size AS VARCHAR) AS zone, max(p_retailprice) AS top
           FROM part WHERE p_size <= 30 GROUP BY 1, 2, 3),
     n AS (SELECT p_brand AS study_title, p_type AS criteria, CAST(p_size AS VARCHAR) AS zone, min(p_retailprice) AS top, count(*) AS parts
           FROM part WHERE p_size >= 10 GROUP BY 1, 2, 3)
SELECT study_title, criteria, zone, n.parts, {top}.top FROM o FULL JOIN n USING (study_title, criteria, zone)"""


def insight_versions(spark, sf):
    p = load(spark, sf, "part").select(
        F.col("p_brand").alias("study_title"), F.col("p_type").alias("criteria"), F.col("p_size").cast("string").alias("zone"),
        "p_size", "p_retailprice")
    keys = ["study_title", "criteria", "zone"]
    old = p.filter("p_size <= 30").groupBy(*keys).agg(F.max("p_retailprice").alias("top"))
    new = p.filter("p_size >= 10").groupBy(*keys).agg(F.min("p_retailprice").alias("top"), F.count(F.lit(1)).alias("parts"))
    return old, new


@query("upsert_colmerge_insights", INSIGHT.format(top="n"))
def upsert_colmerge_insights(spark, sf):
    return M.merge_level(*insight_versions(spark, sf), "insight_pfm", overwrite=True)


@query("upsert_level_dispatch", INSIGHT.format(top="o"))
def upsert_level_dispatch(spark, sf):
    return M.merge_level(*insight_versions(spark, sf), "insight_pfm")


SERIES_KEYS = ["Loan_Conducteur_ID", "VIN", "tcid_runid", "ID", "TIMESTAMP", "TEMPS"]
SERIES = """
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS "Loan_Conducteur_ID", 'V' AS "VIN", concat_ws('_', user_id, CAST(ts AS DATE)) AS tcid_runid,
           CAST(event_id AS VARCHAR) AS "ID", ts AS "TIMESTAMP", value AS "TEMPS", event_type, event_id FROM events),
     o AS (SELECT * FROM s WHERE event_type <> 'error'), n AS (SELECT * FROM s WHERE event_type <> 'view')
SELECT "Loan_Conducteur_ID", "VIN", tcid_runid, "ID", "TIMESTAMP", "TEMPS",
       CAST(n.event_id AS DOUBLE) AS "brake:C", CAST(n.event_id AS DOUBLE) AS "speed:R", o.event_type AS mode
FROM o FULL JOIN n USING ("Loan_Conducteur_ID", "VIN", tcid_runid, "ID", "TIMESTAMP", "TEMPS")"""


@query("upsert_timeseries", SERIES)
def upsert_timeseries(spark, sf):
    e = load(spark, sf, "events")
    day = F.to_date("ts").cast("string")
    keys = [F.col("user_id").cast("string").alias("Loan_Conducteur_ID"), F.lit("V").alias("VIN"),
            F.concat_ws("_", F.col("user_id").cast("string"), day).alias("tcid_runid"),
            F.col("event_id").cast("string").alias("ID"), F.col("ts").alias("TIMESTAMP"), F.col("value").alias("TEMPS")]
    signal = F.col("event_id")
    old = e.filter("event_type <> 'error'").select(*keys, (signal + 1).alias("speed:R"), F.col("event_type").alias("mode"))
    new = e.filter("event_type <> 'view'").select(*keys, signal.alias("speed:R"), signal.alias("brake:C"))
    return M.merge_timeseries(old, new, SERIES_KEYS, overwrite=True)


def ranked_sql(keys: str, new_rank: int) -> str:
    return f"""
SELECT {keys}, freq, unit FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rank, freq, unit) AS rk FROM (
    SELECT user_id, event_type AS signal, value AS freq, 'a' AS unit, {new_rank} AS rank FROM events WHERE event_type <> 'error'
    UNION ALL SELECT user_id, event_type, value + 1000, 'b', {3 - new_rank} FROM events WHERE event_type <> 'view')) WHERE rk = 1"""


def ranked_versions(spark, sf):
    e = load(spark, sf, "events")
    new = e.filter("event_type <> 'error'").select(
        "user_id", F.col("event_type").alias("signal"), F.col("value").alias("freq"), F.lit("a").alias("unit"))
    old = e.filter("event_type <> 'view'").select(
        "user_id", F.col("event_type").alias("signal"), (F.col("value") + 1000).alias("freq"), F.lit("b").alias("unit"))
    return old, new


@query("upsert_ranked_meta", ranked_sql("user_id, signal", 1))
def upsert_ranked_meta(spark, sf):
    return M.ranked_union(*ranked_versions(spark, sf), ["user_id", "signal"])


@query("win_rank_pick", ranked_sql("signal", 1))
def win_rank_pick(spark, sf):
    old, new = ranked_versions(spark, sf)
    return M.ranked_union(old.drop("user_id"), new.drop("user_id"), ["signal"])


@query("upsert_ranked_info", ranked_sql("user_id, signal", 2))
def upsert_ranked_info(spark, sf):
    return M.ranked_union(*ranked_versions(spark, sf), ["user_id", "signal"], prefer="old")


def replaced_sql(keys: str, columns: str, old: str, new: str) -> str:
    same = " AND ".join(f'x."{k}" = o."{k}"' for k in keys.split(","))
    return f"""
WITH o AS ({old}), n AS ({new})
SELECT {columns} FROM o WHERE NOT EXISTS (SELECT 1 FROM n x WHERE {same}) UNION ALL SELECT {columns} FROM n"""


TRIP_COLUMNS = '"DRIVER_ID", "TRIP_ID", criteria, correspondant_value'
TRIP = """SELECT CAST(user_id AS VARCHAR) AS "DRIVER_ID", CAST(dayofmonth(ts) AS DOUBLE) AS "TRIP_ID", event_type AS criteria,
  CAST({agg} AS VARCHAR) AS correspondant_value FROM events WHERE {where} GROUP BY 1, 2, 3"""


def trip_versions(spark, sf):
    e = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("DRIVER_ID"), F.dayofmonth("ts").cast("double").alias("TRIP_ID"),
        F.col("event_type").alias("criteria"))
    keys = ["DRIVER_ID", "TRIP_ID", "criteria"]

    def rows(part, value):
        return part.groupBy(*keys).agg(value.cast("string").alias("correspondant_value"))

    return rows(e.filter("TRIP_ID <= 20"), F.count(F.lit(1))), rows(e.filter("TRIP_ID >= 10"), F.count(F.lit(1)) + 100)


@query("upsert_trip_insights", replaced_sql(
    "DRIVER_ID,TRIP_ID,criteria", TRIP_COLUMNS, TRIP.format(agg="count(*)", where="dayofmonth(ts) <= 20"),
    TRIP.format(agg="count(*) + 100", where="dayofmonth(ts) >= 10")))
def upsert_trip_insights(spark, sf):
    old, new = trip_versions(spark, sf)
    stamped = [M.stamp_insights(part, "study") for part in (old, new)]
    return M.merge_insights(*stamped, M.TRIP_KEYS, overwrite=True).drop("dt", "study_title")


DRIVER_COLUMNS = '"DRIVER_ID", "month", "year", criteria, correspondant_value'
DRIVER = """SELECT CAST(o_custkey AS VARCHAR) AS "DRIVER_ID", CAST(month(o_orderdate) AS INTEGER) AS "month", CAST(year(o_orderdate) AS INTEGER) AS "year",
  o_orderpriority AS criteria, {agg} AS correspondant_value FROM orders WHERE {where} GROUP BY 1, 2, 3, 4"""


@query("upsert_driver_insights", replaced_sql(
    "DRIVER_ID,month,year,criteria", DRIVER_COLUMNS, DRIVER.format(agg="max(o_totalprice)", where="o_orderdate < TIMESTAMP '1998-01-01'"),
    DRIVER.format(agg="min(o_totalprice)", where="o_orderdate >= TIMESTAMP '1997-01-01'")))
def upsert_driver_insights(spark, sf):
    o = load(spark, sf, "orders").withColumns({
        "DRIVER_ID": F.col("o_custkey").cast("string"), "month": F.month("o_orderdate"), "year": F.year("o_orderdate"),
        "criteria": F.col("o_orderpriority")})
    old = o.filter("o_orderdate < timestamp_ntz'1998-01-01'").groupBy(*M.DRIVER_KEYS).agg(F.max("o_totalprice").alias("correspondant_value"))
    new = o.filter("o_orderdate >= timestamp_ntz'1997-01-01'").groupBy(*M.DRIVER_KEYS).agg(F.min("o_totalprice").alias("correspondant_value"))
    stamped = [M.stamp_insights(part, "study") for part in (old, new)]
    return M.merge_insights(*stamped, M.DRIVER_KEYS, overwrite=True).drop("dt", "study_title")


STUDY = """SELECT p_brand AS "Study_ref", p_type AS "Criteria_label", {agg} AS parts FROM part WHERE {where} GROUP BY 1, 2"""


def study_versions(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_brand").alias("Study_ref"), F.col("p_type").alias("Criteria_label"), "p_size")
    old = p.groupBy("Study_ref", "Criteria_label").agg(F.count(F.lit(1)).alias("parts"))
    new = p.filter("Study_ref < 'Brand#2'").groupBy("Study_ref", "Criteria_label").agg(F.sum("p_size").alias("parts"))
    return old, new


@query("upsert_pfm", replaced_sql(
    "Study_ref", '"Study_ref", "Criteria_label", parts', STUDY.format(agg="count(*)", where="true"),
    STUDY.format(agg="CAST(sum(p_size) AS BIGINT)", where="p_brand < 'Brand#2'")))
def upsert_pfm(spark, sf):
    old, new = (M.stamp_study(part) for part in study_versions(spark, sf))
    return M.merge_studies(old, new, overwrite=True).drop("Creation_date", "Modification_date")


@query("sink_idcard", """
SELECT CAST(user_id AS VARCHAR) AS "Loan_Conducteur_ID", 'old' AS "VIN", event_type AS "KPI_Name", max(value) AS value
FROM events WHERE user_id <> 8 GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT '8', 'V8', event_type, value FROM events WHERE user_id = 8""")
def sink_idcard(spark, sf):
    e = load(spark, sf, "events")
    stored = e.groupBy(F.col("user_id").cast("string").alias("Loan_Conducteur_ID"), F.lit("old").alias("VIN"),
                       F.col("event_type").alias("KPI_Name")).agg(F.max("value").alias("value"))
    cards = e.filter("user_id = 8").select(F.col("event_type").alias("KPI_Name"), "value")
    return M.replace_id_cards(stored, cards, "8", "V8")
