"""State periods, signal figures and partition sizing."""

from pyspark.sql import functions as F

from drivelaws.operators import kpis as K
from drivelaws.operators import sizing as Z
from drivelaws.operators.runs import state_runs

from .common import load, query, rounded, sig, sqlsig


RUNS = """
WITH v AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 WHEN event_type = 'error' THEN 0 END AS v FROM events),
z AS (SELECT *, count(*) FILTER (v = 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM v WHERE v IS NOT NULL),
t AS (SELECT user_id, max(run) AS last FROM z GROUP BY 1),
r AS (SELECT user_id, run, min(ts) AS a, max(ts) AS b, count(*) AS n FROM z WHERE v = 1 GROUP BY 1, 2),
st AS (SELECT *, count(*) FILTER (n >= 2) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stretch FROM r),
ps AS (SELECT *, row_number() OVER (PARTITION BY user_id, stretch ORDER BY run) AS pos FROM st),
pr AS (SELECT user_id, stretch, (pos - 1) // 2 AS pair, min(a) AS a, max(b) AS b, sum(n) AS n, max(run) AS run FROM ps GROUP BY 1, 2, 3)
SELECT user_id, a AS "start", b AS "end", date_diff('microsecond', a, b) / 1e6 AS duree
FROM pr JOIN t USING (user_id) WHERE n >= 2 AND run < last"""


def on_off(spark, sf):
    kind = F.col("event_type")
    state = F.when(kind.isin("click", "view", "purchase"), 1.0).when(kind == "error", 0.0)
    return load(spark, sf, "events").withColumn("state", state)


@query("win_state_runs", RUNS)
def win_state_runs(spark, sf):
    return state_runs(on_off(spark, sf), "state", ["ts", "event_id"], ["user_id"])


@query("win_state_runs_hot", RUNS)
def win_state_runs_hot(spark, sf):
    """In pieces, as trips too large for one task are read; here nearly all trips have several."""
    return state_runs(on_off(spark, sf), "state", ["ts", "event_id"], ["user_id"], piece_rows=20)


PS = {"P1": 0.01, "P10": 0.1, "P25": 0.25, "P50": 0.5, "P75": 0.75, "P90": 0.9, "P99": 0.99}


def kpi_sql(keys: str) -> str:
    return f"""
SELECT {keys}, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS "DUREE", count(*) AS "COUNT", {sqlsig('avg(value)', 9)} AS "MEAN",
  {sqlsig('stddev_samp(value)', 9)} AS "STD", min(value) AS "MIN", max(value) AS "MAX", arg_min(value, (ts, event_id)) AS "FIRST",
  arg_max(value, (ts, event_id)) AS "LAST", {", ".join(f'{sqlsig(f"quantile_cont(value, {p})", 9)} AS "{n}"' for n, p in PS.items())}
FROM (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) GROUP BY {keys}"""


@query("agg_signal_kpis", kpi_sql("user_id, day, event_type"))
def agg_signal_kpis(spark, sf):
    events = load(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    by = ["user_id", "day", "event_type"]
    return rounded(K.signal_kpis(events, by, "value", ["ts", "event_id"]), (*by, "DUREE", "COUNT", "MIN", "MAX", "FIRST", "LAST"), 9)


@query("agg_signal_kpis_hot", kpi_sql("event_type"))
def agg_signal_kpis_hot(spark, sf):
    kpis = K.signal_kpis(load(spark, sf, "events"), ["event_type"], "value", ["ts", "event_id"], gather=500)
    return rounded(kpis, ("event_type", "DUREE", "COUNT", "MIN", "MAX", "FIRST", "LAST"), 9)


@query("agg_dim_counts", """SELECT CASE WHEN json_type(props) = 'OBJECT' THEN 'H1D' ELSE 'H0D' END AS "Dimension", count(*) AS "count" FROM events GROUP BY 1""")
def agg_dim_counts(spark, sf):
    from drivelaws.operators.reshape import cell_dimension
    return K.dimension_counts(load(spark, sf, "events").select(cell_dimension(F.col("props")).alias("Dimension")))


TEXT = """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || CAST(c_acctbal AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '"}'"""


@query("agg_data_size", f"SELECT count(*) AS rows, CAST(sum(length({TEXT})) AS BIGINT) AS bytes FROM customer")
def agg_data_size(spark, sf):
    return Z.data_size(load(spark, sf, "customer"), by="text")


@query("agg_data_size_assumed", "SELECT count(*) AS rows, count(*) * (8 + 50 + 8 + 8 + 50) AS bytes FROM customer")
def agg_data_size_assumed(spark, sf):
    return Z.data_size(load(spark, sf, "customer"), by="width")


@query("suggest_partitions", f"""
SELECT rows, bytes, {sqlsig('bytes / 1073741824.0')} AS size_gb, 100 AS executors, 400 AS total_cores, 3200.0::DOUBLE AS total_memory_gb,
  CAST(floor(bytes / 134217728.0) AS INTEGER) AS data_partitions, 1200 AS core_partitions, 15360 AS memory_partitions,
  CAST(greatest(200, least(least(greatest(floor(bytes / 134217728.0), 1200), 15360), 10000)) AS INTEGER) AS partitions
FROM (SELECT count(*) AS rows, CAST(sum(length({TEXT})) AS BIGINT) AS bytes FROM customer)""")
def suggest_partitions(spark, sf):
    conf = {"spark.executor.instances": "100", "spark.executor.cores": "4", "spark.executor.memory": "32g"}
    report = Z.suggest_partitions(load(spark, sf, "customer"), conf, by="text")
    return report.withColumn("size_gb", sig("size_gb"))
