"""Sources, projections, filters, joins and set operations."""

from pyspark.sql import functions as F

from drivelaws.operators import projections as P
from drivelaws.operators.kpis import distinct_on
from drivelaws.operators.merge import left_fold, merge_columns, merge_cycles
from drivelaws.operators.sample import positive
from drivelaws.plans.insights import store_cycles
from drivelaws.sources import read as R
from drivelaws.sources.store import cut_lineage, write_csv, write_parquet

from .common import load, new_store, query, scratch

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("src_parquet", f"SELECT {ORDERS} FROM orders")
def src_parquet(spark, sf):
    return R.read_parquet(spark, f"{sf}/orders.parquet")


@query("src_match_files", """
SELECT r_regionkey, r_name, NULL::INTEGER AS n_nationkey, NULL::VARCHAR AS n_name, NULL::BIGINT AS conv_id, NULL::VARCHAR AS role FROM region
UNION ALL SELECT NULL, NULL, n_nationkey, n_name, NULL, NULL FROM nation
UNION ALL SELECT NULL, NULL, NULL, NULL, conv_id, role FROM conversations""")
def src_match_files(spark, sf):
    """Three files of the folder, of different columns, have these letters in their names."""
    return R.read_matching(spark, sf, "io").select("r_regionkey", "r_name", "n_nationkey", "n_name", "conv_id", "role")


@query("src_union_evolving", """
SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status, NULL::VARCHAR AS priority FROM orders
UNION ALL SELECT o_orderkey, NULL, o_orderstatus, o_orderpriority FROM orders
UNION ALL SELECT c_custkey, c_acctbal, NULL, NULL FROM customer""")
def src_union_evolving(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    return R.union_evolving([
        o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")),
        o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")),
        c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("price")),
    ])


@query("src_table", "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 8 AND event_type = 'click'")
def src_table(spark, sf):
    load(spark, sf, "events").createOrReplaceTempView("stored_events")
    return R.read_slice(spark, "stored_events", user_id=8, event_type="click").select(
        "event_id", "user_id", "event_type", "value")


@query("src_table_exists", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def src_table_exists(spark, sf):
    events = load(spark, sf, "events")
    events.createOrReplaceTempView("stored_events")
    found = spark.table("stored_events") if R.table_exists(spark, "stored_events") else events.limit(0)
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("src_records", """
SELECT r.freq, count(*) AS n FROM events e JOIN
(VALUES ('click', 10.0::DOUBLE), ('view', 10.0::DOUBLE), ('error', 1.0::DOUBLE)) r(signal, freq) ON e.event_type = r.signal
GROUP BY 1""")
def src_records(spark, sf):
    known = R.records(spark, [("click", 10.0), ("view", 10.0), ("error", 1.0)], "signal string, freq double")
    events = load(spark, sf, "events").withColumnRenamed("event_type", "signal")
    return events.join(known, "signal").groupBy("freq").agg(F.count(F.lit(1)).alias("n"))


@query("src_csv_registry", """
SELECT event_type AS "Signal", CAST(count(*) AS VARCHAR) AS "Frequence" FROM events GROUP BY 1""")
def src_csv_registry(spark, sf):
    folder = f"{scratch(spark)}/registry"
    registry = load(spark, sf, "events").groupBy("event_type").count().toDF("Signal", "Frequence")
    write_csv(registry, folder)
    return R.read_registry(spark, folder)


@query("sink_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def sink_csv(spark, sf):
    folder = f"{scratch(spark)}/customers"
    write_csv(load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), folder)
    return spark.read.csv(folder, sep=";", header=True, schema="c_custkey string, c_name string, c_mktsegment string")


@query("sink_parquet_overwrite", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sink_parquet_overwrite(spark, sf):
    folder = f"{scratch(spark)}/customers"
    write_parquet(load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), folder)
    return spark.read.parquet(folder)


@query("lineage_cut", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def lineage_cut(spark, sf):
    return cut_lineage(load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))


@query("registry_append", """
SELECT event_type AS "Signal", CAST(count(*) AS VARCHAR) AS "Frequence" FROM events GROUP BY 1
UNION ALL SELECT 'page', CAST(count(*) AS VARCHAR) FROM pages""")
def registry_append(spark, sf):
    registry = R.registry_append(None, load(spark, sf, "events").groupBy("event_type").count().toDF("Signal", "Frequence"))
    pages = load(spark, sf, "pages").agg(F.lit("page").alias("Signal"), F.count(F.lit(1)).alias("Frequence"))
    return R.registry_append(registry, pages)


@query("proj_add_constants", "SELECT event_id, value, 'L1' AS loan, 7 AS campaign FROM events")
def proj_add_constants(spark, sf):
    return P.add_constants(load(spark, sf, "events").select("event_id", "value"), loan="L1", campaign=7)


@query("proj_keys_first", "SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice FROM orders")
def proj_keys_first(spark, sf):
    return P.keys_first(load(spark, sf, "orders"), ["o_orderkey", "o_custkey"])


@query("proj_cast_by_name", """
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS "part:R", CAST(l_suppkey AS DOUBLE) AS "supplier:C" FROM lineitem""")
def proj_cast_by_name(spark, sf):
    lines = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part:R"), F.col("l_suppkey").alias("supplier:C"))
    return P.cast_by_name(lines)


@query("proj_drop_common", "SELECT o_orderkey, o_orderpriority FROM orders")
def proj_drop_common(spark, sf):
    o = load(spark, sf, "orders")
    return P.drop_common(o.select("o_orderkey", "o_totalprice", "o_orderstatus"),
                         o.select("o_orderkey", "o_totalprice", "o_orderpriority"), ["o_orderkey"])


@query("proj_rename_clients", """
SELECT l_returnflag AS criteria, min(l_quantity) AS "client1%", max(l_quantity) AS "sample_client99%" FROM lineitem GROUP BY 1""")
def proj_rename_clients(spark, sf):
    return P.rename_clients(load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("criteria")).agg(
        F.min("l_quantity").alias("percentile_1%"), F.max("l_quantity").alias("percentile_99%_emp")))


@query("proj_keep_existing", "SELECT p_partkey, p_brand FROM part")
def proj_keep_existing(spark, sf):
    return P.keep_existing(load(spark, sf, "part"), ["p_partkey", "loi", "p_brand", "R2"])


@query("flt_positive", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def flt_positive(spark, sf):
    return positive(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("flt_slice", "SELECT * FROM events WHERE user_id = 46 AND event_type = 'view'")
def flt_slice(spark, sf):
    return P.slice_eq(load(spark, sf, "events"), user_id=46, event_type="view")


@query("flt_not_in", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')""")
def flt_not_in(spark, sf):
    recent = load(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01'")
    return P.not_in(load(spark, sf, "customer").select("c_custkey", "c_name"),
                    recent.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


FIRST_ROW = """
SELECT criteria, class_index, low FROM (
  SELECT l_returnflag AS criteria, l_linenumber AS class_index, min(l_extendedprice) AS low,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber) AS rk
  FROM lineitem GROUP BY 1, 2) WHERE rk = 1"""


@query("flt_model_row", FIRST_ROW)
def flt_model_row(spark, sf):
    models = load(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("criteria"), F.col("l_linenumber").alias("class_index")).agg(
        F.min("l_extendedprice").alias("low"))
    return P.first_model_row(models)


@query("limit_first", f"SELECT * FROM ({FIRST_ROW}) WHERE criteria = 'R'")
def limit_first(spark, sf):
    models = load(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("criteria"), F.col("l_linenumber").alias("class_index")).agg(
        F.min("l_extendedprice").alias("low"))
    return P.first_model_row(models, "R")


@query("join_columns_left", """
SELECT o.o_orderkey, o.o_totalprice, o.o_orderstatus, p.o_orderpriority, l.lines FROM orders o
LEFT JOIN (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P') p USING (o_orderkey)
LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) l USING (o_orderkey)""")
def join_columns_left(spark, sf):
    o = load(spark, sf, "orders")
    lines = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    return left_fold([
        o.select("o_orderkey", "o_totalprice", "o_orderstatus"),
        o.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_orderpriority"),
        lines,
    ], ["o_orderkey"])


def cycle_files(spark, sf):
    o = load(spark, sf, "orders")
    keys = [F.col("o_custkey").alias("cycle"), F.col("o_orderkey").alias("ts")]
    files = [o.select(*keys, F.col("o_totalprice").alias("speed")),
             o.filter("o_orderstatus = 'F'").select(*keys, F.col("o_orderpriority").alias("gear"))]
    stored = o.filter("o_orderdate < timestamp_ntz'1998-01-01'").select(
        *keys, (F.col("o_totalprice") + 1).alias("speed"), F.col("o_orderstatus").alias("mode"))
    return files, stored


@query("join_cycle_merge", """
SELECT n.o_custkey AS cycle, n.o_orderkey AS ts, CASE WHEN n.o_orderstatus = 'F' THEN n.o_orderpriority END AS gear,
       s.o_orderstatus AS mode, n.o_totalprice AS speed
FROM orders n LEFT JOIN (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') s USING (o_custkey, o_orderkey)""")
def join_cycle_merge(spark, sf):
    files, stored = cycle_files(spark, sf)
    return merge_cycles(files, stored, ["cycle", "ts"], overwrite=True)


@query("join_cycle_merge_keep", """
SELECT o_custkey AS cycle, o_orderkey AS ts, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS gear,
       o_orderstatus AS mode, o_totalprice + 1 AS speed
FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'""")
def join_cycle_merge_keep(spark, sf):
    files, stored = cycle_files(spark, sf)
    return merge_cycles(files, stored, ["cycle", "ts"])


CYCLE = "'c' || (o_custkey % 4)"


def cycle_folder(spark, sf, overwrite):
    """Files of three cycles with differing columns, merged into a table that holds two of them and a fourth."""
    o = load(spark, sf, "orders").withColumn("cycle", F.expr(CYCLE))
    keys = ["cycle", "o_orderkey"]
    folder = scratch(spark)
    for c in ("c0", "c1", "c2"):
        of = o.filter(F.col("cycle") == c)
        of.select(*keys, F.col("o_totalprice").alias("speed")).write.parquet(f"{folder}/{c}_a.parquet")
        of.filter("o_orderstatus = 'F'").select(*keys, F.col("o_orderpriority").alias("gear")).write.parquet(f"{folder}/{c}_b.parquet")
    o.filter("cycle = 'c1'").select(*keys, (F.col("o_totalprice") - 1).alias("speed"), F.col("o_orderstatus").alias("mode")).write.parquet(
        f"{folder}/c1_c.parquet")
    store, database = new_store(spark)
    table = f"{database}.cycles"
    store.create(o.filter("cycle <> 'c2' AND o_orderdate < timestamp_ntz'1998-01-01'").select(
        *keys, (F.col("o_totalprice") + 1).alias("speed"), F.col("o_orderpriority").alias("mode")), table, ["cycle"])
    store_cycles(store, folder, table, "cycle", keys, overwrite)
    return store.read(table).select(*keys, "speed", "gear", "mode")


@query("join_cycle_folder", f"""
WITH o AS (SELECT *, {CYCLE} AS cycle, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders)
SELECT cycle, o_orderkey, CASE WHEN cycle = 'c3' THEN o_totalprice + 1 ELSE o_totalprice END AS speed,
  CASE WHEN o_orderstatus = 'F' AND cycle <> 'c3' THEN o_orderpriority END AS gear,
  CASE WHEN cycle = 'c1' THEN o_orderstatus WHEN early AND cycle <> 'c2' THEN o_orderpriority END AS mode
FROM o WHERE cycle <> 'c3' OR early""")
def join_cycle_folder(spark, sf):
    return cycle_folder(spark, sf, True)


@query("join_cycle_folder_keep", f"""
WITH o AS (SELECT *, {CYCLE} AS cycle, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders)
SELECT cycle, o_orderkey, CASE WHEN cycle = 'c2' THEN o_totalprice ELSE o_totalprice + 1 END AS speed,
  CASE WHEN o_orderstatus = 'F' AND cycle <> 'c3' THEN o_orderpriority END AS gear, CASE WHEN cycle <> 'c2' THEN o_orderpriority END AS mode
FROM o WHERE cycle = 'c2' OR early""")
def join_cycle_folder_keep(spark, sf):
    return cycle_folder(spark, sf, False)


@query("join_outer_merge", """
SELECT c_custkey, c.c_name, o.orders FROM customer c
FULL JOIN (SELECT o_custkey AS c_custkey, count(*) AS orders FROM orders GROUP BY 1) o USING (c_custkey)""")
def join_outer_merge(spark, sf):
    orders = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return merge_columns(load(spark, sf, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query("join_left_anti", """
SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS
(SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def join_left_anti(spark, sf):
    returned = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.not_in(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), returned, ["o_orderkey"])


@query("set_union_by_name", """
SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""")
def set_union_by_name(spark, sf):
    return R.union_evolving([
        load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
        load(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")),
    ])


@query("agg_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def agg_distinct(spark, sf):
    return distinct_on(load(spark, sf, "orders").select("o_custkey", "o_orderstatus"))


@query("agg_distinct_keys", """
SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice
FROM orders GROUP BY 1, 2""")
def agg_distinct_keys(spark, sf):
    return distinct_on(load(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"),
                       ["o_custkey", "o_orderstatus"])


@query("agg_row_count", "SELECT count(*) AS n FROM lineitem")
def agg_row_count(spark, sf):
    return load(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def stored_orders(spark, sf, partition):
    store, database = new_store(spark)
    table = f"{database}.orders"
    store.create(load(spark, sf, "orders"), table, [partition])
    return store, table


@query("sink_create_partitioned", f"SELECT {ORDERS} FROM orders")
def sink_create_partitioned(spark, sf):
    store, table = stored_orders(spark, sf, "o_orderstatus")
    return store.read(table)


@query("sink_append", f"""
SELECT {ORDERS}, NULL::VARCHAR AS zone FROM orders
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, NULL, 'EU' FROM orders""")
def sink_append(spark, sf):
    store, table = stored_orders(spark, sf, "o_orderpriority")
    store.append(load(spark, sf, "orders").drop("o_orderpriority").withColumn("zone", F.lit("EU")), table)
    return store.read(table)


@query("sink_replace_slice", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1, 'F' FROM orders WHERE o_orderstatus = 'P'""")
def sink_replace_slice(spark, sf):
    store, database = new_store(spark)
    table, columns = f"{database}.orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    orders = load(spark, sf, "orders").select(*columns)
    store.create(orders, table, ["o_orderstatus"])
    closed = orders.filter("o_orderstatus = 'P'").withColumns(
        {"o_totalprice": F.col("o_totalprice") + 1, "o_orderstatus": F.lit("F")})
    store.replace_slice(closed, table, ["o_orderkey"])
    return store.read(table)
