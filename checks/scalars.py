"""Scalar functions over whole columns of the test tables."""

from pyspark.sql import functions as F

from drivelaws.functions import scalars as S
from drivelaws.functions.laws import cdf, law_params, pdf, ppf
from drivelaws.functions.normal import probit

from .common import load, query, sig, sqlsig
from .sqltext import normal_cdf_sql, probit_sql

TITLE = "CASE WHEN lang = 'en' THEN '[' || source || '] study ' || doc_id ELSE 'study ' || doc_id END"
LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', CAST(('0x' || substr(md5(title), {5 * i + 1}, 5))::INTEGER % 36 + 1 AS INTEGER), 1)"
    for i in range(6))


@query("fn_study_ref", f"""
SELECT doc_id, CASE WHEN regexp_matches(title, '\\[([^\\]]+)\\]') THEN upper(trim(regexp_extract(title, '\\[([^\\]]+)\\]', 1))) ELSE 'PFM' END
  || '_' || {LETTERS} AS ref FROM (SELECT doc_id, {TITLE} AS title FROM documents)""")
def fn_study_ref(spark, sf):
    d = load(spark, sf, "documents")
    name = F.concat(F.lit("study "), F.col("doc_id").cast("string"))
    title = F.when(F.col("lang") == "en", F.concat(F.lit("["), F.col("source"), F.lit("] "), name)).otherwise(name)
    return d.select("doc_id", S.study_ref(title, title).alias("ref"))


@query("fn_chan_title", """
SELECT o_orderkey, 'CAN@' || o_orderpriority || '@' || printf('%03X', o_custkey) || '@' || o_orderstatus AS title FROM orders""")
def fn_chan_title(spark, sf):
    nom = F.concat_ws(":", F.lit("sig"), F.lit("R"), F.col("o_custkey").cast("string"))
    return load(spark, sf, "orders").select(
        "o_orderkey", S.chan_title(nom, F.col("o_orderpriority"), F.col("o_orderstatus")).alias("title"))


RUN = "concat_ws(';', o_custkey, o_orderkey, o_orderstatus, o_orderpriority, year(o_orderdate))"


def run_line(orders):
    parts = ["o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"]
    return F.concat_ws(";", *(F.col(c).cast("string") for c in parts), F.year("o_orderdate").cast("string"))


@query("fn_run_line_split", f"""
SELECT o_orderkey, split_part({RUN}, ';', 1) AS conducteur, split_part({RUN}, ';', 2) AS pret, split_part({RUN}, ';', 3) AS cpg,
       split_part({RUN}, ';', 4) AS vis, split_part({RUN}, ';', 5) AS run FROM orders""")
def fn_run_line_split(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", S.run_line(run_line(o)).alias("r")).select("o_orderkey", "r.*")


@query("fn_storage_name", """
SELECT o_orderkey, '/Archive/' || o_orderstatus || '_' || o_orderpriority || '_' || o_custkey || '_' || o_orderkey || '.ess/'
  || year(o_orderdate) || '_' || month(o_orderdate) || '.mas' AS path FROM orders""")
def fn_storage_name(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", S.storage_name(S.run_line(run_line(o)), F.month("o_orderdate").cast("string")).alias("path"))


@query("fn_trip_token", "SELECT event_id, user_id || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS token FROM events")
def fn_trip_token(spark, sf):
    return load(spark, sf, "events").select("event_id", S.trip_token(F.col("user_id"), F.to_date("ts")).alias("token"))


@query("fn_list_to_text", """
SELECT vec_id, concat_ws(',', CAST(label AS VARCHAR), CAST(vec_id AS VARCHAR)) AS items FROM embeddings""")
def fn_list_to_text(spark, sf):
    return load(spark, sf, "embeddings").select(
        "vec_id", S.list_text(F.array(F.col("label").cast("long"), F.col("vec_id"))).alias("items"))


@query("fn_stats_json", """
SELECT l_returnflag, '[' || CAST(min(l_quantity) AS VARCHAR) || ',' || CAST(max(l_quantity) AS VARCHAR) || ',' ||
  CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) || ']' AS stats FROM lineitem GROUP BY 1""")
def fn_stats_json(spark, sf):
    g = load(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.count(F.lit(1)).cast("double").alias("c"))
    return g.select("l_returnflag", S.stats_json(F.col("a"), F.col("b"), F.col("c")).alias("stats"))


@query("fn_safe_cast", """
SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand, TRY_CAST(p_type AS DOUBLE) AS kind,
       TRY_CAST(CAST(p_retailprice AS VARCHAR) AS DOUBLE) AS price FROM part""")
def fn_safe_cast(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey", S.safe_cast(F.split("p_brand", "#")[1], "int").alias("brand"),
        S.safe_cast(F.col("p_type"), "double").alias("kind"),
        S.safe_cast(F.col("p_retailprice").cast("string"), "double").alias("price"))


@query("fn_study_date", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""")
def fn_study_date(spark, sf):
    text = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon"))
    return load(spark, sf, "orders").select("o_orderkey", S.study_date(text).alias("d"))


@query("fn_stamp", "SELECT p_partkey, p_brand, 'study' AS study_title, true AS today, true AS recent, true AS alike FROM part")
def fn_stamp(spark, sf):
    from drivelaws.operators.merge import stamp_insights, stamp_study
    stamped = stamp_study(stamp_insights(load(spark, sf, "part").select("p_partkey", "p_brand"), "study"))
    return stamped.select(
        "p_partkey", "p_brand", "study_title", (F.col("dt") == F.current_date()).alias("today"),
        F.col("Creation_date").between(F.expr("current_timestamp() - INTERVAL 1 HOUR"), F.expr("current_timestamp() + INTERVAL 1 HOUR")).alias("recent"),
        (F.col("Creation_date") == F.col("Modification_date")).alias("alike"))


@query("fn_minmax_clip", f"""
SELECT l_orderkey, l_linenumber, {sqlsig("greatest(least((l_extendedprice - lo) / (hi - lo), 1 - 1e-6), 1e-6)")} AS u
FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)""")
def fn_minmax_clip(spark, sf):
    lines = load(spark, sf, "lineitem")
    ends = lines.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")).withColumn("j", F.lit(1))
    both = lines.withColumn("j", F.lit(1)).join(F.broadcast(ends), "j")  # one row
    u = S.minmax_clip(F.col("l_extendedprice"), F.col("lo"), F.col("hi"))
    return both.select("l_orderkey", "l_linenumber", sig(u).alias("u"))


@query("fn_plotting_position", f"SELECT p_partkey, {sqlsig('(p_size - 0.3) / (50 + 0.4)')} AS f FROM part")
def fn_plotting_position(spark, sf):
    return load(spark, sf, "part").select("p_partkey", sig(S.plotting_position(F.col("p_size"), F.lit(50))).alias("f"))


P = "(o_totalprice + 1) / 600000.0::DOUBLE"


@query("fn_probit", f"SELECT o_orderkey, {sqlsig(probit_sql(P))} AS z FROM orders")
def fn_probit(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", sig(probit((F.col("o_totalprice") + 1) / 600000.0)).alias("z"))


# Parameters at which the law functions are evaluated.
PARAMS = {"lognormal": (0.5, 11.5), "normal": (150000.0, 60000.0), "weibull": (1.7, 160000.0), "exponential": (150000.0,)}


@query("fn_law_ppf", f"""
SELECT o_orderkey, {sqlsig(f"exp(11.5 + 0.5 * {probit_sql(P)})")} AS lognormal, {sqlsig(f"150000 + 60000 * {probit_sql(P)}")} AS normal,
  {sqlsig(f"160000 * pow(-ln(1 - {P}), 1 / 1.7)")} AS weibull, {sqlsig(f"-150000 * ln(1 - {P})")} AS exponential FROM orders""")
def fn_law_ppf(spark, sf):
    p = (F.col("o_totalprice") + 1) / 600000.0
    return load(spark, sf, "orders").select("o_orderkey", *(
        sig(ppf(law, p, law_params(law, *map(F.lit, values)))).alias(law) for law, values in PARAMS.items()))


X = "o_totalprice"
BELL = "exp(-({z}) * ({z}) / 2) / 2.5066282746310002"
LN_Z, N_Z = f"(ln({X}) - 11.5) / 0.5", f"({X} - 150000) / 60000"


@query("fn_law_pdf", f"""
SELECT o_orderkey, {sqlsig(BELL.format(z=LN_Z) + f" / ({X} * 0.5)")} AS lognormal, {sqlsig(BELL.format(z=N_Z) + " / 60000")} AS normal,
  {sqlsig(f"1.7 / 160000 * pow({X} / 160000, 0.7) * exp(-pow({X} / 160000, 1.7))")} AS weibull,
  {sqlsig(f"exp(-{X} / 150000) / 150000")} AS exponential FROM orders""")
def fn_law_pdf(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", *(
        sig(pdf(law, F.col("o_totalprice"), law_params(law, *map(F.lit, values)))).alias(law) for law, values in PARAMS.items()))


@query("fn_law_cdf", f"""
SELECT o_orderkey, {sqlsig(normal_cdf_sql(LN_Z))} AS lognormal, {sqlsig(normal_cdf_sql(N_Z))} AS normal,
  {sqlsig(f"1 - exp(-pow({X} / 160000, 1.7))")} AS weibull, {sqlsig(f"1 - exp(-{X} / 150000)")} AS exponential FROM orders""")
def fn_law_cdf(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", *(
        sig(cdf(law, F.col("o_totalprice"), law_params(law, *map(F.lit, values)))).alias(law) for law, values in PARAMS.items()))


# Whole-number shapes have closed distributions. A quantile is checked by putting it back.
GAMMA_Z = f"({X} / 60000)"


@query("fn_law_gamma_beta", f"""
SELECT o_orderkey, {sqlsig(P, 9)} AS gamma_back, {sqlsig(P, 9)} AS beta_back,
  {sqlsig(f"1 - exp(-{GAMMA_Z}) * (1 + {GAMMA_Z} + {GAMMA_Z} * {GAMMA_Z} / 2)")} AS gamma_cdf,
  {sqlsig(f"{P} * {P} * (6 - 8 * {P} + 3 * {P} * {P})")} AS beta_cdf,
  {sqlsig(f"{GAMMA_Z} * {GAMMA_Z} * exp(-{GAMMA_Z}) / 2 / 60000")} AS gamma_pdf,
  {sqlsig(f"12 * {P} * (1 - {P}) * (1 - {P})")} AS beta_pdf FROM orders""")
def fn_law_gamma_beta(spark, sf):
    p = (F.col("o_totalprice") + 1) / 600000.0
    gamma, beta = law_params("gamma", F.lit(3.0), F.lit(60000.0)), law_params("beta", F.lit(2.0), F.lit(3.0))
    return load(spark, sf, "orders").select(
        "o_orderkey", sig(cdf("gamma", ppf("gamma", p, gamma), gamma), 9).alias("gamma_back"),
        sig(cdf("beta", ppf("beta", p, beta), beta), 9).alias("beta_back"),
        sig(cdf("gamma", F.col("o_totalprice"), gamma)).alias("gamma_cdf"), sig(cdf("beta", p, beta)).alias("beta_cdf"),
        sig(pdf("gamma", F.col("o_totalprice"), gamma)).alias("gamma_pdf"), sig(pdf("beta", p, beta)).alias("beta_pdf"))
