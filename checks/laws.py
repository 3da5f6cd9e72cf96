"""Samples, class regressions, estimates, rankings, gates and the modelling jobs."""

from pyspark.sql import functions as F

from drivelaws.operators import classes as C
from drivelaws.operators import estimate as E
from drivelaws.operators import gates as G
from drivelaws.operators import ranking as R
from drivelaws.operators import sample as S
from drivelaws.plans import modelling as M

from .common import load, query, rounded, sig, sqlsig
from .sqltext import CUSTOMERS, MARKS, at, classes_sql, models_sql, LAWS, probit_sql

N_MAX = 20
PRICES = "SELECT l_returnflag AS criteria, l_extendedprice AS x FROM lineitem WHERE l_extendedprice > 0"
VALUES = "SELECT event_type AS criteria, value AS x FROM events WHERE value > 0"
BALANCES = "SELECT CAST(s_nationkey AS VARCHAR) AS criteria, s_acctbal AS x FROM supplier WHERE s_acctbal > 0"


def prices(spark, sf):
    return S.to_sample(load(spark, sf, "lineitem"), ["l_extendedprice"], "l_returnflag")


def values(spark, sf):
    return S.to_sample(load(spark, sf, "events"), ["value"], "event_type")


def balances(spark, sf):
    return S.to_sample(load(spark, sf, "supplier"), ["s_acctbal"], "s_nationkey")


@query("to_sample", """
SELECT 'l_extendedprice|' || l_returnflag AS criteria, l_extendedprice AS x FROM lineitem WHERE l_extendedprice > 0
UNION ALL SELECT 'l_discount|' || l_returnflag, l_discount FROM lineitem WHERE l_discount > 0
UNION ALL SELECT 'l_tax|' || l_returnflag, l_tax FROM lineitem WHERE l_tax > 0""")
def to_sample(spark, sf):
    return S.to_sample(load(spark, sf, "lineitem"), ["l_extendedprice", "l_discount", "l_tax"], "l_returnflag")


@query("agg_sample_summary", f"""
SELECT criteria, count(*) AS n, min(x) AS data_min, max(x) AS data_max, {sqlsig('avg(x)')} AS data_mean FROM ({PRICES}) GROUP BY 1""")
def agg_sample_summary(spark, sf):
    return S.sample_summary(prices(spark, sf)).withColumn("data_mean", sig("data_mean"))


PCT = ", ".join(f"{sqlsig(f'quantile_cont(x, {p})', 9)} AS p{int(p * 100)}" for p in CUSTOMERS)


def customers(pct):
    return pct.select("criteria", *(sig(F.col("pct")[i], 9).alias(f"p{int(p * 100)}") for i, p in enumerate(CUSTOMERS)))


@query("agg_percentiles", f"SELECT criteria, {PCT} FROM ({PRICES}) GROUP BY 1")
def agg_percentiles(spark, sf):
    return customers(S.percentiles(prices(spark, sf)))


@query("agg_percentiles_hot", f"SELECT criteria, {PCT} FROM ({PRICES}) GROUP BY 1")
def agg_percentiles_hot(spark, sf):
    """The search meant for groups too large for one task, here for all of them."""
    return customers(S.percentiles(prices(spark, sf), gather=100))


@query("agg_percentile_grid", f"""
SELECT criteria, CAST(p AS INTEGER) AS p, {sqlsig('v', 9)} AS value FROM (
  SELECT criteria, unnest([{", ".join(str(m) for m in range(0, 100, 5))}]) AS p,
         unnest(quantile_cont(x, [{", ".join(map(str, MARKS))}])) AS v FROM ({VALUES}) GROUP BY 1)""")
def agg_percentile_grid(spark, sf):
    return S.percentile_grid(values(spark, sf)).withColumn("value", sig("value", 9))


@query("agg_moments", f"""
SELECT criteria, {sqlsig('avg(x)')} AS mean, {sqlsig('stddev_samp(x)')} AS std, {sqlsig('var_samp(x)')} AS var FROM ({PRICES}) GROUP BY 1""")
def agg_moments(spark, sf):
    return rounded(S.moments(prices(spark, sf)), ("criteria",))


@query("agg_moments_pop", f"""
SELECT criteria, {sqlsig('avg(x)')} AS mean, {sqlsig('stddev_pop(x)')} AS std, {sqlsig('var_pop(x)')} AS var FROM ({PRICES}) GROUP BY 1""")
def agg_moments_pop(spark, sf):
    return rounded(S.moments(prices(spark, sf), ddof=0), ("criteria",))


@query("agg_ols", f"""
SELECT l_returnflag, {sqlsig('regr_slope(l_extendedprice, l_quantity)')} AS slope,
  {sqlsig('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {sqlsig('regr_r2(l_extendedprice, l_quantity)')} AS "R2"
FROM lineitem GROUP BY 1""")
def agg_ols(spark, sf):
    return rounded(S.ols(load(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]), ("l_returnflag",))


@query("agg_density_hist", f"""
WITH s AS ({PRICES}), b AS (SELECT criteria, count(*) AS n, min(x) AS lo, (max(x) - min(x)) / 30 AS w FROM s GROUP BY 1),
c AS (SELECT criteria, CAST(least(floor((x - lo) / w), 29) AS INTEGER) AS bin, count(*) AS freq FROM s JOIN b USING (criteria) GROUP BY 1, 2)
SELECT b.criteria, CAST(k AS INTEGER) AS bin, {sqlsig('lo + k * w')} AS bin_start, coalesce(freq, 0) AS freq,
  {sqlsig('coalesce(freq, 0) / (n * w)')} AS density
FROM b CROSS JOIN range(0, 30) r(k) LEFT JOIN c ON c.criteria = b.criteria AND c.bin = k""")
def agg_density_hist(spark, sf):
    return rounded(S.density_hist(prices(spark, sf)), ("criteria", "bin", "freq"))


HIST = """
SELECT criteria, class_index, i, i_rank - coalesce(lag(i_rank) OVER (PARTITION BY criteria, class_index ORDER BY i), 0) AS freq, i_rank
FROM (SELECT criteria, class_index, i, i_rank FROM h UNION ALL SELECT DISTINCT criteria, class_index, class_index, n FROM h)"""


@query("agg_class_histogram", f"WITH {classes_sql(PRICES, N_MAX)} {HIST}")
def agg_class_histogram(spark, sf):
    return C.class_histogram(prices(spark, sf), N_MAX).select("criteria", "class_index", "i", "freq", "i_rank")


@query("win_cum_freq", f"WITH {classes_sql(VALUES, N_MAX)} SELECT criteria, class_index, i, i_rank FROM ({HIST})")
def win_cum_freq(spark, sf):
    hist = C.class_histogram(values(spark, sf), N_MAX).drop("i_rank")
    return C.cumulative_rank(hist).select("criteria", "class_index", "i", "i_rank")


def model_select(law: str) -> str:
    params = ", ".join(f'{sqlsig(n)} AS "{n}"' for n in LAWS[law][2])
    numbers = {"R2": "r2", "percentile_1%": "q0", "percentile_50%": "q1", "percentile_99%": "q2", "percentile_1%_emp": "e0",
               "percentile_50%_emp": "e1", "percentile_99%_emp": "e2", "MSE": "mse", "Mean relat diff": "mrd",
               "relat_diff_1%": "d0", "relat_diff_50%": "d1", "relat_diff_99%": "d2", "data_mean": "data_mean"}
    listed = ", ".join(f'{sqlsig(e)} AS "{n}"' for n, e in numbers.items())
    return f"SELECT criteria, n, class_index, data_min, data_max, '{law}' AS loi, {params}, {listed} FROM m"


EXACT = ("criteria", "n", "class_index", "data_min", "data_max", "loi")


def flat(models, law):
    wide = models.select("*", *(F.col("params")[n].alias(n) for n in LAWS[law][2])).drop("params")
    return rounded(wide, EXACT)


def law_query(name, law, grid_from=0, sample=prices, text=PRICES):
    marks = [m for m in MARKS if m >= grid_from / 100]

    @query(name, f"WITH {models_sql(text, law, N_MAX, marks)} {model_select(law)}")
    def run(spark, sf):
        return flat(C.fit_classes(sample(spark, sf), law, N_MAX, grid_from=grid_from), law)

    return run


fit_class_lognormal = law_query("fit_class_lognormal", "lognormal")
fit_class_normal = law_query("fit_class_normal", "normal", grid_from=5)
fit_class_weibull = law_query("fit_class_weibull", "weibull")
fit_class_exponential = law_query("fit_class_exponential", "exponential")
class_sweep = law_query("class_sweep", "exponential", sample=values, text=VALUES)


@query("fit_class_lognormal_shifted", f"""
WITH {classes_sql(PRICES, N_MAX)},
pt AS (SELECT *, (i_rank + 1 - 0.3::DOUBLE) / (n + 0.4::DOUBLE) AS f, ln(c - 100) AS px FROM h),
xy AS (SELECT *, {probit_sql("f")} AS py FROM pt),
ln AS (SELECT criteria, class_index, regr_slope(py, px) AS b1, regr_intercept(py, px) AS b0, regr_r2(py, px) AS r2 FROM xy GROUP BY 1, 2),
pr AS (SELECT *, 1 / b1 AS slnx, -b0 / b1 AS mulnx FROM ln)
SELECT criteria, class_index, {sqlsig('r2')} AS "R2", {sqlsig('slnx')} AS slnx, {sqlsig('mulnx')} AS mulnx,
  {sqlsig(at(LAWS["lognormal"][3], 0.01))} AS "percentile_1%", {sqlsig(at(LAWS["lognormal"][3], 0.5))} AS "percentile_50%",
  {sqlsig(at(LAWS["lognormal"][3], 0.99))} AS "percentile_99%" FROM pr""")
def fit_class_lognormal_shifted(spark, sf):
    return rounded(C.fit_classes_shifted(prices(spark, sf), N_MAX, 100.0), ("criteria", "class_index"))


@query("fit_class_gamma")
def fit_class_gamma(spark, sf):
    return C.fit_classes(values(spark, sf), "gamma", N_MAX)


@query("fit_class_beta")
def fit_class_beta(spark, sf):
    return C.fit_classes(prices(spark, sf), "beta", N_MAX)


@query("fit_quality", f"""
WITH {models_sql(VALUES, "weibull", N_MAX)}
SELECT criteria, class_index, {sqlsig('mse')} AS "MSE", {sqlsig('mrd')} AS "Mean relat diff", {sqlsig('d1')} AS "relat_diff_50%" FROM m""")
def fit_quality(spark, sf):
    models = C.fit_classes(values(spark, sf), "weibull", N_MAX)
    return rounded(models.select("criteria", "class_index", "MSE", "Mean relat diff", "relat_diff_50%"), ("criteria", "class_index"))


@query("win_drop_first_classes", f"""
WITH {classes_sql(VALUES, N_MAX)} SELECT DISTINCT criteria, class_index FROM h WHERE class_index >= 5""")
def win_drop_first_classes(spark, sf):
    sweep = C.class_histogram(values(spark, sf), N_MAX).filter("i = 0").select("criteria", "class_index")
    return C.drop_first_classes(sweep)


@query("win_best_row", f"""
WITH {models_sql(VALUES, "exponential", N_MAX)}
SELECT criteria, arg_min(class_index, mse) AS class_index FROM m GROUP BY 1""")
def win_best_row(spark, sf):
    return C.best_row(C.fit_classes(values(spark, sf), "exponential", N_MAX), ["criteria"], F.col("MSE"))


@query("best_class", f"""
WITH {models_sql(VALUES, "weibull", N_MAX)}
SELECT criteria, arg_min(class_index, abs(q0 - e0) + abs(q1 - e1)) AS index_best_1_50,
  arg_min(class_index, abs(q1 - e1) + abs(q2 - e2)) AS index_best_50_99,
  arg_min(class_index, abs(q0 - e0) + abs(q1 - e1) + abs(q2 - e2)) AS index_best_1_50_99,
  arg_min(class_index, abs(q0 - e0) + abs(q1 - e1) + abs(q2 - e2)) AS best_class FROM m WHERE class_index >= 5 GROUP BY 1""")
def best_class(spark, sf):
    return C.best_class(C.drop_first_classes(C.fit_classes(values(spark, sf), "weibull", N_MAX)))


GATE = """SELECT criteria, {m1} AS min_1, {m50} AS min_50, {m99} AS min_99, {mrd} AS min_mrd,
  CASE WHEN {over} THEN NULL ELSE arg_min(class_index, mrd) END AS mrd_class,
  CASE WHEN {over} THEN 'fallback' ELSE 'success' END AS status, {over} AS use_fallback FROM m WHERE class_index >= {first} GROUP BY 1"""
MINS = {"m1": sqlsig("min(abs(d0))"), "m50": sqlsig("min(abs(d1))"), "m99": sqlsig("min(abs(d2))"), "mrd": sqlsig("min(mrd)")}
GATE_EXACT = ("criteria", "mrd_class", "status", "use_fallback")


@query("gate_mrd", f"""WITH {models_sql(VALUES, "exponential", N_MAX)} {GATE.format(
    over="min(abs(d0)) > 2 AND min(abs(d1)) > 2 AND min(abs(d2)) > 2", first=2, **MINS)}""")
def gate_mrd(spark, sf):
    return rounded(G.gate_mrd(C.fit_classes(values(spark, sf), "exponential", N_MAX), 2.0), GATE_EXACT)


@query("gate_mrd_legacy", f"""WITH {models_sql(VALUES, "exponential", N_MAX)} {GATE.format(over="min(mrd) > 20", first=2, **MINS)}""")
def gate_mrd_legacy(spark, sf):
    return rounded(G.gate_mrd(C.fit_classes(values(spark, sf), "exponential", N_MAX), 20.0, rule="mrd"), GATE_EXACT)


@query("model_summary", f"""WITH {models_sql(PRICES, "lognormal", N_MAX)} {GATE.format(
    over="min(abs(d0)) > 5 AND min(abs(d1)) > 5 AND min(abs(d2)) > 5", first=4, **MINS)}""")
def model_summary(spark, sf):
    gate, _ = M.model_summary(prices(spark, sf), N_MAX, 5.0)
    return rounded(gate, GATE_EXACT)


@query("gate_small_sample", f"""
SELECT criteria, count(*) AS n, min(x) AS data_min, max(x) AS data_max, {sqlsig('avg(x)', 9)} AS data_mean, 'Non modelisable' AS loi,
  {", ".join(f'{sqlsig(f"quantile_cont(x, {p})", 9)} AS "percentile_{int(p * 100)}%"' for p in CUSTOMERS)},
  {", ".join(f'{sqlsig(f"quantile_cont(x, {p})", 9)} AS "percentile_{int(p * 100)}%_emp"' for p in CUSTOMERS)},
  0::DOUBLE AS "Mean relat diff" FROM ({BALANCES}) GROUP BY 1 HAVING count(*) < 30 OR max(x) <= min(x)""")
def gate_small_sample(spark, sf):
    rows = G.gate_small_sample(balances(spark, sf)).drop(
        "class_index", "params", "R2", "MSE", "relat_diff_1%", "relat_diff_50%", "relat_diff_99%")
    return rounded(rows, ("criteria", "n", "data_min", "data_max", "loi"), 9)


def estimate_sql(law: str, params: dict[str, str], quantile: str, marks, points=None, solved: str = "", known: str = "st") -> str:
    ps = [*CUSTOMERS, *marks]
    grid = points or range(3, len(ps))
    fit = ", ".join(f"{at(quantile, p)} AS q{j}" for j, p in enumerate(ps))
    emp = ", ".join(f"quantile_cont(x, {p!r}) AS e{j}" for j, p in enumerate(ps))
    mse = " + ".join(f"(e{j} - q{j}) * (e{j} - q{j})" for j in grid)
    return f"""
WITH {solved} st AS (SELECT criteria, count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS m, stddev_pop(x) AS sp, stddev_samp(x) AS ss, {emp}
            FROM ({VALUES}) GROUP BY 1),
pr AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in params.items())} FROM {known}), ft AS (SELECT *, {fit} FROM pr)
SELECT criteria, n, lo AS data_min, hi AS data_max, {sqlsig('m')} AS data_mean, '{law}' AS loi,
  {", ".join(f"{sqlsig(n)} AS {n}" for n in params)},
  {sqlsig('q0')} AS "percentile_1%", {sqlsig('q1')} AS "percentile_50%", {sqlsig('q2')} AS "percentile_99%",
  {sqlsig('e0')} AS "percentile_1%_emp", {sqlsig('e1')} AS "percentile_50%_emp", {sqlsig('e2')} AS "percentile_99%_emp",
  {sqlsig(f'({mse}) / {len(grid)}')} AS "MSE",
  {sqlsig('(abs(100 * (q0 - e0) / e0) + abs(100 * (q1 - e1) / e1) + abs(100 * (q2 - e2) / e2)) / 3')} AS "Mean relat diff",
  {sqlsig('100 * (q0 - e0) / e0')} AS "relat_diff_1%", {sqlsig('100 * (q1 - e1) / e1')} AS "relat_diff_50%",
  {sqlsig('100 * (q2 - e2) / e2')} AS "relat_diff_99%" FROM ft"""


def estimated(spark, sf, law, grid_from=0):
    return flat(E.estimate(values(spark, sf), law, grid_from=grid_from).drop("class_index", "R2"), law)


@query("est_lognormal", estimate_sql("lognormal", {
    "slnx": "sqrt(ln(1 + (sp / m) * (sp / m)))", "mulnx": "ln(m / sqrt(1 + (sp / m) * (sp / m)))"},
    LAWS["lognormal"][3], MARKS, range(3)))
def est_lognormal(spark, sf):
    return estimated(spark, sf, "lognormal")


@query("est_normal", estimate_sql("normal", {"mu": "m", "sigma": "ss"}, LAWS["normal"][3], MARKS[1:]))
def est_normal(spark, sf):
    return estimated(spark, sf, "normal", 5)


@query("est_exponential", estimate_sql("exponential", {"lambda_inv": "m"}, LAWS["exponential"][3], MARKS))
def est_exponential(spark, sf):
    return estimated(spark, sf, "exponential")


@query("est_gamma")
def est_gamma(spark, sf):
    return E.estimate(values(spark, sf), "gamma")


def bisected(start: str, low: str, high: str, excess: str, steps: int = 60) -> str:
    """Tables ``sc`` (values scaled by the largest of their criterion) and ``root``: where the excess, which grows, is 0."""
    return f"""RECURSIVE sc AS (SELECT criteria, {start} AS v FROM (SELECT *, max(x) OVER w AS hi, min(x) OVER w AS lo FROM ({VALUES}) WINDOW w AS (PARTITION BY criteria))),
sm AS (SELECT criteria, count(*) AS n, avg(v) AS mv FROM sc GROUP BY 1),
walk AS (
    SELECT 0 AS i, criteria, n, mv, CAST({low} AS DOUBLE) AS a, CAST({high} AS DOUBLE) AS b FROM sm
    UNION ALL
    SELECT i + 1, criteria, n, mv, CASE WHEN over THEN a ELSE c END, CASE WHEN over THEN c ELSE b END FROM (
        SELECT i, walk.criteria, n, mv, a, b, (a + b) / 2 AS c, {excess.format(c="((a + b) / 2)")} > 0 AS over
        FROM walk JOIN sc USING (criteria) WHERE i < {steps} GROUP BY i, walk.criteria, n, mv, a, b)),
root AS (SELECT criteria, (a + b) / 2 AS c FROM walk WHERE i = {steps})"""


# shape of a Weibull law: the mean of ln x, weighed by x ^ c, is by 1 / c above the plain mean
SHAPE = "(sum(exp({c} * v) * v) / sum(exp({c} * v)) - 1 / {c} - mv)"
WEIBULL = f"""{bisected("ln(x / hi)", "0.01", "100", SHAPE)},
wb AS (SELECT criteria, any_value(c) AS shape, any_value(hi) * pow(avg(exp(c * v)), 1 / any_value(c)) AS scale
       FROM sc JOIN root USING (criteria) JOIN (SELECT criteria, max(x) AS hi FROM ({VALUES}) GROUP BY 1) USING (criteria) GROUP BY 1),"""


@query("est_weibull", estimate_sql("weibull", {"beta_shape": "shape", "lambda_scale": "scale"}, LAWS["weibull"][3], MARKS,
                                   solved=WEIBULL, known="st JOIN wb USING (criteria)"))
def est_weibull(spark, sf):
    return estimated(spark, sf, "weibull")


@query("est_beta")
def est_beta(spark, sf):
    return E.estimate(prices(spark, sf), "beta")


CLOSED = ("normal", "lognormal", "exponential")
RANK = f"""
WITH st AS (SELECT criteria, count(*) AS n, min(x) AS lo, avg(x) AS m, var_pop(x) AS v, avg(ln(x)) AS ml, var_pop(ln(x)) AS vl FROM ({VALUES}) GROUP BY 1),
lk AS (SELECT criteria, n, 'normal' AS law, 2 AS k, -n * (ln(2 * pi()) / 2 + ln(v) / 2 + 0.5) AS loglik FROM st
  UNION ALL SELECT criteria, n, 'lognormal', 2, -n * (ln(2 * pi()) / 2 + ln(vl) / 2 + 0.5 + ml) FROM st
  UNION ALL SELECT criteria, n, 'exponential', 1, -n * (ln(m - lo) + 1) FROM st)"""


@query("rank_laws", f"""{RANK}
SELECT criteria, law, k, {sqlsig('loglik')} AS loglik, {sqlsig('2 * k - 2 * loglik')} AS aic, {sqlsig('k * ln(n) - 2 * loglik')} AS bic FROM lk""")
def rank_laws(spark, sf):
    return rounded(R.rank_laws(values(spark, sf), CLOSED).drop("params"), ("criteria", "law", "k"))


@query("sort_laws_by_aic", f"{RANK} SELECT criteria, arg_min(law, 2 * k - 2 * loglik) AS law FROM lk GROUP BY 1")
def sort_laws_by_aic(spark, sf):
    return R.top_law(R.rank_laws(values(spark, sf), CLOSED))


@query("model_choice", f"{RANK} SELECT criteria, arg_min(law, 2 * k - 2 * loglik) AS loi FROM lk GROUP BY 1")
def model_choice(spark, sf):
    return R.choose_law(R.rank_laws(values(spark, sf), CLOSED))


# scale of a Gumbel law: it grows towards the plain mean less the mean weighed by exp(-v / c); likelihoods are flat at
# their largest, so a gamma shape by three digits gives all digits of its own
GUMBEL = bisected("(x - lo) / (hi - lo)", "0.001", "10", "({c} - mv + sum(exp(-v / {c}) * v) / sum(exp(-v / {c})))")


@query("rank_iterated_laws", f"""WITH {GUMBEL},
rg AS (SELECT criteria, max(x) - min(x) AS width FROM ({VALUES}) GROUP BY 1),
gb AS (SELECT criteria, count(*) AS n, any_value(c) AS c, any_value(width) AS width, avg(v) AS mv, -any_value(c) * ln(avg(exp(-v / c))) AS loc
       FROM sc JOIN root USING (criteria) JOIN rg USING (criteria) GROUP BY 1),
gs AS (SELECT criteria, count(*) AS n, avg(x) AS m, avg(ln(x)) AS ml FROM ({VALUES}) GROUP BY 1),
ks AS (SELECT criteria, n, unnest(range(-9000, 9001)) / 1000.0 AS e, m, ml FROM gs),
gm AS (SELECT criteria, n, max(n * ((exp(e) - 1) * ml - exp(e) - exp(e) * (ln(m) - e) - lgamma(exp(e)))) AS loglik FROM ks GROUP BY 1, 2),
lk AS (SELECT criteria, n, 'gumbel' AS law, 2 AS k, -n * ln(c * width) - n * (mv - loc) / c - n AS loglik FROM gb
       UNION ALL SELECT criteria, n, 'gamma', 2, loglik FROM gm)
SELECT criteria, law, k, {sqlsig('loglik')} AS loglik, {sqlsig('2 * k - 2 * loglik')} AS aic, {sqlsig('k * ln(n) - 2 * loglik')} AS bic FROM lk""")
def rank_iterated_laws(spark, sf):
    """The laws whose likelihood has no closed largest value, but for beta."""
    return rounded(R.rank_laws(values(spark, sf), ("gamma", "gumbel")).drop("params"), ("criteria", "law", "k"))


@query("rank_all_laws")
def rank_all_laws(spark, sf):
    return R.rank_laws(values(spark, sf))


@query("hist_rmse")
def hist_rmse(spark, sf):
    sample = values(spark, sf)
    return R.hist_rmse(sample, R.rank_laws(sample))


SWEEP = f"""
WITH {models_sql(VALUES, "exponential", N_MAX)},
gt AS (SELECT criteria, min(abs(d0)) > 2 AND min(abs(d1)) > 2 AND min(abs(d2)) > 2 AS over,
              arg_min(class_index, abs(q0 - e0) + abs(q1 - e1) + abs(q2 - e2)) AS best FROM m WHERE class_index >= 5 GROUP BY 1),
es AS (SELECT b.criteria, b.n, b.mean, {", ".join(f"{at('(mean * -ln(1 - {p}))', p)} AS q{j}" for j, p in enumerate(CUSTOMERS))}, em.* EXCLUDE (criteria)
       FROM b JOIN em USING (criteria) JOIN gt USING (criteria) WHERE over)"""
SIX = ", ".join(f'{sqlsig(f"q{j}")} AS "percentile_{int(p * 100)}%"' for j, p in enumerate(CUSTOMERS))


@query("model_columns", f"""{SWEEP}
SELECT criteria, n, class_index, 'exponential' AS loi, 'class' AS method, class_index = best AS is_best, 'success' AS status, {SIX}, {sqlsig('mrd')} AS "Mean relat diff"
FROM m JOIN gt USING (criteria) WHERE class_index >= 5 AND NOT over
UNION ALL SELECT criteria, n, NULL, 'exponential', 'estimation', true, 'fallback', {SIX},
  {sqlsig('(abs(100 * (q0 - e0) / e0) + abs(100 * (q1 - e1) / e1) + abs(100 * (q2 - e2) / e2)) / 3')} FROM es""")
def model_columns(spark, sf):
    models = M.model_sample(values(spark, sf), N_MAX, "exponential", threshold=2.0)
    kept = models.select("criteria", "n", "class_index", "loi", "method", "is_best", "status", "percentile_1%", "percentile_50%",
                         "percentile_99%", "Mean relat diff")
    return rounded(kept, ("criteria", "n", "class_index", "loi", "method", "is_best", "status"))


@query("model_columns_auto")
def model_columns_auto(spark, sf):
    return M.model_columns(load(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], N_MAX)


@query("model_table")
def model_table(spark, sf):
    models = M.model_sample(values(spark, sf), N_MAX, "exponential", threshold=5.0)
    return M.model_table(models, "[USAGE] event values", {"table": "events"})


@query("params_json")
def params_json(spark, sf):
    fits = R.rank_laws(values(spark, sf), CLOSED)
    return fits.select("criteria", "law", M.params_json(F.col("params")).alias("parameters"))


@query("set_union_results", """
SELECT 'l_extendedprice' AS criteria, count(*) AS n FROM lineitem WHERE l_extendedprice > 0
UNION ALL SELECT 'l_quantity', count(*) FROM lineitem WHERE l_quantity > 0 UNION ALL SELECT 'l_tax', count(*) FROM lineitem WHERE l_tax > 0""")
def set_union_results(spark, sf):
    sample = S.to_sample(load(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"])
    return S.sample_summary(sample).select("criteria", "n")


@query("curve_points", f"""
WITH s AS (SELECT criteria, min(x) AS lo, max(x) AS hi, avg(x) AS m FROM ({VALUES}) GROUP BY 1),
p AS (SELECT criteria, CAST(k AS INTEGER) AS point, lo + (hi - lo) * k / 999.0::DOUBLE AS x, m FROM s, range(0, 1000) r(k))
SELECT criteria, 'exponential' AS loi, point, {sqlsig('x')} AS x, {sqlsig('exp(-x / m) / m')} AS pdf, {sqlsig('1 - exp(-x / m)')} AS cdf FROM p""")
def curve_points(spark, sf):
    return rounded(M.curve_points(E.estimate(values(spark, sf), "exponential")).drop("class_index"), ("criteria", "loi", "point"))


@query("fit_class_gamma_line", f"""
WITH {classes_sql(VALUES, N_MAX)},
xy AS (SELECT *, ln(c) AS px, {probit_sql("((i_rank - 0.3::DOUBLE) / (n + 0.4::DOUBLE))")} AS py FROM h),
ln AS (SELECT criteria, class_index, regr_slope(py, px) AS b1, regr_intercept(py, px) AS b0, regr_r2(py, px) AS r2 FROM xy GROUP BY 1, 2)
SELECT criteria, class_index, {sqlsig('1 / (b1 * b1)')} AS k_shape, {sqlsig('exp(-b0 * b1)')} AS theta_scale, {sqlsig('r2')} AS "R2" FROM ln""")
def fit_class_gamma_line(spark, sf):
    lines = C.fit_lines(C.class_histogram(values(spark, sf), N_MAX), "gamma")
    p = F.col("params")
    return rounded(lines.select("criteria", "class_index", p["k_shape"].alias("k_shape"), p["theta_scale"].alias("theta_scale"), "R2"),
                   ("criteria", "class_index"))


@query("fit_class_beta_line", f"""
WITH {classes_sql(PRICES, N_MAX)},
xy AS (SELECT *, (c - lo) / (hi - lo) AS px, {probit_sql("((i_rank - 0.3::DOUBLE) / (n + 0.4::DOUBLE))")} AS py FROM h)
SELECT criteria, class_index, {sqlsig('regr_r2(py, px)')} AS "R2" FROM xy GROUP BY 1, 2""")
def fit_class_beta_line(spark, sf):
    lines = C.fit_lines(C.class_histogram(prices(spark, sf), N_MAX), "beta")
    return rounded(lines.select("criteria", "class_index", "R2"), ("criteria", "class_index"))


@query("est_gamma_params", f"""
SELECT criteria, {sqlsig('avg(x) * avg(x) / var_samp(x)')} AS k_shape, {sqlsig('var_samp(x) / avg(x)')} AS theta_scale FROM ({VALUES}) GROUP BY 1""")
def est_gamma_params(spark, sf):
    p = F.col("params")
    return rounded(E.estimate(values(spark, sf), "gamma").select(
        "criteria", p["k_shape"].alias("k_shape"), p["theta_scale"].alias("theta_scale")), ("criteria",))


@query("est_beta_params", f"""
WITH s AS ({PRICES}), b AS (SELECT criteria, min(x) AS lo, max(x) AS hi FROM s GROUP BY 1),
u AS (SELECT criteria, greatest(least((x - lo) / (hi - lo), 1 - 1e-6), 1e-6) AS u FROM s JOIN b USING (criteria)),
m AS (SELECT criteria, avg(u) AS m, avg(u) * (1 - avg(u)) / var_samp(u) - 1 AS k FROM u GROUP BY 1)
SELECT criteria, {sqlsig('m * k')} AS alpha, {sqlsig('(1 - m) * k')} AS beta FROM m""")
def est_beta_params(spark, sf):
    p = F.col("params")
    return rounded(E.estimate(prices(spark, sf), "beta").select("criteria", p["alpha"].alias("alpha"), p["beta"].alias("beta")), ("criteria",))


@query("hist_rmse_closed", f"""
WITH s AS ({VALUES}),
b AS (SELECT criteria, count(*) AS n, min(x) AS lo, max(x) - min(x) AS w, avg(x) AS m, sqrt(var_pop(x)) AS sd,
             2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / cbrt(count(*)) AS fd FROM s GROUP BY 1),
k AS (SELECT *, CAST(ceil(w / least(greatest(fd, w / sqrt(n) / 2), w / (log2(n) + 1))) AS BIGINT) AS bins FROM b),
c AS (SELECT criteria, CAST(least(floor((x - lo) / w * bins), bins - 1) AS BIGINT) AS bin, count(*) AS f FROM s JOIN k USING (criteria) GROUP BY 1, 2),
e AS (SELECT k.*, unnest(range(0, bins)) AS bin FROM k),
d AS (SELECT e.criteria, m, sd, lo, lo + (bin + 0.5) * w / bins AS x, coalesce(f, 0) * bins / (n * w) AS y FROM e LEFT JOIN c USING (criteria, bin))
SELECT criteria, 'normal' AS law, {sqlsig("sqrt(avg(pow(y - exp(-(x - m) * (x - m) / (2 * sd * sd)) / (sd * 2.5066282746310002), 2)))")} AS rmse FROM d GROUP BY 1
UNION ALL SELECT criteria, 'exponential', {sqlsig("sqrt(avg(pow(y - exp(-(x - lo) / (m - lo)) / (m - lo), 2)))")} FROM d GROUP BY 1""")
def hist_rmse_closed(spark, sf):
    sample = values(spark, sf)
    return R.hist_rmse(sample, R.rank_laws(sample, ("normal", "exponential"))).withColumn("rmse", sig("rmse"))


@query("model_table_rows", f"""{SWEEP}, mt AS (
  SELECT criteria, class_index, 'class' AS method, class_index = best AS is_best, 'success' AS status, lambda_inv, data_mean, r2, q0, q1, q2, e0, e1, e2
  FROM m JOIN gt USING (criteria) WHERE class_index >= 5 AND NOT over
  UNION ALL SELECT criteria, NULL, 'estimation', true, 'fallback', mean, mean, NULL, q0, q1, q2, e0, e1, e2 FROM es)
SELECT '[USAGE] event values' AS study_title, '{{"table": "events"}}' AS sample_description, criteria, 'exponential' AS loi, class_index, method, is_best, status,
  {sqlsig('lambda_inv')} AS lambda_inv, {sqlsig('data_mean')} AS data_mean, {sqlsig('r2')} AS "R2", {sqlsig('q0')} AS "client1%",
  {sqlsig('q1')} AS "client50%", {sqlsig('q2')} AS "client99%", {sqlsig('e0')} AS "sample_client1%", {sqlsig('e1')} AS "sample_client50%",
  {sqlsig('e2')} AS "sample_client99%" FROM mt""")
def model_table_rows(spark, sf):
    models = M.model_sample(values(spark, sf), N_MAX, "exponential", threshold=2.0)
    table = M.model_table(models, "[USAGE] event values", {"table": "events"})
    lambda_inv = F.get_json_object("parameters", "$.lambda_inv").cast("double").alias("lambda_inv")
    return rounded(table.select("*", lambda_inv).drop("parameters", "data_min", "data_max"),
                   ("study_title", "sample_description", "criteria", "loi", "class_index", "method", "is_best", "status"))
