"""SQL text of the numeric recipes, written out independently for the second engine."""

from __future__ import annotations

from statistics import NormalDist

from drivelaws.functions import normal as N

MARKS = [m / 100 for m in range(0, 100, 5)]
CUSTOMERS = (0.01, 0.5, 0.99)


def horner(x: str, coefficients) -> str:
    text = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        text = f"({text} * ({x}) + ({c!r}::DOUBLE))"
    return text


def probit_sql(p: str) -> str:
    q = f"(({p}) - 0.5::DOUBLE)"
    inner = f"(0.180625::DOUBLE - {q} * {q})"
    depth = f"sqrt(-ln(least(({p}), 1 - ({p}))))"
    centre = f"{q} * {horner(inner, N.CENTRE_NUM)} / {horner(inner, N.CENTRE_DEN)}"
    near, far = f"({depth} - 1.6::DOUBLE)", f"({depth} - 5::DOUBLE)"
    tail = (f"CASE WHEN {depth} <= 5 THEN {horner(near, N.TAIL_NUM)} / {horner(near, N.TAIL_DEN)} "
            f"ELSE {horner(far, N.FAR_NUM)} / {horner(far, N.FAR_DEN)} END")
    return (f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN abs({q}) <= 0.425 THEN {centre} "
            f"ELSE sign({q}) * ({tail}) END)")


def normal_cdf_sql(z: str) -> str:
    a = f"abs({z})"
    close = f"exp(-{a} * {a} / 2) * {horner(a, N.HART_NUM)} / {horner(a, N.HART_DEN)}"
    chain = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        chain = f"({a} + {k}.0 / {chain})"
    upper = f"(CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547 THEN {close} ELSE exp(-{a} * {a} / 2) / {chain} / 2.5066282746310002 END)"
    return f"(CASE WHEN ({z}) > 0 THEN 1 - {upper} ELSE {upper} END)"


def classes_sql(sample: str, n_max: int, n_min: int = 2) -> str:
    """CTEs s, b, g, h: sample, bounds, classes, counts below each limit by comparison with every row."""
    return f"""
s AS ({sample}),
b AS (SELECT criteria, count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mean FROM s GROUP BY 1),
g AS (SELECT CAST(k AS INTEGER) AS class_index, CAST(i AS INTEGER) AS i FROM range({n_min}, {n_max + 1}) t(k), range(0, {n_max}) u(i) WHERE i < k),
l AS (SELECT b.*, g.*, lo + (hi - lo) * ((9::DOUBLE + 10::DOUBLE * i) / (10::DOUBLE * class_index - 2)) AS c FROM b, g WHERE hi > lo),
h AS (SELECT l.criteria, l.class_index, l.i, any_value(l.n) AS n, any_value(l.lo) AS lo, any_value(l.hi) AS hi, any_value(l.mean) AS mean,
             any_value(l.c) AS c, count(s.x) AS i_rank
      FROM l LEFT JOIN s ON s.criteria = l.criteria AND s.x < l.c GROUP BY 1, 2, 3)"""


# x, y of the fitted line, then parameters and the quantile at probability {p} / normal score {z}
LAWS = {
    "lognormal": ("ln(c)", probit_sql("f"), {"slnx": "1 / b1", "mulnx": "-b0 / b1"}, "exp(mulnx + slnx * ({z}))"),
    "normal": ("c", probit_sql("f"), {"mu": "-b0 / b1", "sigma": "1 / b1"}, "(mu + sigma * ({z}))"),
    "weibull": ("ln(c)", "ln(-ln(1 - f))", {"beta_shape": "b1", "lambda_scale": "exp(-b0 / b1)"},
                "(lambda_scale * pow(-ln(1 - {p}), 1 / beta_shape))"),
    "exponential": ("c", "-ln(1 - f)", {"lambda_inv": "1 / b1"}, "(lambda_inv * -ln(1 - {p}))"),
}


def at(quantile: str, p: float) -> str:
    z = "'-infinity'::DOUBLE" if p == 0 else f"{NormalDist().inv_cdf(p)!r}::DOUBLE"
    return quantile.format(p=f"{p!r}::DOUBLE", z=z)


def models_sql(sample: str, law: str, n_max: int, marks=MARKS, n_min: int = 2) -> str:
    """CTEs up to m: class fits with fitted and empirical customers, MSE and mean difference."""
    x, y, params, quantile = LAWS[law]
    ps = [*CUSTOMERS, *marks]
    fit = ", ".join(f"{at(quantile, p)} AS q{j}" for j, p in enumerate(ps))
    emp = ", ".join(f"quantile_cont(x, {p!r}) AS e{j}" for j, p in enumerate(ps))
    grid = range(len(CUSTOMERS), len(ps))
    mse = " + ".join(f"(e{j} - q{j}) * (e{j} - q{j})" for j in grid)
    mrd = " + ".join(f"abs(100 * (q{j} - e{j}) / e{j})" for j in grid)
    return f"""{classes_sql(sample, n_max, n_min)},
pt AS (SELECT *, (i_rank - 0.3::DOUBLE) / (n + 0.4::DOUBLE) AS f FROM h),
xy AS (SELECT *, {x} AS px, {y} AS py FROM pt),
ln AS (SELECT criteria, class_index, any_value(n) AS n, any_value(lo) AS data_min, any_value(hi) AS data_max, any_value(mean) AS data_mean,
              regr_slope(py, px) AS b1, regr_intercept(py, px) AS b0, regr_r2(py, px) AS r2 FROM xy GROUP BY 1, 2),
pr AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in params.items())} FROM ln),
ft AS (SELECT *, {fit} FROM pr),
em AS (SELECT criteria, {emp} FROM s GROUP BY 1),
m AS (SELECT ft.*, em.* EXCLUDE (criteria), ({mse}) / {len(grid)} AS mse, ({mrd}) / {len(grid)} AS mrd,
             100 * (q0 - e0) / e0 AS d0, 100 * (q1 - e1) / e1 AS d1, 100 * (q2 - e2) / e2 AS d2
      FROM ft JOIN em USING (criteria))"""
