"""Quantile, density and distribution of the usage laws as Column expressions.

A law's parameters travel as a ``map<string,double>`` column, so one model table can hold several
laws. Everything is JVM-side except the gamma and beta quantile and distribution, which are Arrow
batches of numpy over the model table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .special import beta_cdf, beta_ppf, gamma_cdf, gamma_ppf
from .normal import normal_cdf, normal_pdf, probit

# Names of the laws and of their parameters in stored models.
PARAMETERS: dict[str, tuple[str, ...]] = {
    "lognormal": ("slnx", "mulnx"),
    "normal": ("mu", "sigma"),
    "beta": ("alpha", "beta"),
    "weibull": ("beta_shape", "lambda_scale"),
    "gamma": ("k_shape", "theta_scale"),
    "exponential": ("lambda_inv",),
    "gumbel": ("loc", "scale"),
}
LAWS = tuple(law for law in PARAMETERS if law != "gumbel")
NUMPY_LAWS = ("beta", "gamma")

# Stirling series of ln Gamma, in falling odd powers of 1 / y.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def law_params(law: str, *values: Column) -> Column:
    """Parameter map of one law, in its declared order."""
    pairs = []
    for name, value in zip(PARAMETERS[law], values, strict=True):
        pairs += [F.lit(name), value.cast("double")]
    return F.create_map(*pairs)


def by_law(law: str | Column, branches: dict[str, Callable[[], Column]]) -> Column:
    """The branch of a law: picked now for a name, row by row for a column."""
    if isinstance(law, str):
        return branches[law]()
    picked = None
    for name, build in branches.items():
        picked = F.when(law == name, build()) if picked is None else picked.when(law == name, build())
    return picked


def lgamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series eight steps up, brought back by the recurrence."""
    y = x + F.lit(8.0)
    w = F.lit(1.0) / (y * y)
    series = reduce(lambda acc, c: acc * w + F.lit(c), STIRLING[-2::-1], F.lit(STIRLING[-1])) / y
    steps = reduce(lambda acc, i: acc * (x + F.lit(float(i))), range(1, 8), x)
    return (y - F.lit(0.5)) * F.ln(y) - y + F.lit(0.91893853320467274178) + series - F.ln(steps)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _heavy_quantiles(law: pd.Series, a: pd.Series, b: pd.Series, ps: pd.Series) -> pd.Series:
    if law.empty:
        return pd.Series([], dtype=object)
    grid = np.vstack(ps.to_numpy())
    shape, other = a.to_numpy(float), b.to_numpy(float)
    out = np.full(grid.shape, np.nan)
    for name, solve in (("gamma", lambda m: gamma_ppf(shape[m, None], grid[m]) * other[m, None]),
                        ("beta", lambda m: beta_ppf(shape[m, None], other[m, None], grid[m]))):
        mask = (law == name).to_numpy()
        if mask.any():
            out[mask] = solve(mask)
    return pd.Series([None if np.isnan(row).all() else row for row in out], dtype=object)


@F.pandas_udf(T.DoubleType())
def _heavy_cdf(law: pd.Series, a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    shape, other, at = a.to_numpy(float), b.to_numpy(float), x.to_numpy(float)
    out = np.full(len(at), np.nan)
    mask = (law == "gamma").to_numpy()
    out[mask] = gamma_cdf(shape[mask], at[mask] / other[mask])
    mask = (law == "beta").to_numpy()
    out[mask] = beta_cdf(shape[mask], other[mask], at[mask])
    return pd.Series(out)


def normal_score(p: float) -> float:
    edge = {0.0: float("-inf"), 1.0: float("inf")}
    return edge[p] if p in edge else NormalDist().inv_cdf(p)


def exp_score(p: float) -> float:
    """-ln(1 - p)."""
    return float("inf") if p == 1.0 else float(-np.log(1.0 - p))


def _at_score(law: str, params: Column) -> Callable[[Column], Column]:
    """Quantile of a closed-form law from its standard score: normal, exponential or Gumbel's."""
    return {
        "lognormal": lambda z: F.exp(params["mulnx"] + params["slnx"] * z),
        "normal": lambda z: params["mu"] + params["sigma"] * z,
        "weibull": lambda z: params["lambda_scale"] * F.pow(z, F.try_divide(F.lit(1.0), params["beta_shape"])),
        "exponential": lambda z: params["lambda_inv"] * z,
        "gumbel": lambda z: params["loc"] - params["scale"] * F.ln(z),
    }[law]


def _heavy_args(law: str | Column, params: Column) -> tuple[Column, Column, Column]:
    name = F.lit(law) if isinstance(law, str) else law
    return (name, F.coalesce(params["k_shape"], params["alpha"]),
            F.coalesce(params["theta_scale"], params["beta"]))


def quantiles(law: str | Column, params: Column, ps: Sequence[float], low: Column, high: Column,
              laws: Sequence[str] = LAWS) -> Column:
    """``array<double>`` of the quantiles at ``ps``; ``low``/``high`` bound the beta law.

    ``laws`` names what a ``law`` column can hold; without gamma and beta no Python runs.
    """
    wanted = (law,) if isinstance(law, str) else tuple(laws)
    closed = [name for name in wanted if name not in NUMPY_LAWS and name != "gumbel"]
    branches: dict[str, Callable[[], Column]] = {}
    scores = {
        "normal": F.array(*(F.lit(normal_score(float(p))) for p in ps)),
        "exp": F.array(*(F.lit(exp_score(float(p))) for p in ps)),
    }
    for name in closed:
        kind = "normal" if name in ("normal", "lognormal") else "exp"
        branches[name] = lambda name=name, kind=kind: F.transform(scores[kind], _at_score(name, params))
    if len(closed) < len(wanted):
        heavy = _heavy_quantiles(*_heavy_args(law, params), F.array(*(F.lit(float(p)) for p in ps)))
        branches["gamma"] = lambda: heavy
        branches["beta"] = lambda: F.transform(heavy, lambda q: low + q * (high - low))
    return by_law(law, {name: branches[name] for name in wanted})


def ppf(law: str, p: Column, params: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Quantile of one law at a probability column."""
    if law in NUMPY_LAWS:
        q = _heavy_quantiles(*_heavy_args(law, params), F.array(p))[0]
        return q if law == "gamma" or low is None else low + q * (high - low)
    if law in ("normal", "lognormal"):
        score = probit(p)
    elif law == "gumbel":
        score = -F.ln(p)
    else:
        score = F.when(p == 1.0, F.lit(float("inf"))).otherwise(-F.ln(F.lit(1.0) - p))
    return _at_score(law, params)(score)


def pdf(law: str | Column, x: Column, params: Column, low: Column | None = None,
        high: Column | None = None, laws: Sequence[str] = LAWS) -> Column:
    """Density; the beta law is read on [low, high] when given, else on [0, 1]."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def positive(density: Column) -> Column:
        return F.when(x > 0.0, density).otherwise(zero)

    def lognormal() -> Column:
        z = (F.ln(x) - params["mulnx"]) / params["slnx"]
        return positive(normal_pdf(z) / (x * params["slnx"]))

    def weibull() -> Column:
        c, scale = params["beta_shape"], params["lambda_scale"]
        t = x / scale
        return positive(c / scale * F.pow(t, c - one) * F.exp(-F.pow(t, c)))

    def gamma() -> Column:
        k, theta = params["k_shape"], params["theta_scale"]
        return positive(F.exp((k - one) * F.ln(x) - x / theta - k * F.ln(theta) - lgamma(k)))

    def beta() -> Column:
        a, b = params["alpha"], params["beta"]
        width = one if low is None else high - low
        u = x if low is None else (x - low) / width
        log_norm = lgamma(a) + lgamma(b) - lgamma(a + b)
        inside = F.exp((a - one) * F.ln(u) + (b - one) * F.ln(one - u) - log_norm) / width
        # at the ends the power is 0, 1 or infinite by its exponent
        edge = F.when(F.when(u == 0.0, a).otherwise(b) > 1.0, zero).when(
            F.when(u == 0.0, a).otherwise(b) < 1.0, F.lit(float("inf"))).otherwise(F.exp(-log_norm) / width)
        return F.when((u > 0.0) & (u < 1.0), inside).when((u == 0.0) | (u == 1.0), edge).otherwise(zero)

    def gumbel() -> Column:
        z = (x - params["loc"]) / params["scale"]
        return F.exp(-z - F.exp(-z)) / params["scale"]

    branches = {
        "lognormal": lognormal,
        "normal": lambda: normal_pdf((x - params["mu"]) / params["sigma"]) / params["sigma"],
        "weibull": weibull,
        "gamma": gamma,
        "beta": beta,
        "exponential": lambda: F.when(x >= 0.0, F.exp(-x / params["lambda_inv"]) / params["lambda_inv"]).otherwise(zero),
        "gumbel": gumbel,
    }
    return by_law(law, branches if isinstance(law, str) else {n: branches[n] for n in laws})


def cdf(law: str | Column, x: Column, params: Column, low: Column | None = None,
        high: Column | None = None, laws: Sequence[str] = LAWS) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    wanted = (law,) if isinstance(law, str) else tuple(laws)
    branches: dict[str, Callable[[], Column]] = {
        "lognormal": lambda: F.when(x > 0.0, normal_cdf((F.ln(x) - params["mulnx"]) / params["slnx"])).otherwise(zero),
        "normal": lambda: normal_cdf((x - params["mu"]) / params["sigma"]),
        "weibull": lambda: F.when(
            x > 0.0, one - F.exp(-F.pow(x / params["lambda_scale"], params["beta_shape"]))).otherwise(zero),
        "exponential": lambda: F.when(x > 0.0, one - F.exp(-x / params["lambda_inv"])).otherwise(zero),
        "gumbel": lambda: F.exp(-F.exp(-(x - params["loc"]) / params["scale"])),
    }
    if any(name in NUMPY_LAWS for name in wanted):
        name, a, b = _heavy_args(law, params)
        scaled = x if low is None else F.when(name == "beta", (x - low) / (high - low)).otherwise(x)
        heavy = _heavy_cdf(name, a, b, scaled)
        branches["gamma"] = branches["beta"] = lambda: heavy
    return by_law(law, {n: branches[n] for n in wanted})
