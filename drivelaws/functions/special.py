"""Gamma and beta functions in numpy, for the small per-criterion model tables only.

They run inside Arrow-batched pandas UDFs over one row per (criterion, class count); no sample
value ever reaches them.
"""

from __future__ import annotations

import math

import numpy as np

# From this shape on a law is so close to its bell that integrating the density is the safest way.
LARGE_SHAPE = 2000.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(128)


def _stirling_rest(x):
    """ln Gamma(x) less Stirling's formula, for x of ten and more."""
    w = 1.0 / (x * x)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / x


def lgamma(x):
    """Recurrence up to 10, then Stirling's series."""
    x = np.array(x, dtype=float, copy=True)
    product = np.ones_like(x)
    for _ in range(10):
        small = x < 10.0
        product = np.where(small, product * x, product)
        x = np.where(small, x + 1.0, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + _stirling_rest(x) - np.log(product)


def deviance(x, m):
    """x ln(x / m) + m - x without cancellation where x is near m."""
    x, m = np.broadcast_arrays(np.asarray(x, float), np.asarray(m, float))
    d = x - m
    v = d / (x + m)
    near = np.abs(v) < 0.1
    vn = np.where(near, v, 0.0)
    total, term = d * vn, 2 * x * vn
    for j in range(1, 12):
        term = term * vn * vn
        total = total + term / (2 * j + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0) / m), 0.0) - d
    return np.where(near, total, plain)


def _log_gamma_density(a, x):
    """ln of x times the density of the unit-scale gamma law, for a of ten and more."""
    return -deviance(a, x) + 0.5 * np.log(a / (2 * math.pi)) - _stirling_rest(a)


def _log_beta_density(a, b, x, rest):
    """ln of x (1 - x) times the density of the beta law, for shapes of ten and more; ``rest`` is 1 - x."""
    n = a + b
    return (-deviance(a, n * x) - deviance(b, n * rest) + 0.5 * np.log(a * b / (2 * math.pi * n))
            - _stirling_rest(a) - _stirling_rest(b) + _stirling_rest(n))


def _area(density, x, center, width):
    """Mass below x of a bell: the smaller tail by quadrature, from x to fourteen widths from the center."""
    below = x < center
    end = np.where(below, np.minimum(x, center - 14 * width), np.maximum(x, center + 14 * width))
    middle, half = 0.5 * (x + end), 0.5 * np.abs(end - x)
    values = density(middle[:, None] + half[:, None] * _NODES[None, :])
    tail = half * (values * _WEIGHTS).sum(1)
    return np.where(below, tail, 1.0 - tail)


def digamma(x):
    """Recurrence up to 10, then the asymptotic series."""
    x = np.array(x, dtype=float, copy=True)
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10.0
        shift = np.where(small, shift - 1.0 / np.where(small, x, 1.0), shift)
        x = np.where(small, x + 1.0, x)
    w = 1.0 / (x * x)
    series = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w * (1 / 132)))))
    return shift + np.log(x) - 0.5 / x - series


def trigamma(x):
    x = np.array(x, dtype=float, copy=True)
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10.0
        shift = np.where(small, shift + 1.0 / np.where(small, x * x, 1.0), shift)
        x = np.where(small, x + 1.0, x)
    w = 1.0 / (x * x)
    return shift + 1.0 / x + w / 2 + w / x * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w / 30)))


def gamma_cdf(a, x, rounds: int = 2000):
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above, the density's
    area for large shapes. NaN where a sum has not converged."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = np.isfinite(a) & (a > 0) & np.isfinite(x) & (x > 0)
    out[np.isfinite(a) & (a > 0) & (x <= 0)] = 0.0
    out[np.isfinite(a) & (a > 0) & (x == np.inf)] = 1.0
    large = ok & (a >= LARGE_SHAPE)
    if large.any():
        al = a[large]

        def density(x):
            held = np.where(x > 0, x, 1.0)
            return np.where(x > 0, np.exp(_log_gamma_density(al[:, None], held)) / held, 0.0)

        out[large] = _area(density, x[large], al, np.sqrt(al))
        ok = ok & ~large
    a_, x_ = a[ok], x[ok]
    front = np.exp(a_ * np.log(x_) - x_ - lgamma(a_)) if a_.size else np.empty(0)
    low = x_ < a_ + 1.0
    part = np.empty(a_.shape)
    if low.any():
        al, xl = a_[low], x_[low]
        term = total = 1.0 / al
        for k in range(1, rounds):
            term = term * xl / (al + k)
            total = total + term
            done = np.abs(term) <= 1e-16 * np.abs(total)
            if np.all(done):
                break
        part[low] = np.where(done, total * front[low], np.nan)
    if (~low).any():
        ah, xh = a_[~low], x_[~low]
        b = xh + 1.0 - ah
        c = np.full(ah.shape, 1e300)
        d = 1.0 / b
        h = d.copy()
        for k in range(1, rounds):
            an = -k * (k - ah)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            delta = d * c
            h = h * delta
            done = np.abs(delta - 1.0) < 1e-15
            if np.all(done):
                break
        part[~low] = np.where(done, 1.0 - front[~low] * h, np.nan)
    out[ok] = part
    return out


def beta_cdf(a, b, x, rounds: int = 2000):
    """Regularised incomplete beta by its continued fraction, or the density's area for large shapes. NaN
    where the fraction has not converged."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    sane = (a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b)
    out[sane & (x <= 0)] = 0.0
    out[sane & (x >= 1)] = 1.0
    ok = sane & (x > 0) & (x < 1)
    large = ok & (np.minimum(a, b) >= LARGE_SHAPE)
    if large.any():
        al, bl = a[large], b[large]
        center = al / (al + bl)

        def density(x):
            inside = (x > 0) & (x < 1)
            held = np.where(inside, x, 0.5)
            return np.where(inside, np.exp(_log_beta_density(al[:, None], bl[:, None], held, 1.0 - held)) / (held * (1.0 - held)), 0.0)

        out[large] = _area(density, x[large], center, np.sqrt(center * (1 - center) / (al + bl + 1)))
        ok = ok & ~large
    a_, b_, x_ = a[ok], b[ok], x[ok]
    if not a_.size:
        return out
    swap = x_ > (a_ + 1.0) / (a_ + b_ + 2.0)
    p, q = np.where(swap, b_, a_), np.where(swap, a_, b_)
    y = np.where(swap, 1.0 - x_, x_)
    front = np.exp(p * np.log(y) + q * np.log1p(-y) - (lgamma(p) + lgamma(q) - lgamma(p + q))) / p

    def guard(v):
        return np.where(np.abs(v) < 1e-300, 1e-300, v)

    c = np.ones_like(y)
    d = 1.0 / guard(1.0 - (p + q) * y / (p + 1.0))
    h = d.copy()
    for m in range(1, rounds):
        even = m * (q - m) * y / ((p + 2 * m - 1.0) * (p + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1.0))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        h = h * d * c
        done = np.abs(d * c - 1.0) < 1e-15
        if np.all(done):
            break
    lower = np.where(done, front * h, np.nan)
    out[ok] = np.where(swap, 1.0 - lower, lower)
    return out


def _invert(cdf, slope, p, low, high, rounds: int = 400):
    """Root of cdf(t) = p on a bracket: Newton steps, halving wherever one leaves the bracket;
    NaN where it does not settle."""
    low, high = low.copy(), high.copy()
    t = 0.5 * (low + high)
    for _ in range(rounds):
        gap = cdf(t) - p
        low, high = np.where(gap < 0, t, low), np.where(gap < 0, high, t)
        rate = slope(t)
        step = t - gap / np.where(rate > 1e-290, rate, np.nan)
        inside = (step > low) & (step < high)
        following = np.where(inside, step, 0.5 * (low + high))
        moved = np.abs(following - t)
        t = following
        if np.all(moved <= 4e-16 * (1.0 + np.abs(t))):
            break
    return np.where((moved <= 1e-11 * (1.0 + np.abs(t))) | (np.abs(gap) <= 1e-14), t, np.nan)


def gamma_ppf(a, p):
    """Quantile of the unit-scale gamma law, searched on ln x so small shapes keep precision."""
    a, p = np.broadcast_arrays(np.asarray(a, float), np.asarray(p, float))
    out = np.full(a.shape, np.nan)
    sane = np.isfinite(a) & (a > 0)
    out[sane & (p == 0)] = 0.0
    out[sane & (p == 1)] = np.inf
    ok = sane & (p > 0) & (p < 1)
    if ok.any():
        a_, p_ = a[ok], p[ok]
        norm = lgamma(a_)
        # P(a, x) <= x^a / Gamma(a + 1) bounds the root from below
        low = (np.log(p_) + lgamma(a_ + 1.0)) / a_ - 1e-9
        high = np.log(a_ + 40.0 * np.sqrt(a_) + 60.0)
        out[ok] = np.exp(_invert(
            lambda t: gamma_cdf(a_, np.exp(t)),
            lambda t: np.exp(np.where(a_ >= 10, _log_gamma_density(np.maximum(a_, 10.0), np.exp(t)), np.minimum(a_ * t - np.exp(t) - norm, 700.0))),
            p_, np.minimum(low, high - 1.0), high))
    return out


def beta_ppf(a, b, p):
    """Quantile of the beta law, searched on logit x."""
    a, b, p = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(p, float))
    out = np.full(a.shape, np.nan)
    sane = (a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b)
    out[sane & (p == 0)] = 0.0
    out[sane & (p == 1)] = 1.0
    ok = sane & (p > 0) & (p < 1)
    if ok.any():
        a_, b_, p_ = a[ok], b[ok], p[ok]
        norm = lgamma(a_) + lgamma(b_) - lgamma(a_ + b_)

        def unit(t):
            return 1.0 / (1.0 + np.exp(-t))

        edge = np.full(a_.shape, 700.0)
        out[ok] = unit(_invert(
            lambda t: beta_cdf(a_, b_, unit(t)),
            lambda t: np.exp(np.where(np.minimum(a_, b_) >= 10, _log_beta_density(np.maximum(a_, 10.0), np.maximum(b_, 10.0), unit(t), unit(-t)),
                                      np.minimum(-a_ * np.logaddexp(0.0, -t) - b_ * np.logaddexp(0.0, t) - norm, 700.0))),
            p_, -edge, edge))
    return out


def gamma_shape(s, rounds: int = 60):
    """Shape k with ln k - digamma(k) = s, by Newton on ln k."""
    s = np.asarray(s, dtype=float)
    k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(rounds):
        gap = np.log(k) - digamma(k) - s
        step = gap / (1.0 - k * trigamma(k))
        k = k * np.exp(-np.clip(step, -1.0, 1.0))
        if np.all(np.abs(step) < 1e-15):
            break
    return k


def beta_shapes(mean, var, mean_ln, mean_ln_rest, rounds: int = 200):
    """Maximum likelihood (alpha, beta) from the means of ln u and ln(1 - u)."""
    mean, var = np.asarray(mean, float), np.asarray(var, float)
    g1, g2 = np.asarray(mean_ln, float), np.asarray(mean_ln_rest, float)
    spread = np.where((var > 0) & (var < mean * (1 - mean)), mean * (1 - mean) / np.where(var > 0, var, 1.0) - 1.0, 1.0)
    a, b = mean * spread, (1 - mean) * spread
    for _ in range(rounds):
        both = digamma(a + b)
        f1, f2 = digamma(a) - both - g1, digamma(b) - both - g2
        t1, t2, t12 = trigamma(a), trigamma(b), trigamma(a + b)
        det = t1 * t2 - t12 * (t1 + t2)
        da = (f1 * (t2 - t12) + f2 * t12) / det
        db = (f2 * (t1 - t12) + f1 * t12) / det
        a = np.where(a - da > 0, a - da, a / 2)
        b = np.where(b - db > 0, b - db, b / 2)
        if np.all(np.abs(da) + np.abs(db) < 1e-13 * (a + b)):
            break
    return a, b
