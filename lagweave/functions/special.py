"""Special functions and samplers in numpy, for what Spark SQL and numpy lack."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)


def gammaln(x) -> np.ndarray:
    """log Gamma for x > 0: shifted to 10 and more, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    z = x.copy()
    while (low := z < 10).any():
        shift = np.where(low, shift + np.log(np.where(low, z, 1.0)), shift)
        z = np.where(low, z + 1, z)
    i = 1 / z
    series = i * (1 / 12 - i**2 * (1 / 360 - i**2 * (1 / 1260 - i**2 / 1680)))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def digamma(x) -> np.ndarray:
    z = np.asarray(x, float).copy()
    out = np.zeros_like(z)
    while (low := z < 10).any():
        out = np.where(low, out - 1 / np.where(low, z, 1.0), out)
        z = np.where(low, z + 1, z)
    i2 = 1 / z**2
    return out + np.log(z) - 0.5 / z - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 / 240)))


def ndtr(x) -> np.ndarray:
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def log_ndtr(x) -> np.ndarray:
    """log of the Normal distribution function; a continued fraction below -10."""
    x = np.asarray(x, float)
    near = np.log(np.maximum(ndtr(np.maximum(x, -10)), 1e-300))
    t = np.maximum(-x, 10.0)
    f = t
    for k in range(40, 0, -1):
        f = t + k / f
    return np.where(x > -10, near, -0.5 * t**2 - 0.5 * math.log(2 * math.pi) - np.log(f))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square: the regularized incomplete gamma by series or continued fraction."""
    if not x > 0:
        return 1.0
    a, x = df / 2, x / 2
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * lead)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def logsumexp(x: np.ndarray, axis: int = 0) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def normal_logpdf(e, sigma) -> np.ndarray:
    return -0.5 * (np.asarray(e) / sigma) ** 2 - np.log(sigma) - 0.5 * math.log(2 * math.pi)


def student_logpdf(e, sigma: float, nu: float) -> np.ndarray:
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(sigma)
    return c - (nu + 1) / 2 * np.log1p((np.asarray(e) / sigma) ** 2 / nu)


def negbin_logpmf(y, eta, alpha) -> np.ndarray:
    """NB2 with mean exp(eta) and size alpha."""
    y, eta = np.asarray(y, float), np.asarray(eta, float)
    log_sum = np.logaddexp(np.log(alpha), eta)
    return gammaln(y + alpha) - gammaln(alpha) - gammaln(y + 1.0) + alpha * (np.log(alpha) - log_sum) + y * (eta - log_sum)


def negbin_log_zero(eta, alpha) -> np.ndarray:
    """log P(0) of NB2."""
    return alpha * (np.log(alpha) - np.logaddexp(np.log(alpha), np.asarray(eta, float)))


def zinb_logpmf(y, eta, alpha, activation) -> np.ndarray:
    """Zeros come from inactivity (probability 1 - activation) or from the counts."""
    y = np.asarray(y)
    active = np.log(activation) + negbin_logpmf(y, eta, alpha)
    return np.where(y == 0, np.logaddexp(np.log1p(-activation), active), active)


def hurdle_logpmf(y, eta, alpha, positive) -> np.ndarray:
    """Positive counts from a zero-truncated NB2."""
    y = np.asarray(y)
    above = np.log(positive) + negbin_logpmf(y, eta, alpha) - np.log(-np.expm1(negbin_log_zero(eta, alpha)))
    return np.where(y == 0, np.log1p(-positive), above)


def truncated_normal(mean, positive, rng) -> np.ndarray:
    """Unit-variance normals that are positive where ``positive`` holds, else negative."""
    mean = np.asarray(mean, float)
    sign = np.where(positive, 1.0, -1.0)
    low = -sign * mean  # what a standard normal has to exceed
    out, left = np.empty(len(mean)), np.arange(len(mean))
    tail = low > 0.5
    while len(left):
        b, far = low[left], tail[left]
        rate = np.where(far, (b + np.sqrt(b * b + 4)) / 2, 1.0)
        x = np.where(far, b + rng.exponential(size=len(left)) / rate, rng.standard_normal(len(left)))
        keep = np.where(far, rng.random(len(left)) < np.exp(-((x - rate) ** 2) / 2), x > b)
        out[left[keep]] = x[keep]
        left = left[~keep]
    return mean + sign * out


def _pg_one(z: np.ndarray, rng) -> np.ndarray:
    """PG(1, z) by Devroye's alternating series with the split at 0.64."""
    z = np.abs(z) / 2
    cut = 0.64
    k = math.pi**2 / 8 + z**2 / 2
    p = math.pi / 2 / k * np.exp(-k * cut)
    b, a = math.sqrt(1 / cut) * (cut * z - 1), -math.sqrt(1 / cut) * (cut * z + 1)
    q = 2 * np.exp(-z) * (ndtr(b) + np.exp(2 * z + log_ndtr(a)))
    out, left = np.empty(len(z)), np.arange(len(z))
    while len(left):
        x = np.empty(len(left))
        right = rng.random(len(left)) < (p / (p + q))[left]
        x[right] = cut + rng.exponential(size=right.sum()) / k[left[right]]
        x[~right] = _inverse_gaussian_below(z[left[~right]], cut, rng)
        s = _pg_term(0, x, cut)
        y = rng.random(len(left)) * s
        state, n = np.zeros(len(left), int), 0
        while (state == 0).any():
            n += 1
            s = s + (-1) ** n * _pg_term(n, x, cut)
            state = np.where(state != 0, state, np.where((n % 2 == 1) & (y <= s), 1, np.where((n % 2 == 0) & (y > s), 2, 0)))
        good = state == 1
        out[left[good]] = x[good] / 4
        left = left[~good]
    return out


def _pg_term(n: int, x: np.ndarray, cut: float) -> np.ndarray:
    c = math.pi * (n + 0.5)
    return np.where(x > cut, c * np.exp(-c * c * x / 2), (2 / math.pi / x) ** 1.5 * c * np.exp(-2 * (n + 0.5) ** 2 / x))


def _inverse_gaussian_below(z: np.ndarray, cut: float, rng) -> np.ndarray:
    """Inverse Gaussian with mean 1/z and shape 1, below ``cut``."""
    out, left = np.empty(len(z)), np.arange(len(z))
    while len(left):
        v = z[left]
        small = v < 1 / cut
        x = np.empty(len(left))
        n = small.sum()
        if n:
            e = np.empty((2, n))
            todo = np.arange(n)
            while len(todo):
                e[:, todo] = rng.exponential(size=(2, len(todo)))
                todo = todo[e[0, todo] ** 2 > 2 * e[1, todo] / cut]
            x[small] = cut / (1 + cut * e[0]) ** 2
        big = ~small
        if big.any():
            mu = 1 / v[big]
            y = rng.standard_normal(big.sum()) ** 2
            g = mu + mu**2 * y / 2 - mu / 2 * np.sqrt(4 * mu * y + (mu * y) ** 2)
            x[big] = np.where(rng.random(len(g)) > mu / (mu + g), mu**2 / g, g)
        keep = np.where(small, rng.random(len(left)) < np.exp(-(v**2) * x / 2), x < cut)
        out[left[keep]] = x[keep]
        left = left[~keep]
    return out


def polya_gamma(shape, z, rng, terms: int = 200) -> np.ndarray:
    """PG(shape, z).

    Whole shapes up to 12 are sums of exact draws; the rest of a shape is a sum of gammas with
    ``terms`` terms, whose remainder is drawn with its exact mean and variance.
    """
    shape, z = np.broadcast_arrays(np.asarray(shape, float), np.asarray(z, float))
    whole = np.where(shape <= 12, np.floor(shape), 0).astype(int)
    out = np.zeros(len(z))
    for k in range(int(whole.max(initial=0))):
        some = whole > k
        out[some] += _pg_one(z[some], rng)
    rest = shape - whole
    some = np.flatnonzero(rest > 1e-12)
    if len(some):
        b, v = rest[some], z[some]
        d = (np.arange(terms)[None] + 0.5) ** 2 + (v[:, None] / (2 * math.pi)) ** 2
        out[some] += (rng.gamma(b[:, None], 1.0, (len(some), terms)) / d).sum(1) / (2 * math.pi**2)
        mean = pg_mean(b, v) - (b[:, None] / d).sum(1) / (2 * math.pi**2)
        var = np.maximum(pg_variance(b, v) - (b[:, None] / d**2).sum(1) / (4 * math.pi**4), 1e-300)
        out[some] += rng.gamma(np.maximum(mean, 1e-300) ** 2 / var, 1.0) * var / np.maximum(mean, 1e-300)
    return out


def pg_mean(b, z) -> np.ndarray:
    z = np.abs(np.asarray(z, float))
    return np.where(z < 1e-4, np.asarray(b) / 4, np.asarray(b) * np.tanh(z / 2) / (2 * np.maximum(z, 1e-4)))


def pg_variance(b, z) -> np.ndarray:
    z = np.maximum(np.abs(np.asarray(z, float)), 1e-3)
    return np.asarray(b) * (np.tanh(z / 2) / z**3 / 2 - 1 / (4 * z**2 * np.cosh(np.minimum(z, 600) / 2) ** 2))


def slice_sample(log_density, x0: float, low: float, high: float, width: float, rng, steps: int = 50) -> float:
    """One draw by stepping out and shrinking, inside (low, high)."""
    level = log_density(x0) - rng.exponential()
    left = max(low, x0 - width * rng.random())
    right = min(high, left + width)
    for _ in range(steps):
        if left <= low or log_density(left) <= level:
            break
        left = max(low, left - width)
    for _ in range(steps):
        if right >= high or log_density(right) <= level:
            break
        right = min(high, right + width)
    for _ in range(500):
        x = left + (right - left) * rng.random()
        f = log_density(x)
        if f > level:
            return x
        if x < x0:
            left = x
        else:
            right = x
    return x0
