"""Random unit effects in balanced panels, from the cross-products within and between units.

With T periods a unit's mean has variance sigma2 / T + sigma_alpha2 and what is left of its rows
has sigma2, so the likelihood with the effects integrated out needs two Gram matrices only: the
total and that of unit means. All rows stay in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import slice_sample
from ..operators.gram import Gram
from ..operators.lags import spatial_lag
from .priors import half_t


@dataclass
class RandomKernel:
    """Blocks of [y, Wy, Z] within and between units; a lag process or none."""

    process: str
    names: list[str]
    within: np.ndarray
    between: np.ndarray
    n_units: int
    periods: int
    mean: np.ndarray
    precision: np.ndarray
    shape: float
    scale: float
    low: float
    high: float
    jacobian: object
    unit_scale: float
    unit_nu: float = 1.0

    def parts(self, g: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, float]:
        zz, zy = g[2:, 2:], g[2:, 0] - r * g[2:, 1]
        return zz, zy, g[0, 0] - 2 * r * g[0, 1] + r * r * g[1, 1]

    def posterior(self, r: float, s2: float, a2: float) -> tuple[np.ndarray, np.ndarray, float]:
        v = s2 + self.periods * a2
        (zz, zy, yy), (bzz, bzy, byy) = self.parts(self.within, r), self.parts(self.between, r)
        return zz / s2 + bzz / v + np.diag(self.precision), zy / s2 + bzy / v + self.precision * self.mean, yy / s2 + byy / v

    def log_density(self, r: float, log_s2: float, log_a: float) -> float:
        """log p(r, log sigma2, log sigma_alpha), beta and the effects integrated out."""
        s2, a2 = np.exp(log_s2), np.exp(2 * log_a)
        p, b, yy = self.posterior(r, s2, a2)
        c = np.linalg.cholesky(p)
        u = np.linalg.solve(c, b)
        n, t = self.n_units, self.periods
        fixed = -n * (t - 1) / 2 * log_s2 - n / 2 * np.log(s2 + t * a2) - self.shape * log_s2 - self.scale / s2
        prior = log_a + half_t(np.sqrt(a2), self.unit_nu, self.unit_scale)
        jac = t * float(self.jacobian(r)) if self.jacobian is not None else 0.0
        return jac + fixed + prior - yy / 2 - np.log(np.diag(c)).sum() + 0.5 * u @ u

    def run(self, draws: int, tune: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        r, s, a = 0.0, np.log(self.scale), 0.5 * np.log(self.scale / 4)
        out = np.empty((draws, 3 + len(self.names)))
        for i in range(tune + draws):
            if self.process == "lag":
                r = slice_sample(lambda x: self.log_density(x, s, a), r, self.low, self.high, 0.1, rng)
            s = slice_sample(lambda x: self.log_density(r, x, a), s, s - 20, s + 20, 0.3, rng)
            a = slice_sample(lambda x: self.log_density(r, s, x), a, -12.0, a + 10, 0.5, rng)
            p, b, _ = self.posterior(r, np.exp(s), np.exp(2 * a))
            c = np.linalg.cholesky(p)
            beta = np.linalg.solve(c.T, np.linalg.solve(c, b)) + np.linalg.solve(c.T, rng.standard_normal(len(b)))
            if i >= tune:
                out[i - tune] = [r, np.exp(s / 2), np.exp(a), *beta]
        return out


@dataclass
class ErrorKernel:
    """An error process with random effects: y_t = Z_t b + a + u_t, u_t = (I - lam W) ^-1 e_t.

    ``within`` are cross-products of [y, Z] and their lags, less unit means; ``means`` the unit means
    of [y, Z], a row for each unit; W is dense.
    """

    names: list[str]
    within: np.ndarray
    lagged: np.ndarray
    both: np.ndarray
    means: np.ndarray
    w: np.ndarray
    periods: int
    mean: np.ndarray
    precision: np.ndarray
    shape: float
    scale: float
    low: float
    high: float
    jacobian: object
    unit_scale: float
    unit_nu: float = 1.0

    def run(self, draws: int, tune: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        n, t, k = len(self.means), self.periods, len(self.names)
        a, lam, s2, sa2, aux = np.zeros(n), 0.0, float(self.scale), float(self.scale) / 2, 1.0
        out = np.empty((draws, 3 + k))

        def moments(lam, a):
            """Cross-products of B[y - a, Z] over all rows."""
            g = self.within - lam * (self.both + self.both.T) + lam * lam * self.lagged
            m = self.means.copy()
            m[:, 0] -= a
            m = m - lam * (self.w @ m)
            return g + t * m.T @ m

        def density(lam, a=None, s2=None, sa2=None):
            g = moments(lam, a)
            p = g[1:, 1:] / s2 + np.diag(self.precision)
            b = g[1:, 0] / s2 + self.precision * self.mean
            c = np.linalg.cholesky(p)
            u = np.linalg.solve(c, b)
            return float(t * self.jacobian(lam) - g[0, 0] / (2 * s2) - np.log(np.diag(c)).sum() + 0.5 * u @ u)

        for i in range(tune + draws):
            lam = slice_sample(lambda x: density(x, a, s2, sa2), lam, self.low, self.high, 0.2, rng)
            g = moments(lam, a)
            c = np.linalg.cholesky(g[1:, 1:] / s2 + np.diag(self.precision))
            beta = np.linalg.solve(c.T, np.linalg.solve(c, g[1:, 0] / s2 + self.precision * self.mean) + rng.standard_normal(k))
            v = np.r_[1.0, -beta]
            s2 = (self.scale + max(v @ g @ v, 0.0) / 2) / rng.gamma(self.shape + n * t / 2)
            b = np.eye(n) - lam * self.w
            r = b @ (self.means @ v)
            q = np.linalg.cholesky(t * b.T @ b / s2 + np.eye(n) / sa2)
            a = np.linalg.solve(q.T, np.linalg.solve(q, t * b.T @ r / s2) + rng.standard_normal(n))
            # A half-t as a mixture of inverse gammas.
            aux = (1 / self.unit_scale**2 + self.unit_nu / sa2) / rng.gamma((self.unit_nu + 1) / 2)
            sa2 = (self.unit_nu / aux + a @ a / 2) / rng.gamma((self.unit_nu + n) / 2)
            if i >= tune:
                out[i - tune] = [lam, np.sqrt(s2), np.sqrt(sa2), *beta]
        return out


def error_fit(model: str, panel: DataFrame, edges: DataFrame, y: str, xs: list[str], key: str, time: str, priors, draws: int, tune: int, n_chains: int, seed: int, method: str, most: int) -> DataFrame:
    """Draws (chain, draw, lam, sigma, sigma_alpha, coefficients) of SEM or SDEM with random effects."""
    from .gaussian import chains
    from .logdet import dense, index_of, log_det

    work, terms = panel.withColumn("_const", F.lit(1.0)), ["_const", *xs]
    if model == "SDEM":
        work = spatial_lag(work, edges, xs, key=key, over=[time])
        terms += [f"W_{x}" for x in xs]
    columns = [y, *terms]
    work = spatial_lag(work, edges, columns, key=key, over=[time], prefix="V_")
    every = [*columns, *[f"V_{c}" for c in columns]]
    means = work.groupBy(key).agg(*[F.avg(c).alias(c) for c in every])
    ids = index_of(panel, key, most)
    rows = {r[key]: r for r in means.collect()}
    m = np.array([[rows[i][c] for c in columns] for i in ids])
    t = panel.select(time).distinct().count()
    total, between = Gram.of(work, every), Gram.of(means, every)
    g = total.get(every, every) - t * between.get(every, every)
    size = len(columns)
    n = total.n
    moment = total.get([*columns], ["_one"])[:, 0] / n
    var = np.diag(total.get(columns, columns)) / n - moment**2
    spread = np.sqrt(np.maximum(var[1:], 0.0))
    mean, sd = priors.coefficients(moment[0], np.sqrt(var[0]), n, spread, var[1:] <= 1e-12 * np.maximum(1.0, moment[1:] ** 2))
    names = ["_one", *terms[1:]]
    kernel = ErrorKernel(names, g[:size, :size], g[size:, size:], g[:size, size:], m, dense(edges, ids, most), t, mean, 1 / sd**2, priors.sigma_shape, priors.sigma_scale or float(var[0]), priors.low, priors.high, log_det(panel, edges, priors.low, priors.high, key, method), priors.unit_scale or float(np.sqrt(var[0])), priors.unit_nu)
    return chains(panel.sparkSession, kernel, ["lam", "sigma", "sigma_alpha", *names], draws, tune, n_chains, seed)


def fit(model: str, panel: DataFrame, edges: DataFrame, y: str, xs: list[str], key: str = "unit", time: str = "time", priors=None, draws: int = 1000, tune: int = 500, n_chains: int = 4, seed: int = 0, method: str = "auto", most: int = 2000) -> DataFrame:
    """Draws (chain, draw, [rho|lam,] sigma, sigma_alpha, coefficients) with random effects.

    OLS and SAR integrate the effects out and take cross-products alone; SEM and SDEM, whose filter
    mixes the effects, draw them, for ``most`` units at most.
    """
    from .gaussian import chains, checked
    from .logdet import log_det
    from .spec import SPECS, Priors, validate

    spec = SPECS[model]
    validate(spec, "random", None, True)
    priors = Priors.of(priors, model, panel=True, effects="random")
    size = panel.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("u"), F.count_distinct(time).alias("t")).first()
    if size["n"] != size["u"] * size["t"] or size["t"] < 2:
        raise ValueError("random effects need a balanced panel of two periods at least")
    checked(panel, edges, [y, *xs], key, time, balanced=True)
    if spec.process == "error":
        return error_fit(model, panel, edges, y, xs, key, time, priors, draws, tune, n_chains, seed, method, most)
    lagged = spatial_lag(panel, edges, [y], key=key, over=[time]).withColumn("_const", F.lit(1.0))
    columns = [y, f"W_{y}", "_const", *xs]
    means = lagged.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
    total, between = Gram.of(lagged, columns), Gram.of(means, columns)
    b = between.get(columns, columns) * size["t"]
    w = total.get(columns, columns) - b
    var = total.get([y], [y])[0, 0] / size["n"] - (total.get([y], ["_one"])[0, 0] / size["n"]) ** 2
    mx = total.get(["_const", *xs], ["_one"])[:, 0] / size["n"]
    vx = np.diag(total.get(["_const", *xs], ["_const", *xs])) / size["n"] - mx**2
    mean, sd = priors.coefficients(total.get([y], ["_one"])[0, 0] / size["n"], np.sqrt(var), size["n"], np.sqrt(np.maximum(vx, 0.0)), vx <= 1e-12 * np.maximum(1.0, mx**2))
    jacobian = log_det(panel, edges, priors.low, priors.high, key, method) if spec.process == "lag" else None
    names = ["_one", *xs]
    kernel = RandomKernel(spec.process, names, w, b, size["u"], size["t"], mean, 1 / sd**2, priors.sigma_shape, priors.sigma_scale or var, priors.low, priors.high, jacobian, priors.unit_scale or float(np.sqrt(var)), priors.unit_nu)
    out = chains(panel.sparkSession, kernel, ["rho", "sigma", "sigma_alpha", *names], draws, tune, n_chains, seed)
    return out if spec.process == "lag" else out.drop("rho")
