"""Gaussian origin-destination models from one Gram matrix of flows and their three lags."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..diagnostics import posterior
from ..functions.special import chi2_sf, slice_sample
from ..operators import weights
from ..operators.gram import Gram, ols
from ..operators.lags import flow_lags
from .gaussian import chains
from .logdet import dense, flow_log_det, index_of
from .solves import unrestricted_solve
from .spec import Priors

LAGS = ["Wd", "Wo", "Ww"]


@dataclass
class FlowKernel:
    """Cross-products of y, X and their lags by Wd, Wo and Ww; ``separable`` ties rho_w to -rho_d rho_o.

    yy[m, n] is the product of lags m and n of y, xy[m, n] that of lag m of X and n of y, and so on;
    an error process filters X as well.
    """

    yy: np.ndarray
    xy: np.ndarray
    xx: np.ndarray
    error: bool
    n: int
    eigenvalues: np.ndarray
    precision: np.ndarray
    mean: float
    shape: float
    scale: float
    separable: bool
    spatial: bool
    times: float

    def coefficients(self, r: np.ndarray) -> np.ndarray:
        return np.array([1.0, -r[0], -r[1], r[0] * r[1] if self.separable else -r[2]])

    def parts(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.error:
            return np.einsum("m,n,mnij->ij", c, c, self.xx), np.einsum("m,n,mni->i", c, c, self.xy)
        return self.xx[0, 0], c @ self.xy[0]

    def log_density(self, r: np.ndarray, s2: float) -> float:
        if not self.separable and np.abs(r).sum() >= 1:
            return -np.inf
        c = self.coefficients(r)
        zz, zy = self.parts(c)
        p = zz / s2 + np.diag(self.precision)
        b = zy / s2 + self.precision * self.mean
        low = np.linalg.cholesky(p)
        u = np.linalg.solve(low, b)
        return self.times * flow_log_det(self.eigenvalues, r[0], r[1], -c[3]) - c @ self.yy @ c / (2 * s2) - np.log(np.diag(low)).sum() + 0.5 * u @ u

    def run(self, draws: int, tune: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        r, k = np.zeros(3), self.xx.shape[-1]
        beta = np.linalg.solve(self.xx[0, 0] + 1e-9 * np.eye(k), self.xy[0, 0])
        out = np.empty((draws, 4 + len(beta)))
        for i in range(tune + draws):
            c = self.coefficients(r)
            zz, zy = self.parts(c)
            rss = max(c @ self.yy @ c - 2 * beta @ zy + beta @ zz @ beta, 1e-12)
            s2 = (self.scale + rss / 2) / rng.gamma(self.shape + self.n / 2)
            for k in range(2 if self.separable else 3) if self.spatial else ():

                def along(x, k=k, r=r, s2=s2):
                    z = r.copy()
                    z[k] = x
                    return self.log_density(z, s2)

                r = r.copy()
                r[k] = slice_sample(along, r[k], -0.999, 0.999, 0.2, rng)
            c = self.coefficients(r)
            zz, zy = self.parts(c)
            low = np.linalg.cholesky(zz / s2 + np.diag(self.precision))
            m = np.linalg.solve(low.T, np.linalg.solve(low, zy / s2 + self.precision * self.mean))
            beta = m + np.linalg.solve(low.T, rng.standard_normal(len(m)))
            if i >= tune:
                out[i - tune] = [r[0], r[1], -c[3], np.sqrt(s2), *beta]
        return out


class Shocks:
    """What unit shocks to each region do to flows, in the eigenvectors of W: n^2 terms a draw.

    Called with rho_d, rho_o, rho_w it gives, for shocks to destinations, origins and own flows of
    region j (summed over j): the sum over all flows, the own flow's, that of origin j, of dest j.
    """

    def __init__(self, w: np.ndarray):
        self.values, v = np.linalg.eig(w)
        back = np.linalg.inv(v)
        own = v * back.T
        self.p, self.t = back.sum(1), v.sum(0)
        self.first, self.second = v.T @ own, own.T @ v
        self.cross, self.square = back @ back.T, own.T @ own
        self.rows, self.columns = own.T @ back.T, back @ own

    def __call__(self, rd: float, ro: float, rw: float) -> np.ndarray:
        a, b = self.values[:, None], self.values[None, :]
        c = 1 / (1 - ro * a - rd * b - rw * a * b)
        p, t, pt = self.p, self.t, self.p * self.t
        diagonal = (np.diag(c) * pt).sum()
        every = pt @ c @ pt
        out = [
            [every, (c * p[:, None] * self.first).sum(), diagonal, (pt @ c).sum()],
            [every, (c * p[None] * self.second).sum(), (c @ pt).sum(), diagonal],
            [(c * self.cross * t[:, None] * t[None]).sum(), (c * self.square).sum(), (c * t[None] * self.rows).sum(), (c * t[:, None] * self.columns).sum()],
        ]
        return np.array(out).real


class FlowFit:
    def __init__(self, draws: DataFrame, terms: list[str], n: int, w: np.ndarray, spatial: bool):
        self.draws, self.terms, self.n, self.w, self.spatial = draws, terms, n, w, spatial

    def parameters(self) -> list[str]:
        return [c for c in self.draws.columns if c not in ("chain", "draw")]

    def summary(self) -> DataFrame:
        return posterior.summary(posterior.long_draws(self.draws, self.parameters()))

    def means(self) -> dict[str, float]:
        row = self.draws.agg(*[F.avg(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(self.parameters())]).first()
        return dict(zip(self.parameters(), row, strict=True))

    def posterior_predictive(self, flows: DataFrame, draws: int = 50, seed: int = 0, error: bool = False) -> DataFrame:
        """(chain, draw, origin, dest, y): replicates at the terms of ``flows``; lag models unless ``error``."""
        rows = flows.select("origin", "dest", *self.terms).orderBy("origin", "dest").limit(self.n**2 + 1).collect()
        if len(rows) != self.n**2:
            raise ValueError("flows must hold every pair of units once")
        x = np.array([[float(r[t]) for t in self.terms] for r in rows])
        rng, out = np.random.default_rng(seed), []
        table = self.draws.orderBy("chain", "draw").toPandas()
        mark = "lam" if error else "rho"
        for d in table.iloc[:: max(1, len(table) // draws)].to_dict("records"):
            mean = (x @ np.array([d[t] for t in self.terms])).reshape(self.n, self.n)
            e = d["sigma"] * rng.standard_normal((self.n, self.n))
            r = [d.get(f"{mark}_{k}", 0.0) for k in "dow"]
            y = mean + unrestricted_solve(self.w, e, *r) if error else unrestricted_solve(self.w, mean + e, *r)
            out.extend((int(d["chain"]), int(d["draw"]), q["origin"], q["dest"], float(v)) for q, v in zip(rows, y.ravel(), strict=True))
        return flows.sparkSession.createDataFrame(out, ["chain", "draw", "origin", "dest", "y"])

    def impacts(self) -> DataFrame:
        """(effect, variable, mean, lower, upper): origin, destination, intra, network, total.

        Unit shocks to a region's attribute, summed over flows and averaged over regions.
        """
        names = [t[5:] for t in self.terms if t.startswith("dest_") and f"orig_{t[5:]}" in self.terms]
        shared = self.draws.sparkSession.sparkContext.broadcast(Shocks(self.w))
        spatial, n = self.spatial, self.n

        def run(batches):
            for pdf in batches:
                parts = []
                for row in pdf.to_dict("records"):
                    sums = shared.value(*((row.get(f"rho_{k}", 0.0) for k in "dow") if spatial else (0.0, 0.0, 0.0)))
                    for x in names:
                        total, intra, rows, columns = np.array([row[f"dest_{x}"], row[f"orig_{x}"], row.get(f"intra_{x}", 0.0)]) @ sums / n**2
                        origin, dest = rows - intra, columns - intra
                        for name, v in (("total", total), ("intra", intra), ("origin", origin), ("destination", dest), ("network", total - origin - dest - intra)):
                            parts.append((name, x, float(v)))
                yield pd.DataFrame(parts, columns=["effect", "variable", "value"])

        long = self.draws.mapInPandas(run, "effect string, variable string, value double")
        found = long.groupBy("effect", "variable").agg(F.avg("value").alias("mean"), posterior.interval("value").alias("i"))
        return found.select("effect", "variable", "mean", F.col("i")[0].alias("lower"), F.col("i")[1].alias("upper"))


def fit(model: str, flows: DataFrame, edges: DataFrame, units: DataFrame, terms: list[str], y: str = "y", key: str = "unit_id", separable: bool = True, priors=None, draws: int = 1000, tune: int = 500, n_chains: int = 4, seed: int = 0) -> FlowFit:
    """OLSFlow, SARFlow or SEMFlow over (origin, dest, y, terms); all pairs of units must be there."""
    if model not in ("OLSFlow", "SARFlow", "SEMFlow"):
        raise ValueError(f"unknown flow model {model!r}")
    priors = Priors.of(priors, model)
    error = model == "SEMFlow"
    lagged = flow_lags(flows, edges, [y, *(terms if error else [])])
    ys = [y, *[f"{k}_{y}" for k in LAGS]]
    xs = [terms, *([[f"{k}_{t}" for t in terms] for k in LAGS] if error else [])]
    g = Gram.of(lagged, [*ys, *[c for part in xs for c in part]])
    ids = index_of(units, key)
    if g.n % len(ids) ** 2:
        raise ValueError("flows must hold every pair of units")
    w = dense(edges, ids)
    xx = g.get(terms, terms)
    mean_y = g.get([y], ["_one"])[0, 0] / g.n
    var_y = g.get([y], [y])[0, 0] / g.n - mean_y**2
    mx = g.get(terms, ["_one"])[:, 0] / g.n
    var_x = np.diag(xx) / g.n - mx**2
    mean, sd = priors.coefficients(mean_y, np.sqrt(var_y), g.n, np.sqrt(np.maximum(var_x, 0.0)), var_x <= 1e-12 * np.maximum(1.0, mx**2))
    kernel = FlowKernel(g.get(ys, ys), np.array([g.get(x, ys).T for x in xs]), np.array([[g.get(a, b) for b in xs] for a in xs]), error, g.n, np.linalg.eigvals(w), 1 / sd**2, mean, priors.sigma_shape, priors.sigma_scale or var_y, separable, model != "OLSFlow", g.n / len(ids) ** 2)
    out = chains(flows.sparkSession, kernel, ["rho_d", "rho_o", "rho_w", "sigma", *terms], draws, tune, n_chains, seed)
    if error:
        out = out.withColumnsRenamed({f"rho_{k}": f"lam_{k}" for k in "dow"})
    return FlowFit(out if model != "OLSFlow" else out.drop("rho_d", "rho_o", "rho_w"), terms, len(ids), w, model == "SARFlow")


def lm_tests(flows: DataFrame, edges: DataFrame, units: DataFrame, terms: list[str], y: str = "y", key: str = "unit_id", time: str | None = None) -> DataFrame:
    """(test, statistic, df, p_value): LM tests of rho_d, rho_o, rho_w and all three at OLS.

    With ``time`` flows are a panel of all pairs in all periods, lagged within a period, and labels
    have the prefix of panels.

    Traces of the Kronecker weights factor into tr W, tr W W, tr W'W and the number of units.
    """
    from ..diagnostics.lm import efficient

    spark = flows.sparkSession
    extra = [time] if time else None
    lagged = flow_lags(flows, edges, [y, *terms], extra)
    cols = [y, *[f"{k}_{y}" for k in LAGS], *terms, *[f"{k}_{t}" for t in terms for k in LAGS]]
    g = Gram.of(lagged, cols)
    b, _, s2 = ols(g, y, terms)
    maps = {"e": {y: 1.0, **{t: -v for t, v in zip(terms, b, strict=True)}}}
    maps |= {k: {f"{k}_{y}": 1.0} for k in LAGS}
    maps |= {f"{k}_fit": {f"{k}_{t}": v for t, v in zip(terms, b, strict=True)} for k in LAGS} | {t: {t: 1.0} for t in terms}
    h = g.combine(maps)
    n = units.select(key).distinct().count()
    t1, t2, t3 = (f(edges).first()["trace"] for f in (lambda e: weights.trace_power(e, 1), lambda e: weights.trace_power(e, 2), weights.trace_gram))
    periods = g.n / n**2
    if periods != int(periods) or (not time and periods != 1):
        raise ValueError("flows must hold every pair of units, once in a period")
    # tr(A B) + tr(A'B) for A, B among I x W (d), W x I (o), W x W (w).
    pairs = {("Wd", "Wd"): n * (t2 + t3), ("Wo", "Wo"): n * (t2 + t3), ("Ww", "Ww"): t2 * t2 + t3 * t3, ("Wd", "Wo"): 2 * t1 * t1, ("Wd", "Ww"): t1 * (t2 + t3), ("Wo", "Ww"): t1 * (t2 + t3)}
    traces = {("Wd"): n * t1, ("Wo"): n * t1, ("Ww"): t1 * t1}
    k = len(terms)
    score = np.r_[np.zeros(k), [h.get(["e"], [c])[0, 0] / s2 - periods * traces[c] for c in LAGS], 0.0]
    info = np.zeros((k + 4, k + 4))
    x = [*terms, *[f"{c}_fit" for c in LAGS]]
    info[: k + 3, : k + 3] = h.get(x, x) / s2
    for i, a in enumerate(LAGS):
        for j, c in enumerate(LAGS):
            info[k + i, k + j] += periods * pairs.get((a, c), pairs.get((c, a), 0.0))
        info[k + i, k + 3] = info[k + 3, k + i] = periods * traces[a] / s2
    info[k + 3, k + 3] = g.n / (2 * s2**2)
    free = [*range(k), k + 3]
    p = "Panel-" if time else ""
    suite = {"LM-Flow-Destination": [k], "LM-Flow-Origin": [k + 1], "LM-Flow-OD": [k + 2], "LM-Flow-Joint": [k, k + 1, k + 2]}
    rows = []
    for name, tested in suite.items():
        stat = efficient(score, info, tested, [], free)
        rows.append((p + name, stat, len(tested), chi2_sf(stat, len(tested))))
    for name, tested in list(suite.items())[:3]:
        stat = efficient(score, info, tested, [i for i in (k, k + 1, k + 2) if i not in tested], free)
        rows.append((f"{p}Robust-{name}", stat, 1, chi2_sf(stat, 1)))
    return spark.createDataFrame(rows, "test string, statistic double, df int, p_value double")
