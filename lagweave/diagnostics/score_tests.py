"""Score tests at fitted Gaussian and link models, their suites, and the trees that read them.

A Gaussian null estimates some of (beta, theta, rho, lambda, sigma2); theta are the coefficients
of WX. The scores of each posterior draw are quadratic forms of the draw's distance from the
posterior mean over the cross-products of a few columns: the residual at the mean and its lag, Wy,
WWy, the regressors and theirs. One aggregate gives these; no draws x rows matrix is formed. The
information is taken at the posterior mean, the scores of what the null estimates are projected
out, and for robust tests also those of the directions that the test is robust to. The statistic
is the test at the posterior mean, its p-value that of chi-square; the draws give its spread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dgp.simulate import filtered
from ..functions.special import chi2_sf, digamma, log_ndtr, pg_mean
from ..operators.gram import Gram
from ..operators.lags import spatial_lag
from ..operators.traces import resolvent_traces

SCHEMA = "test string, statistic double, median double, df int, p_value double, ci_lower double, ci_upper double, error string"

#: Label: (tested, robust to), for the null that each suite belongs to.
SUITES: dict[str, dict[str, tuple[tuple[str, ...], tuple[str, ...]]]] = {
    "OLS": {
        "LM-Lag": (("rho",), ()), "LM-Error": (("lam",), ()), "LM-WX": (("theta",), ()), "LM-SDM-Joint": (("rho", "theta"), ()), "LM-SLX-Error-Joint": (("lam", "theta"), ()),
        "Robust-LM-Lag": (("rho",), ("lam",)), "Robust-LM-Error": (("lam",), ("rho",)), "Robust-LM-WX": (("theta",), ("rho",)),
    },
    "SLX": {"LM-Lag": (("rho",), ()), "LM-Error": (("lam",), ()), "Robust-LM-Lag-SDM": (("rho",), ("lam",)), "Robust-LM-Error-SDEM": (("lam",), ("rho",))},
    "SAR": {"LM-Error": (("lam",), ()), "LM-WX": (("theta",), ()), "Robust-LM-WX": (("theta",), ("lam",)), "Robust-LM-Error": (("lam",), ("theta",))},
    "SEM": {"LM-Lag": (("rho",), ()), "LM-WX": (("theta",), ()), "Robust-LM-Lag": (("rho",), ("theta",)), "Robust-LM-WX": (("theta",), ("rho",))},
    "SDM": {"LM-Error-SDM": (("lam",), ())},
    "SDEM": {"LM-Lag-SDEM": (("rho",), ())},
}
GLM_TESTS = ("LM-Lag", "LM-Error", "Robust-LM-Lag", "Robust-LM-Error", "LM-SARMA", "LM-WX", "Moran-Working")


def suite(model: str, panel: bool = False) -> dict:
    """The tests of a null by label; a panel's labels have a prefix. Link models have ``GLM_TESTS``."""
    if model not in SUITES:
        raise ValueError(f"no tests for {model}")
    return {("Panel-" if panel else "") + k: v for k, v in SUITES[model].items()}


def safe_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^-1 b; where ``a`` is nearly singular with a small ridge, and by least squares beyond that."""
    if np.linalg.cond(a) < 1e12:
        return np.linalg.solve(a, b)
    ridge = a + 1e-10 * np.trace(np.abs(a)) / len(a) * np.eye(len(a))
    return np.linalg.solve(ridge, b) if np.linalg.cond(ridge) < 1e14 else np.linalg.lstsq(a, b, rcond=None)[0]


@dataclass
class Scores:
    """Rows of scores by draw, the last at the posterior mean; the information there; parameters' places."""

    rows: np.ndarray
    info: np.ndarray
    places: dict[str, list[int]]
    free: list[int]

    def test(self, tested: tuple[str, ...], robust: tuple[str, ...] = ()) -> tuple[np.ndarray, float, int]:
        """The test by draw, at the mean, and its degrees of freedom."""
        t = [i for n in tested for i in self.places[n]]
        if not t:
            raise ValueError("the model has no lagged covariates")
        if set(t) & set(self.free):
            raise ValueError(f"the null estimates {', '.join(tested)}")
        r = [i for n in robust for i in self.places[n] if i not in self.free]
        g, v = self._net([*t, *r], self.free)
        k = len(t)
        if r:
            by = safe_solve(v[k:, k:], v[k:, :k])
            g, v = g[:, :k] - g[:, k:] @ by, v[:k, :k] - v[:k, k:] @ by
        values = np.einsum("di,ij,dj->d", g, safe_solve(v, np.eye(k)), g)
        return values[:-1], float(values[-1]), k

    def _net(self, idx: list[int], off: list[int]) -> tuple[np.ndarray, np.ndarray]:
        by = safe_solve(self.info[np.ix_(off, off)], self.info[np.ix_(off, idx)])
        return self.rows[:, idx] - self.rows[:, off] @ by, self.info[np.ix_(idx, idx)] - self.info[np.ix_(idx, off)] @ by


def _lag(df: DataFrame, edges: DataFrame, columns: list[str], key: str, time: str | None, centred: bool) -> DataFrame:
    out = spatial_lag(df, edges, columns, key=key, over=[time] if time else None)
    if centred:
        window = Window.partitionBy(*([time] if time else []))
        out = out.withColumns({f"W_{c}": F.col(f"W_{c}") - F.avg(f"W_{c}").over(window) for c in columns})
    return out


def gaussian_scores(fit, most: int = 10_000) -> Scores:
    """Scores of a Gaussian fit; ``most`` draws at most are read (bounded by chains x draws anyway)."""
    k, key, time, y, edges = fit.kernel, fit.key, fit.time, fit.y, fit.edges
    own = [t for t in k.names if not t.startswith("W_")]
    xs = [t for t in own if t != "_one" and not t.startswith("L_")]
    estimated = [t for t in k.names if t.startswith("W_")]
    wx = estimated or [f"W_{x}" for x in xs]
    has_rho, has_lam, centred = fit.spatial == "rho", fit.spatial == "lam", k.shift != 0
    draws = fit.draws.orderBy("chain", "draw").limit(most).toPandas()
    z = [*own, *wx]
    delta = np.column_stack([draws[t] if t in k.names else np.zeros(len(draws)) for t in z])
    rho = draws["rho"].to_numpy() if has_rho else np.zeros(len(draws))
    lam = draws["lam"].to_numpy() if has_lam else np.zeros(len(draws))
    s2 = draws["sigma"].to_numpy() ** 2
    delta, rho, lam, s2 = np.vstack([delta, delta.mean(0)]), np.r_[rho, rho.mean()], np.r_[lam, lam.mean()], np.r_[s2, s2.mean()]
    d_bar, r_bar, l_bar, v_bar = delta[-1], float(rho[-1]), float(lam[-1]), float(s2[-1])

    keys = [key, *([time] if time else [])]
    base = fit.lagged.select(*keys, y, *own)
    table = _lag(base, edges, [y, *[w.removeprefix("W_") for w in wx]], key, time, centred)
    mean = sum((float(v) * F.col(f"`{c}`") for c, v in zip(z, d_bar, strict=True)), F.lit(0.0))
    table = table.withColumn("_mean", mean).withColumn("_e", F.col(y) - r_bar * F.col(f"W_{y}") - F.col("_mean"))
    if has_rho:
        table = filtered(table, edges, "_mean", r_bar, key, [time] if time else None)
    table = _lag(table, edges, [c for c in ("_e", "_mean", f"W_{y}", *z) if f"W_{c}" not in table.columns], key, time, centred)
    table = _lag(table, edges, ["W__mean"], key, time, centred)
    table = table.withColumn("_m", F.col("W__mean") - l_bar * F.col("W_W__mean"))
    basis = ["_e", "W__e", f"W_{y}", f"W_W_{y}", *z, *[f"W_{c}" for c in z], "_m"]
    basis = list(dict.fromkeys(basis))
    g = Gram.of(table.select(*basis), basis)
    at = {c: i for i, c in enumerate(basis)}
    m = g.get(basis, basis)

    def combo(**terms) -> np.ndarray:
        out = np.zeros(len(basis))
        for c, v in terms.items():
            out[at[c]] += v
        return out

    def unit(c: str) -> np.ndarray:
        return combo(**{c: 1.0})

    traces = {r: resolvent_traces(fit.units.select(key).distinct(), edges, r, key, centred) for r in {0.0, r_bar, l_bar}}
    zero = k.times * traces[0.0]["g"] - k.shift

    def trace_at(present: bool, r: float) -> float:
        if not present:
            return zero
        return float(-k.times * k.jacobian.slope(np.array(r)) - k.shift / (1 - r))

    zs = np.array([unit(c) for c in z])
    wzs = np.array([unit(f"W_{c}") for c in z])
    rows = []
    for i in range(len(rho)):
        gap = delta[i] - d_bar
        u = unit("_e") - (rho[i] - r_bar) * unit(f"W_{y}") - gap @ zs
        wu = unit("W__e") - (rho[i] - r_bar) * unit(f"W_W_{y}") - gap @ wzs
        e = m @ (u - lam[i] * wu)
        rows.append([
            *((zs - lam[i] * wzs) @ e / s2[i]),
            -trace_at(has_rho, rho[i]) + (unit(f"W_{y}") - lam[i] * unit(f"W_W_{y}")) @ e / s2[i],
            -trace_at(has_lam, lam[i]) + wu @ e / s2[i],
            -k.n / (2 * s2[i]) + (u - lam[i] * wu) @ e / (2 * s2[i] ** 2),
        ])
    p = len(z)
    info = np.zeros((p + 3, p + 3))
    bz, mv = zs - l_bar * wzs, unit("_m")
    info[:p, :p] = bz @ m @ bz.T / v_bar
    info[:p, p] = info[p, :p] = bz @ m @ mv / v_bar
    ta, tb = traces[r_bar if has_rho else 0.0], traces[l_bar if has_lam else 0.0]
    cross = ta if has_rho else tb
    info[p, p] = k.times * (ta["gtg"] + ta["gg"]) + mv @ m @ mv / v_bar
    info[p, p + 1] = info[p + 1, p] = k.times * (cross["wtg"] + cross["wg"])
    info[p + 1, p + 1] = k.times * (tb["gtg"] + tb["gg"])
    info[p, p + 2] = info[p + 2, p] = k.times * ta["g"] / v_bar
    info[p + 1, p + 2] = info[p + 2, p + 1] = k.times * tb["g"] / v_bar
    info[p + 2, p + 2] = k.n / (2 * v_bar**2)
    free = list(range(p if estimated else len(own))) + [p] * has_rho + [p + 1] * has_lam + [p + 2]
    return Scores(np.array(rows), info, {"theta": list(range(len(own), p)), "rho": [p], "lam": [p + 1]}, free)


def _report(spark, found: dict) -> DataFrame:
    rows = []
    for label, run in found.items():
        try:
            values, statistic, df = run()
            low, middle, high = (float(v) for v in np.quantile(values, (0.025, 0.5, 0.975))) if len(values) else (statistic,) * 3
            rows.append((label, statistic, middle, df, chi2_sf(statistic, df), low, high, None))
        except (np.linalg.LinAlgError, ValueError) as e:
            nan = float("nan")
            rows.append((label, nan, nan, 0, nan, nan, nan, str(e)))
    return spark.createDataFrame(rows, SCHEMA)


def tests(fit) -> DataFrame:
    """(test, statistic, median, df, p_value, ci_lower, ci_upper, error) of a Gaussian fit's suite."""
    scores = gaussian_scores(fit)
    return _report(fit.units.sparkSession, {label: (lambda t=t, r=r: scores.test(t, r)) for label, (t, r) in suite(fit.name, fit.time is not None).items()})


# Link models: logit, probit and negative binomial fits without a lag.


def _gap(eta: np.ndarray) -> np.ndarray:
    """E[error | 1] - E[error | 0] of a logistic disturbance: the entropy of p over p (1 - p)."""
    p = 1 / (1 + np.exp(-eta))
    q = 1 - p
    entropy = -(np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0) + np.where(q > 0, q * np.log(np.maximum(q, 1e-300)), 0))
    return entropy / np.maximum(p * q, 1e-300)


def score_units(family: str, y: np.ndarray, eta: np.ndarray, size=None) -> tuple[np.ndarray, np.ndarray]:
    """The score residual and the disturbance that it predicts."""
    if family == "logit":
        e = y - 1 / (1 + np.exp(-eta))
        return e, e * _gap(eta)
    if family == "probit":
        log_phi = -0.5 * eta**2 - 0.5 * np.log(2 * np.pi)
        e = np.where(y == 1, np.exp(log_phi - log_ndtr(eta)), -np.exp(log_phi - log_ndtr(-eta)))
        return e, e
    mu = np.exp(eta)
    return size * (y - mu) / (size + mu), digamma(size + y) - np.log(size + mu) - digamma(np.broadcast_to(size, y.shape)) + np.log(size)


def information_units(family: str, eta: np.ndarray, size=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Fisher weight, and the predicted disturbance's variance and covariance with the residual."""
    if family == "logit":
        p = 1 / (1 + np.exp(-eta))
        v, gap = p * (1 - p), _gap(eta)
        return v, gap**2 * v, gap * v
    if family == "probit":
        w = np.exp(-(eta**2) - np.log(2 * np.pi) - log_ndtr(eta) - log_ndtr(-eta))
        return w, w, w
    mu = np.exp(eta)
    var, cov = np.zeros(len(mu)), np.zeros(len(mu))
    for i, mean in enumerate(mu):
        y = np.arange(0, np.ceil(mean + 12 * np.sqrt(mean + mean**2 / size) + 40 * (1 + mean / size)))
        steps = np.log((y[:-1] + size) / (y[:-1] + 1) * (mean / (size + mean)))
        log_p = np.r_[0.0, np.cumsum(steps)]
        p = np.exp(log_p - log_p.max())
        p /= p.sum()
        d = digamma(size + y)
        centre, middle = p @ d, p @ y
        var[i], cov[i] = p @ (d - centre) ** 2, p @ ((y - middle) * (d - centre))
    return size * mu / (size + mu), var, size / (size + mu) * cov


def _lag_null_tests(fit, most: int) -> DataFrame:
    """LM-Error and LM-WX at a reduced-form lag: WX enters inside of the multiplier."""
    k = fit.kernel
    family, w, x, y = k.likelihood, k.w, k.x, k.y
    wx = np.column_stack([w @ x[:, j] for j, t in enumerate(fit.terms) if t != "_one"])
    draws = fit.draws.orderBy("chain", "draw").limit(most).toPandas()
    table = draws[["rho", *(["alpha"] if family == "negbin" else []), *fit.terms]].to_numpy()
    table = np.vstack([table, table.mean(0)])
    sizes = table[:, 1] if family == "negbin" else [None] * len(table)
    q, scores, of_beta = [], [], []
    for row, a in zip(table, sizes, strict=True):
        s = np.linalg.inv(np.eye(len(w)) - row[0] * w)
        sx, swx = s @ x, s @ wx
        eta = sx @ row[-len(fit.terms) :]
        e, h = score_units(family, y, eta, a)
        q.append(e @ (w @ h))
        scores.append(swx.T @ e)
        of_beta.append(sx.T @ e)
    omega, tau, kappa = information_units(family, eta, sizes[-1])  # at the mean, the last row
    v_q = float(omega @ (w * w) @ tau + kappa @ (w * w.T) @ kappa)
    by = safe_solve(sx.T @ (omega[:, None] * sx), sx.T @ (omega[:, None] * swx))
    g = np.array(scores) - np.array(of_beta) @ by
    v = (omega[:, None] * swx).T @ (swx - sx @ by)
    lm_q = np.array(q) ** 2 / (v_q + 1e-12)
    lm_x = np.einsum("di,ij,dj->d", g, safe_solve(v, np.eye(len(v))), g)
    return _report(fit.draws.sparkSession, {"LM-Error": lambda: (lm_q[:-1], float(lm_q[-1]), 1), "LM-WX": lambda: (lm_x[:-1], float(lm_x[-1]), len(v))})


def glm_tests(fit, edges_w: np.ndarray | None = None, most: int = 500) -> DataFrame:
    """The suite of a Logit, Probit or NegBin fit, or the two tests of one with a reduced-form lag."""
    k = fit.kernel
    if k.process == "lag":
        return _lag_null_tests(fit, most)
    if k.process != "none":
        raise ValueError("there are no tests at a fit with an error process")
    w = k.w if edges_w is None else edges_w
    family = k.likelihood
    draws = fit.draws.orderBy("chain", "draw").limit(most).toPandas()
    x, y = k.x, k.y
    beta = draws[fit.terms].to_numpy()
    beta = np.vstack([beta, beta.mean(0)])
    size = np.r_[draws["alpha"], draws["alpha"].mean()] if family == "negbin" else [None] * len(beta)
    bar = x @ beta[-1]
    omega, tau, kappa = information_units(family, bar, size[-1])
    v_q = float(omega @ (w * w) @ tau + kappa @ (w * w.T) @ kappa)
    spill = w @ bar
    wx = np.column_stack([w @ x[:, j] for j, t in enumerate(fit.terms) if t != "_one"])
    jbb = x.T @ (omega[:, None] * x)
    of_spill, of_wx = safe_solve(jbb, x.T @ (omega * spill)), safe_solve(jbb, x.T @ (omega[:, None] * wx))
    i_s = float(omega @ (spill * (spill - x @ of_spill)))
    i_wx = (omega[:, None] * wx).T @ (wx - x @ of_wx)
    q, s, g, moran, weights = [], [], [], [], []
    for b, a in zip(beta, size, strict=True):
        eta = x @ b
        e, h = score_units(family, y, eta, a)
        q.append(e @ (w @ h))
        s.append(e @ (w @ eta) - (x.T @ e) @ of_spill)
        g.append(wx.T @ e - of_wx.T @ (x.T @ e))
        if family == "probit":
            pg = information_units(family, eta)[0]
            left = e / pg
        else:
            psi = eta if family == "logit" else eta - np.log(a)
            shape = np.ones(len(y)) if family == "logit" else y + a
            pg = pg_mean(shape, psi)
            left = (y - 0.5 if family == "logit" else (y - a) / 2) / pg - psi
        moran.append(left * pg @ (w @ left))
        weights.append(pg)
    q, s, g, moran = np.array(q), np.array(s), np.array(g), np.array(moran)
    mid = np.mean(weights[:-1] or weights, axis=0)
    v_m = float((w * w.T).sum() + (mid[:, None] / mid[None] * w * w).sum())

    def scalar(values, v):
        out = values**2 / (v + 1e-12)
        return lambda: (out[:-1], float(out[-1]), 1)

    def moran_test():
        return moran[:-1] ** 2 / (v_m + 1e-12), float(np.mean(moran[:-1])) ** 2 / (v_m + 1e-12), 1

    both = s**2 / (i_s + 1e-12) + q**2 / (v_q + 1e-12)
    of_x = np.einsum("di,ij,dj->d", g, safe_solve(i_wx, np.eye(len(i_wx))), g)
    return _report(fit.draws.sparkSession, {
        "LM-Lag": scalar(s + q, i_s + v_q), "LM-Error": scalar(q, v_q), "Robust-LM-Lag": scalar(s, i_s), "Robust-LM-Error": scalar(i_s * q - v_q * s, (i_s + v_q) * i_s * v_q),
        "LM-SARMA": lambda: (both[:-1], float(both[-1]), 2), "LM-WX": lambda: (of_x[:-1], float(of_x[-1]), len(i_wx)), "Moran-Working": moran_test,
    })


# What the tests say: trees of questions.


@dataclass(frozen=True)
class Ask:
    """Is ``test`` significant? With ``against``: is its p-value at most that of the other?"""

    test: str
    yes: object
    no: object
    against: str | None = None

    @property
    def question(self) -> str:
        return f"p({self.test}) <= p({self.against})" if self.against else self.test


def _robust(a: tuple[str, str], b: tuple[str, str]) -> Ask:
    """Of two robust tests the one that rejects; the smaller p-value if both do, or neither."""
    closer = Ask(a[0], a[1], b[1], against=b[0])
    return Ask(a[0], Ask(b[0], closer, a[1]), Ask(b[0], b[1], closer))


def _two_ways(stay: str, a: tuple[str, str, str], b: tuple[str, str, str]) -> Ask:
    """Directions (test, robust test, model): one rejects, both do, or none."""
    return Ask(a[0], Ask(b[0], _robust(a[1:], b[1:]), a[2]), Ask(b[0], b[2], stay))


def tree(model: str, panel: bool = False):
    """The tree of a null: nodes, with the model that is implied at each leaf; a leaf alone without tests."""
    p = "Panel-" if panel else ""
    family = "Tobit" if model.endswith("Tobit") else ""
    null = model.removesuffix("Tobit")
    if model in ("Logit", "Probit", "NegBin"):
        shared = Ask("Robust-LM-Error", f"SEM{model}", f"SEM{model} or SAR{model}")
        both = Ask("Robust-LM-Error", f"SDEM{model}", f"SAR{model}")
        return Ask("Robust-LM-Lag", Ask("LM-Error", both, f"SAR{model}(latent=False)"), Ask("LM-Error", shared, model))
    if model == "OLSFlow":
        return Ask(f"{p}LM-Flow-Joint", "SARFlow", "OLSFlow")
    if model == "OLS":
        lag_wx = Ask(f"{p}Robust-LM-WX", "SLX", Ask(f"{p}LM-Error", "SAR", "SLX", against=f"{p}Robust-LM-WX"))
        error_wx = Ask(f"{p}LM-Error", "SEM", "SLX", against=f"{p}LM-WX")
        settle = _robust((f"{p}Robust-LM-Lag", "SAR"), (f"{p}Robust-LM-Error", "SEM"))
        return Ask(f"{p}LM-Lag", Ask(f"{p}LM-Error", settle, Ask(f"{p}LM-WX", lag_wx, "SAR")), Ask(f"{p}LM-Error", Ask(f"{p}LM-WX", error_wx, "SEM"), Ask(f"{p}LM-WX", "SLX", "OLS")))
    pairs = {
        "SAR": (("LM-WX", "Robust-LM-WX", "SDM"), ("LM-Error", "Robust-LM-Error", "SARAR")),
        "SEM": (("LM-Lag", "Robust-LM-Lag", "SARAR"), ("LM-WX", "Robust-LM-WX", "SDEM")),
        "SLX": (("LM-Lag", "Robust-LM-Lag-SDM", "SDM"), ("LM-Error", "Robust-LM-Error-SDEM", "SDEM")),
    }
    if null in pairs and not (null == "SLX" and family):
        return _two_ways(model, *((p + a, p + b, c + family) for a, b, c in pairs[null]))
    one = {"SDM": "LM-Error-SDM", "SDEM": "LM-Lag-SDEM"}
    return Ask(p + one[null], "GNS" + family, model) if null in one and not (panel and family) else model


def walk(node, p_values: dict[str, float], alpha: float = 0.05) -> tuple[str, list[tuple[str, bool]]]:
    """The implied model, and the questions on the way with their answers; a p-value that is missing is not significant."""
    path = []
    while isinstance(node, Ask):
        p = p_values.get(node.test, float("nan"))
        answer = bool(p <= p_values.get(node.against, float("nan"))) if node.against else bool(p < alpha)
        path.append((node.question, answer))
        node = node.yes if answer else node.no
    return node, path


def decide(found: DataFrame, model: str, panel: bool = False, alpha: float = 0.05) -> DataFrame:
    """One row (model, path) from a table of tests."""
    implied, path = walk(tree(model, panel), {r["test"]: r["p_value"] for r in found.collect()}, alpha)
    return found.sparkSession.createDataFrame([(implied, " > ".join(f"{q}={'yes' if a else 'no'}" for q, a in path))], "model string, path string")


def as_text(node, path: list | None = None, depth: int = 0) -> str:
    """The tree as indented lines; the way that was taken is marked."""
    mark = "  " * depth
    if not isinstance(node, Ask):
        return f"{mark}-> {node}\n"
    taken = dict(path or [])
    lines = [f"{mark}{node.question}?\n"]
    for word, answer, side in (("yes", True, node.yes), ("no", False, node.no)):
        here = path is not None and taken.get(node.question) is answer
        lines.append(f"{mark}{'*' if here else ' '} {word}:\n{as_text(side, path if here else None, depth + 2)}")
    return "".join(lines)


def as_dot(node, title: str = "tests") -> str:
    """The tree in the DOT language."""
    lines, count = [], iter(range(10_000))

    def add(n) -> int:
        me = next(count)
        label = (n.question if isinstance(n, Ask) else n).replace('"', "'")
        lines.append(f'  n{me} [label="{label}", shape={"ellipse" if isinstance(n, Ask) else "box"}];')
        if isinstance(n, Ask):
            for word, side in (("yes", n.yes), ("no", n.no)):
                lines.append(f'  n{me} -> n{add(side)} [label="{word}"];')
        return me

    add(node)
    return f'digraph "{title}" {{\n' + "\n".join(lines) + "\n}\n"
