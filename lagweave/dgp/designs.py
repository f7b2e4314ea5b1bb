"""Simulators beyond the plain Gaussian ones: latent and two-part outcomes, panels, dynamics, levels.

As in ``simulate``, noise comes from hashes of the keys, spatial filters are series of lag joins,
and nothing of the size of the data is on the driver. Counts are drawn by inverting their
distribution at a uniform number of the row's own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import gammaln, ndtr
from ..lineage import cut
from ..operators.lags import spatial_lag
from ..operators.weights import lattice
from .simulate import filtered, normal, uniform

TRIES = 10


def logistic(seed: int, label: str, *keys: str) -> Column:
    u = uniform(seed, label, *keys)
    return F.log(u) - F.log(1 - u)


def log_gamma(seed: int, label: str, shape: float, *keys: str) -> Column:
    """log g with g ~ Gamma(shape, shape), of mean 1: the first of some tries by squeezed cubes.

    A try fails with a chance under 0.05; the last one is taken if all fail.
    """
    a = shape + (shape < 1)
    d = a - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out = None
    for k in reversed(range(TRIES)):
        x = normal(seed, f"{label}/x{k}", *keys)
        v = F.pow(F.greatest(1 + c * x, F.lit(1e-12)), F.lit(3.0))
        good = (1 + c * x > 0) & (F.log(uniform(seed, f"{label}/u{k}", *keys)) < 0.5 * x * x + d - d * v + d * F.log(v))
        value = float(np.log(d)) + F.log(v)
        out = value if out is None else F.when(good, value).otherwise(out)
    if shape < 1:
        out = out + F.log(uniform(seed, f"{label}/small", *keys)) / shape
    return out - float(np.log(shape))


def hetero(sigma: float, xs: list[str]) -> Column:
    """sigma sqrt(1 + |row of the design|^2), the constant included."""
    total = F.lit(2.0)
    for x in xs:
        total = total + F.col(x) * F.col(x)
    return sigma * F.sqrt(total)


def period_effect(seed: int, time: str, first, sd: float) -> Column:
    """A draw for each period, 0 for the first one."""
    return F.when(F.col(time) == first, 0.0).otherwise(sd * normal(seed, "period", time)) if sd else F.lit(0.0)


def poisson_at(q: np.ndarray, mu: np.ndarray, positive: bool = False) -> np.ndarray:
    """Poisson quantiles; with ``positive`` of the counts above 0. Beyond a mean of 500 by the normal root."""
    q, mu = np.asarray(q, float), np.asarray(mu, float)
    if positive:
        q = q * -np.expm1(-mu) + np.exp(-mu)
    out = np.zeros(len(mu))
    big = mu > 500
    z = _normal_quantile(q[big])
    out[big] = np.maximum(np.floor((np.sqrt(mu[big]) + z / 2) ** 2 + 0.5), 0)
    mass, total = np.exp(-np.where(big, 0, mu)), np.exp(-np.where(big, 0, mu))
    left = np.flatnonzero(~big & (total < q))
    k = 0
    while len(left) and k < 5000:
        k += 1
        mass[left] *= mu[left] / k
        total[left] += mass[left]
        out[left] = k
        left = left[total[left] < q[left]]
    return np.maximum(out, 1) if positive else out


def negbin_at(q: np.ndarray, eta: np.ndarray, size: float, positive: bool = False) -> np.ndarray:
    """NB2 quantiles for a log mean; with ``positive`` of the counts above 0."""
    log_p, log_q = np.log(size) - np.logaddexp(np.log(size), eta), eta - np.logaddexp(np.log(size), eta)
    mass = np.exp(size * log_p)
    q = np.where(positive, mass + q * (1 - mass), q)
    total, out, k = mass.copy(), np.zeros(len(eta)), 0
    left = np.flatnonzero(total < q)
    while len(left) and k < 200_000:
        mass[left] = np.exp(gammaln(k + 1.0 + size) - gammaln(size) - gammaln(k + 2.0) + size * log_p[left] + (k + 1) * log_q[left])
        k += 1
        total[left] += mass[left]
        out[left] = k
        left = left[total[left] < q[left]]
    return np.maximum(out, 1) if positive else out


def _normal_quantile(q: np.ndarray) -> np.ndarray:
    low, high = np.full(len(q), -12.0), np.full(len(q), 12.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = ndtr(middle) < q
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def drawn(df: DataFrame, seed: int, keys: list[str], out: str, inputs: list[str], draw) -> DataFrame:
    """``df`` with ``out`` = draw(uniform numbers of the rows, their inputs), in Arrow batches."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out: draw(pdf["_q"].to_numpy(), *[pdf[c].to_numpy() for c in inputs])}).drop(columns="_q")

    work = df.withColumn("_q", uniform(seed, f"outcome/{out}", *keys)).withColumn(out, F.lit(0.0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema if f.name != "_q")
    return work.mapInPandas(run, schema)


def design(units: DataFrame, k: int, seed: int, keys: list[str], names: str = "x", tied: float = 0.0, key: str = "unit_id") -> tuple[DataFrame, list[str]]:
    """Keys and standard normal covariates; ``tied`` is their correlation with the unit's own draws."""
    xs = [f"{names}{i}" for i in range(1, k + 1)]
    fresh = np.sqrt(1 - tied**2)
    own = lambda x: tied * normal(seed, f"unit/{x}", key) + float(fresh) * normal(seed, x, *keys)
    return units.withColumns({x: own(x) if tied else normal(seed, x, *keys) for x in xs}), xs


def linear(beta: list[float], xs: list[str]) -> Column:
    total = F.lit(float(beta[0]))
    for x, b in zip(xs, beta[1:], strict=True):
        total = total + float(b) * F.col(x)
    return total


def predictor(df: DataFrame, edges: DataFrame, process: str, mean: Column, noise: Column | None, r: float, out: str, key: str, over: list[str] | None, theta: list[float] | None = None, xs: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: (I - rW)^-1 (mean + noise) for a lag, mean + (I - rW)^-1 noise for an error process.

    ``theta`` adds W x theta to the mean.
    """
    work = df
    if theta:
        work = spatial_lag(work, edges, xs, key=key, over=over)
        for x, t in zip(xs, theta, strict=True):
            mean = mean + float(t) * F.col(f"W_{x}")
    noise = F.lit(0.0) if noise is None else noise
    if process == "lag":
        return filtered(work.withColumn(out, mean + noise), edges, out, r, key, over).select(*df.columns, out)
    work = work.withColumns({out: mean, "_n": noise})
    work = filtered(work, edges, "_n", r, key, over) if process == "error" else work
    return work.withColumn(out, F.col(out) + F.col("_n")).select(*df.columns, out)


def latent_binary(units: DataFrame, edges: DataFrame, beta: list[float] = (0.3, 1.0), process: str = "error", r: float = 0.35, link: str = "logit", theta: list[float] | None = None, err_hetero: bool = False, seed: int = 0, key: str = "unit_id") -> DataFrame:
    """(key, x.., eta, y): y = 1 where the latent outcome, whose disturbances the process carries, is above 0."""
    df, xs = design(units.select(key), len(beta) - 1, seed, [key])
    e = logistic(seed, "noise", key) if link == "logit" else normal(seed, "noise", key)
    e = e * hetero(1.0, xs) if err_hetero else e
    out = predictor(df, edges, process, linear(beta, xs), e, r, "eta", key, None, theta, xs)
    return out.withColumn("y", (F.col("eta") > 0).cast("double"))


def probit_random(units: DataFrame, edges: DataFrame, beta: list[float] = (0.3, 1.0), lam: float = 0.35, unit_effect_sd: float = 0.5, obs_per_unit: int = 25, err_hetero: bool = False, seed: int = 0, key: str = "unit_id") -> DataFrame:
    """(key, obs, x.., y): repeated 0/1 observations of units whose effects follow an error process."""
    base = units.select(key).withColumn("_c", unit_effect_sd * normal(seed, "effect", key))
    rows = base.withColumn("obs", F.explode(F.sequence(F.lit(0), F.lit(obs_per_unit - 1))))
    rows, xs = design(rows, len(beta) - 1, seed, [key, "obs"])
    if err_hetero:  # a unit's effect varies with the mean size of its rows
        size = rows.groupBy(key).agg(F.avg(hetero(1.0, xs)).alias("_s"))
        base = base.join(size, key).withColumn("_c", F.col("_c") * F.col("_s")).drop("_s")
    effects = filtered(base, edges, "_c", lam, key).withColumnRenamed("_c", "_effect").withColumnRenamed(key, "_k")
    joined = rows.drop("_c").join(effects, F.col(key) == F.col("_k")).withColumn("_eta", linear(beta, xs) + F.col("_effect"))
    return drawn(joined, seed, [key, "obs"], "y", ["_eta"], lambda q, e: (q < ndtr(e)).astype(float)).select(key, "obs", *xs, "y")


def latent_negbin(units: DataFrame, edges: DataFrame, beta: list[float] = (1.0, 0.6), process: str = "error", r: float = 0.5, alpha: float = 2.0, theta: list[float] | None = None, err_hetero: bool = False, seed: int = 0, key: str = "unit_id") -> DataFrame:
    """(key, x.., eta, y): Poisson counts whose log mean has log-gamma disturbances in the process."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    df, xs = design(units.select(key), len(beta) - 1, seed, [key])
    e = log_gamma(seed, "noise", alpha, key)
    e = e * hetero(1.0, xs) if err_hetero else e
    out = predictor(df, edges, process, linear(beta, xs), e, r, "eta", key, None, theta, xs)
    return drawn(out, seed, [key], "y", ["eta"], lambda q, eta: poisson_at(q, np.exp(np.clip(eta, -30, 30))))


def intercept_shift(df: DataFrame, eta: str, by: str, target: float) -> float:
    """The s with mean(logistic(eta + s by)) = target, by bisection; each step is one aggregate."""
    if not 0 < target < 1:
        raise ValueError("the target share must lie between 0 and 1")
    low, high = -50.0, 50.0
    for _ in range(40):
        middle = (low + high) / 2
        mean = df.agg(F.avg(1 / (1 + F.exp(-(F.col(eta) + middle * F.col(by))))).alias("m")).first()["m"]
        low, high = (middle, high) if mean < target else (low, middle)
    return (low + high) / 2


def two_part(units: DataFrame, edges: DataFrame, kind: str = "zinb", beta: list[float] = (1.0, 0.6), beta_zero: list[float] = (0.3, 1.0), rho: float = 0.5, rho_zero: float = 0.3, alpha: float = 2.0, target_pi: float | None = None, latent: bool = False, unit_sd: float = 0.0, time_sd: float = 0.0, edges_zero: DataFrame | None = None, seed: int = 0, key: str = "unit_id", time: str | None = None) -> DataFrame:
    """(keys, x.., z.., eta, u, active, y): a zero-inflated (``zinb``) or ``hurdle`` negative binomial.

    Reduced form: activity is a draw at the logit u = (I - rho_zero W)^-1 Z g, and active rows have
    NB2 counts (a hurdle's are positive) of log mean eta = (I - rho W)^-1 X b. ``latent`` carries
    logistic and log-gamma disturbances through the filters instead, and counts are Poisson. Panels
    (``time``) have unit effects inside the filter, and period effects outside of it (inside, if
    latent), in both parts. ``target_pi`` shifts the constant of activity to that mean share.
    """
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    keys, over = [key, *([time] if time else [])], [time] if time else None
    df, xs = design(units.select(*keys), len(beta) - 1, seed, keys)
    df, zs = design(df, len(beta_zero) - 1, seed, keys, "z")
    first = df.agg(F.min(time).alias("t")).first()["t"] if time and time_sd else None
    effect = lambda name: unit_sd * normal(seed, f"unit/{name}", key) if unit_sd else F.lit(0.0)
    period = lambda name: period_effect(seed + len(name), time, first, time_sd) if time_sd and time else F.lit(0.0)
    graph = edges if edges_zero is None else edges_zero
    noise_u = logistic(seed, "noise/u", *keys) + period("u") if latent else None
    noise_e = log_gamma(seed, "noise/e", alpha, *keys) + period("eta") if latent else None
    work = predictor(df, graph, "lag", linear(beta_zero, zs) + effect("u"), noise_u, rho_zero, "u", key, over)
    work = predictor(work, edges, "lag", linear(beta, xs) + effect("eta"), noise_e, rho, "eta", key, over)
    if not latent and time_sd and time:
        work = work.withColumns({"u": F.col("u") + period("u"), "eta": F.col("eta") + period("eta")})
    if target_pi is not None:
        work = cut(filtered(work.withColumn("_a", F.lit(1.0)), graph, "_a", rho_zero, key, over))
        shift = intercept_shift(work, "u", "_a", target_pi) if not latent else _latent_shift(work, target_pi)
        work = work.withColumn("u", F.col("u") + shift * F.col("_a")).drop("_a")
    chance = F.col("u") > 0 if latent else uniform(seed, "active", *keys) < 1 / (1 + F.exp(-F.col("u")))
    work = work.withColumn("active", chance.cast("double"))
    positive = kind == "hurdle"
    if kind not in ("zinb", "hurdle"):
        raise ValueError(f"unknown kind {kind!r}")
    if latent:
        draw = lambda q, eta: poisson_at(q, np.exp(np.clip(eta, -30, 30)), positive)
    else:
        draw = lambda q, eta: negbin_at(q, np.clip(eta, -30, 30), alpha, positive)
    out = drawn(work, seed, keys, "_count", ["eta"], draw)
    return out.withColumn("y", F.when(F.col("active") == 1, F.col("_count")).otherwise(0.0)).drop("_count")


def _latent_shift(df: DataFrame, target: float) -> float:
    """As intercept_shift, of the share of rows whose latent activity is above 0."""
    if not 0 < target < 1:
        raise ValueError("the target share must lie between 0 and 1")
    return float(df.agg(F.percentile(-F.col("u") / F.col("_a"), target).alias("s")).first()["s"])


def count_panel(units: DataFrame, edges: DataFrame, beta: list[float] = (1.0, 0.6), rho: float = 0.4, alpha: float = 2.0, unit_sd: float = 0.0, time_sd: float = 0.0, fe_x_corr: float = 0.0, latent: bool = False, seed: int = 0, key: str = "unit_id", time: str = "time") -> DataFrame:
    """(key, time, x.., eta, y): NB2 counts with a lag; effects of units are inside the filter.

    ``fe_x_corr`` ties unit effects to the covariates. Period effects come after the filter, or
    with ``latent`` go through it as the log-gamma disturbances do.
    """
    keys = [key, time]
    df, xs = design(units.select(*keys), len(beta) - 1, seed, keys, tied=fe_x_corr, key=key)
    first = df.agg(F.min(time).alias("t")).first()["t"]
    own = fe_x_corr * normal(seed, f"unit/{xs[0] if xs else 'x1'}", key) + float(np.sqrt(1 - fe_x_corr**2)) * normal(seed, "unit/own", key)
    mean, tau = linear(beta, xs) + (unit_sd * own if unit_sd else F.lit(0.0)), period_effect(seed, time, first, time_sd)
    noise = log_gamma(seed, "noise", alpha, *keys) + tau if latent else None
    work = predictor(df, edges, "lag", mean, noise, rho, "eta", key, [time])
    if latent:
        return drawn(work, seed, keys, "y", ["eta"], lambda q, e: poisson_at(q, np.exp(np.clip(e, -30, 30))))
    return drawn(work.withColumn("eta", F.col("eta") + tau), seed, keys, "y", ["eta"], lambda q, e: negbin_at(q, np.clip(e, -30, 30), alpha))


def dynamic_panel(units: DataFrame, edges: DataFrame, periods: int, beta: list[float] = (1.0, 2.0), rho: float = 0.0, lam: float = 0.0, phi: float = 0.4, theta_lag: float = 0.0, theta: list[float] | None = None, restricted: bool = False, sigma: float = 1.0, unit_sd: float = 0.0, time_sd: float = 0.0, err_hetero: bool = False, seed: int = 0, key: str = "unit_id") -> DataFrame:
    """(key, time, x.., y): y_t = (I - rho W)^-1 (phi y_t-1 + theta_lag W y_t-1 + X b + W X theta + effects + (I - lam W)^-1 e).

    Periods are computed one after the other, each from the last one's table. ``restricted`` sets
    theta_lag to -rho phi. The period before the first is noise of sd sigma.
    """
    theta_lag = -rho * phi if restricted else theta_lag
    before = units.select(F.col(key).alias("_k"), (sigma * normal(seed, "start", key)).alias("_y"))
    out = None
    for t in range(periods):
        df, xs = design(units.select(key, F.lit(t).cast("long").alias("time")), len(beta) - 1, seed, [key, "time"])
        e = normal(seed, "noise", key, "time") * (hetero(sigma, xs) if err_hetero else F.lit(sigma))
        work = df.join(before, F.col(key) == F.col("_k")).withColumn("_u", e).drop("_k")
        work = filtered(work, edges, "_u", lam, key)
        mean = linear(beta, xs) + float(phi) * F.col("_y") + F.col("_u")
        lagging = (["_y"] if theta_lag else []) + (xs if theta else [])
        work = spatial_lag(work, edges, lagging, key=key) if lagging else work
        if theta_lag:
            mean = mean + float(theta_lag) * F.col("W__y")
        for x, b in zip(xs, theta or [], strict=False):
            mean = mean + float(b) * F.col(f"W_{x}")
        if unit_sd:
            mean = mean + unit_sd * normal(seed, "unit", key)
        if time_sd and t:
            mean = mean + time_sd * normal(seed, "period", "time")
        now = cut(filtered(work.withColumn("y", mean).select(key, "time", *xs, "y"), edges, "y", rho, key))
        before = now.select(F.col(key).alias("_k"), F.col("y").alias("_y"))
        out = now if out is None else out.unionByName(now)
    return out


def multilevel(spark, n_side: int = 24, blocks: tuple[int, ...] = (4, 2), processes: tuple[str, ...] = ("SAR", "SAR", "SAR"), rhos: tuple[float, ...] = (0.4, 0.5, 0.4), betas: list[list[float]] | None = None, sigmas: tuple[float, ...] = (1.0, 0.5, 0.5), err_hetero: bool = False, seed: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """For each level, lowest first: a table (id, parent, z.., y) and its lattice's edges.

    Cells of a level nest in blocks of the next one's; each level's effects follow its own process,
    and the level above enters its mean.
    """
    if bad := set(processes) - {"SAR", "SEM", "OLS"}:
        raise ValueError(f"levels are SAR, SEM or OLS, not {sorted(bad)}")
    if n_side % int(np.prod(blocks)):
        raise ValueError("n_side must be divisible by the product of blocks")
    sides = [n_side]
    for b in blocks:
        sides.append(sides[-1] // b)
    betas = betas or [[1.0, 1.0, -1.0], *[[0.5]] * len(blocks)]
    levels: list = [None] * len(sides)
    for n in reversed(range(len(sides))):
        side, top = sides[n], n == len(sides) - 1
        base = spark.range(side * side).withColumnRenamed("id", "unit_id")
        up = blocks[n] if not top else 1
        above = F.floor(F.floor(F.col("unit_id") / side) / up) * (sides[n + 1] if not top else 1) + F.floor(F.pmod("unit_id", F.lit(side)) / up)
        base = base.withColumn("parent", F.lit(None).cast("long") if top else above.cast("long"))
        beta = betas[n] if n == 0 else [0.0, *betas[n]]
        df, zs = design(base, len(beta) - 1, seed + n, ["unit_id"], "z")
        mean = linear(beta, zs)
        if not top:
            higher = levels[n + 1][0].select(F.col("unit_id").alias("_p"), F.col("y").alias("_above"))
            df = df.join(higher, F.col("parent") == F.col("_p")).drop("_p")
            mean = mean + F.col("_above")
        edges = lattice(spark, side)
        e = normal(seed + n, "noise", "unit_id") * (hetero(sigmas[n], zs) if err_hetero and n == 0 else F.lit(sigmas[n]))
        out = predictor(df, edges, {"SAR": "lag", "SEM": "error", "OLS": "none"}[processes[n]], mean, e, rhos[n], "y", "unit_id", None)
        levels[n] = (cut(out.select("unit_id", "parent", *zs, "y")), edges)
    return levels
