"""Gaussian spatial regressions: one Gram matrix, one chain to a Spark task, draws as a table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..diagnostics import posterior
from ..functions.special import slice_sample
from ..operators.gram import Gram, ols
from ..operators.lags import spatial_lag, time_lag, within
from ..operators.weights import check
from ..shipping import ship
from ..plans.formula import compile_formula
from .logdet import dense, index_of, log_det
from .spec import SPECS, Priors, validate


@dataclass
class Kernel:
    """What a chain needs: cross-products, prior, Jacobian."""

    process: str
    names: list[str]
    zz: np.ndarray
    zy: np.ndarray
    yy: float
    zwy: np.ndarray
    ywy: float
    wywy: float
    zwz: np.ndarray
    wzwz: np.ndarray
    wzy: np.ndarray
    wzwy: np.ndarray
    n: float
    mean: np.ndarray
    precision: np.ndarray
    shape: float
    scale: float
    low: float
    high: float
    jacobian: object
    times: float
    shift: float
    filtered: np.ndarray | None = None

    def log_jacobian(self, r: float) -> float:
        return float(self.times * self.jacobian(r) - self.shift * np.log1p(-r)) if self.jacobian is not None else 0.0

    def parts(self, r: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Cross-products of the filtered regressors and outcome."""
        # Columns that the process filters (all of an error process; the lagged outcome of a restricted
        # dynamic panel) are z - r Wz, the others z.
        f = self.filtered if self.filtered is not None else np.full(len(self.zy), float(self.process == "error"))
        cross = self.zwz * f[None]
        zz = self.zz - r * (cross + cross.T) + r * r * self.wzwz * np.outer(f, f)
        zy = self.zy - r * (self.zwy + f * self.wzy) + r * r * f * self.wzwy
        return zz, zy, self.yy - 2 * r * self.ywy + r * r * self.wywy

    def log_density(self, r: float, s2: float) -> float:
        """log p(r | s2) up to a constant, beta integrated out."""
        zz, zy, yy = self.parts(r)
        p = zz / s2 + np.diag(self.precision)
        b = zy / s2 + self.precision * self.mean
        c = np.linalg.cholesky(p)
        u = np.linalg.solve(c, b)
        return self.log_jacobian(r) - yy / (2 * s2) - np.log(np.diag(c)).sum() + 0.5 * u @ u

    def run(self, draws: int, tune: int, seed: int) -> np.ndarray:
        """Sweeps of sigma2 | beta, r; then r | sigma2; then beta | r, sigma2."""
        rng = np.random.default_rng(seed)
        k = len(self.names)
        r = 0.0 if self.process == "none" else float(rng.uniform(max(self.low, -0.2), min(self.high, 0.2)))
        beta = np.linalg.solve(self.zz + 1e-9 * np.eye(k), self.zy)
        out = np.empty((draws, k + 2))
        width = 0.1 * (self.high - self.low)
        for i in range(tune + draws):
            zz, zy, yy = self.parts(r)
            rss = max(yy - 2 * beta @ zy + beta @ zz @ beta, 1e-12)
            s2 = (self.scale + rss / 2) / rng.gamma(self.shape + self.n / 2)
            if self.process != "none":
                r = slice_sample(lambda x: self.log_density(x, s2), r, self.low, self.high, width, rng)
                zz, zy, yy = self.parts(r)
            c = np.linalg.cholesky(zz / s2 + np.diag(self.precision))
            m = np.linalg.solve(c.T, np.linalg.solve(c, zy / s2 + self.precision * self.mean))
            beta = m + np.linalg.solve(c.T, rng.standard_normal(k))
            if i >= tune:
                out[i - tune] = [r, np.sqrt(s2), *beta]
        return out

    def log_marginal(self, grid: int = 60) -> float:
        """log evidence by quadrature over log sigma2 and the spatial parameter."""
        x, w = np.polynomial.legendre.leggauss(grid)
        rs = (self.low + self.high) / 2 + (self.high - self.low) / 2 * 0.999 * x if self.process != "none" else np.zeros(1)
        wr = 0.999 * w / 2 if self.process != "none" else np.ones(1)
        terms = []
        for r, weight in zip(rs, wr, strict=True):
            zz, zy, yy = self.parts(r)
            b = np.linalg.solve(zz + 1e-9 * np.eye(len(zz)), zy)
            centre = np.log(max(yy - b @ zy, 1e-12) / self.n)
            ts = centre + 12 / np.sqrt(self.n) * x
            for t, wt in zip(ts, w * 12 / np.sqrt(self.n), strict=True):
                s2 = np.exp(t)
                prior = self.shape * np.log(self.scale) - np.sum(np.log(np.arange(1, int(self.shape)))) - (self.shape + 1) * t - self.scale / s2 + t
                like = self.log_density(r, s2) - self.n / 2 * (np.log(2 * np.pi) + t) + 0.5 * np.log(self.precision).sum() - 0.5 * np.sum(self.precision * self.mean**2)
                terms.append(like + prior + np.log(weight) + np.log(wt))
        top = max(terms)
        return float(top + np.log(np.sum(np.exp(np.array(terms) - top))))


class Fit:
    """A model with its draws: (chain, draw, [rho|lam,] sigma, one column for each coefficient)."""

    def __init__(self, name, spec, kernel, draws, units, edges, y, key, lagged, columns, time=None):
        self.name, self.spec, self.kernel, self.draws = name, spec, kernel, draws
        self.units, self.edges, self.y, self.key, self.lagged, self.columns = units, edges, y, key, lagged, columns
        self.time = time
        self.spatial = {"lag": "rho", "error": "lam", "none": None}[spec.process]

    def parameters(self) -> list[str]:
        return [*([self.spatial] if self.spatial else []), "sigma", *self.kernel.names]

    def summary(self) -> DataFrame:
        return posterior.summary(posterior.long_draws(self.draws, self.parameters()))

    def means(self) -> dict[str, float]:
        row = self.draws.agg(*[F.avg(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(self.parameters())]).first()
        return dict(zip(self.parameters(), row, strict=True))

    def fitted(self) -> DataFrame:
        """(keys, fitted, residual) at the posterior means."""
        m = self.means()
        terms = [F.lit(m[n]) * F.col(f"`{c}`") for n, c in zip(self.kernel.names, self.columns, strict=True)]
        if self.spec.process == "lag":
            terms.append(F.lit(m["rho"]) * F.col(f"W_{self.y}"))
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return self.lagged.withColumn("fitted", total).withColumn("residual", F.col(self.y) - F.col("fitted"))

    def impacts(self) -> DataFrame:
        """Direct, indirect and total effects by covariate."""
        xs = [n for n in self.kernel.names if n != "_one" and not n.startswith("W_") and not n.startswith("L_")]
        lags = {x: f"W_{x}" for x in xs if f"W_{x}" in self.kernel.names}
        if self.spec.process != "lag":
            pick = lambda x: (F.col(f"`{x}`"), F.col(f"`{x}`") + (F.col(f"`{lags[x]}`") if x in lags else F.lit(0.0)))
            return posterior.effects(self.draws, {x: pick(x) for x in (lags or xs)})
        jac, n = self.kernel.jacobian, float(self.units.select(self.key).distinct().count())

        def run(batches):
            for pdf in batches:
                g = np.asarray(jac.slope(pdf["rho"].to_numpy()))
                yield pdf.assign(_own=1 - pdf["rho"] / n * g, _own_w=-g / n)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.draws.schema)
        multiplied = self.draws.mapInPandas(run, f"{fields}, _own double, _own_w double")
        alone = float(n - self.edges.select("focal").distinct().count())
        row_sum = ((n - alone) / (1 - F.col("rho")) + alone) / n
        row_sum_w = (n - alone) / (n * (1 - F.col("rho")))
        effect = {}
        for x in lags or xs:
            direct, total = F.col("_own") * F.col(f"`{x}`"), row_sum * F.col(f"`{x}`")
            if x in lags:
                direct, total = direct + F.col("_own_w") * F.col(f"`{lags[x]}`"), total + row_sum_w * F.col(f"`{lags[x]}`")
            effect[x] = (direct, total)
        return posterior.effects(multiplied, effect)

    def log_marginal(self) -> float:
        return self.kernel.log_marginal()

    def tests(self) -> DataFrame:
        """The score tests of what the model leaves out."""
        from ..diagnostics.score_tests import tests

        return tests(self)

    def decision(self, alpha: float = 0.05) -> DataFrame:
        """One row (model, path): what the tests imply."""
        from ..diagnostics.score_tests import decide

        return decide(self.tests(), self.name, self.time is not None, alpha)


def stored_chains(spark, kernel, names: list[str], draws: int, tune: int, n_chains: int, seed: int, path: str) -> DataFrame:
    """As ``chains``, kept as a table at ``path``: chains that it already holds whole are not run again.

    A chain is named by its seed and its numbers of draws, so that other settings run anew.
    """
    mark = f"{seed}/{draws}/{tune}"
    try:
        held = spark.read.parquet(path).filter(F.col("run") == mark)
        known = {r["chain"] for r in held.groupBy("chain").count().filter(F.col("count") == draws).collect()}
    except AnalysisException:
        known = set()
    left = [c for c in range(n_chains) if c not in known]
    for c in left:  # one chain's table at a time, so that each is kept when it is done
        one = chains(spark, kernel, names, draws, tune, n_chains, seed, only=[c])
        one.withColumn("run", F.lit(mark)).write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("run") == mark).filter(F.col("chain") < n_chains).drop("run")


def chains(spark, kernel, names: list[str], draws: int, tune: int, n_chains: int, seed: int, only: list[int] | None = None) -> DataFrame:
    """One chain to a task; a task that is lost is run again from its seed, with the same draws."""
    ship(spark)
    shared = spark.sparkContext.broadcast(kernel)
    seeds = [int(s.generate_state(1)[0]) for s in np.random.SeedSequence(seed).spawn(n_chains)]

    def run(batches):
        for pdf in batches:
            for c, s in zip(pdf["chain"], pdf["seed"], strict=True):
                out = shared.value.run(draws, tune, int(s))
                yield pd.DataFrame(out, columns=names).assign(chain=c, draw=np.arange(draws))[["chain", "draw", *names]]

    wanted = [(c, s) for c, s in enumerate(seeds) if only is None or c in only]
    rows = spark.createDataFrame(wanted, "chain int, seed long").repartition(len(wanted), "chain")
    schema = "chain int, draw long, " + ", ".join(f"`{c}` double" for c in names)
    return rows.mapInPandas(run, schema)


def checked(units: DataFrame, edges: DataFrame, columns: list[str], key: str, time: str | None = None, balanced: bool = False) -> None:
    """Raises where a value is null or not finite, a unit is given twice, edges don't fit the units,
    or a panel that must be balanced isn't."""
    bad = [F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))).cast("long")).alias(f"b{i}") for i, c in enumerate(columns)]
    keys = [key, *([time] if time else [])]
    distinct = [F.count_distinct(k).alias(f"k{i}") for i, k in enumerate(keys)]
    found = units.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*keys).alias("cells"), *distinct, *bad).first()
    for i, c in enumerate(columns):
        if found[f"b{i}"]:
            raise ValueError(f"{found[f'b{i}']} values of {c} are null or not finite")
    if found["cells"] != found["n"]:
        raise ValueError(f"rows with equal or null {' and '.join(keys)}")
    if balanced and found["n"] != found["k0"] * found["k1"]:
        raise ValueError(f"the panel is not balanced: {found['n']} rows for {found['k0']} units and {found['k1']} periods")
    check(edges, units.select(key).distinct() if time else units, key)


def design(units: DataFrame, edges: DataFrame, spec, y: str, xs: list[str], key: str, time: str | None, effects: str, dynamic: str | None, durbin: list[str] | None) -> tuple[DataFrame, list[str], list[str]]:
    """The lagged table, and its columns: mean terms, and all that the Gram needs beside them."""
    over = [time] if time else None
    work = units.withColumn("_one", F.lit(1.0))
    lagging = xs if durbin is None else durbin
    if unknown := set(lagging) - set(xs):
        raise ValueError(f"not among the covariates: {sorted(unknown)}")
    terms = ["_one", *xs]
    work = spatial_lag(work, edges, [y, *terms], key=key, over=over)
    if spec.durbin:
        terms += [f"W_{x}" for x in lagging]
        work = spatial_lag(work, edges, [f"W_{x}" for x in lagging], key=key, over=over)
    if dynamic:
        moved = work.withColumnsRenamed({key: "unit", time: "time"})
        restricted = dynamic == "restricted"
        terms += [f"L_{y}"] + ([f"L_W_{y}"] if spec.durbin and not restricted else [])
        moved = time_lag(moved, [y, f"W_{y}"])
        if spec.process == "error" or restricted:
            moved = spatial_lag(moved, edges, [f"L_{y}"], key="unit", over=["time"])
        work = moved.withColumnsRenamed({"unit": key, "time": time})
    needs = [f"W_{y}", *([f"W_{t}" for t in terms] if spec.process == "error" else [f"W_L_{y}"] if dynamic == "restricted" else [])]
    if effects in ("unit", "time", "two_way"):
        terms = [t for t in terms if t != "_one"]
        needs = [c for c in needs if c != "W__one"]
        every = list(dict.fromkeys([y, *terms, *needs]))
        work = within(work.withColumnsRenamed({key: "unit", time: "time"}), every, effects)
        work = work.drop(*every).withColumnsRenamed({f"D_{c}": c for c in every} | {"unit": key, "time": time})
    return work, terms, needs


def kernel_of(g: Gram, spec, y: str, terms: list[str], priors: Priors, jacobian, n: float, times: float, shift: float, restricted: str | None = None) -> Kernel:
    wy = f"W_{y}"
    filtered = np.array([float(spec.process == "error" or t == restricted) for t in terms])
    wz = [f"W_{t}" if f else t for t, f in zip(terms, filtered, strict=True)] if filtered.any() else None
    get = lambda a, b: g.get(a, b)
    k = len(terms)
    zero = np.zeros((k, k))
    mean_y = g.get([y], ["_one"])[0, 0] / g.n
    var_y = max(g.get([y], [y])[0, 0] / g.n - mean_y**2, 1e-12)
    mx = g.get(terms, ["_one"])[:, 0] / g.n
    var_x = np.diag(g.get(terms, terms)) / g.n - mx**2
    flat = var_x <= 1e-12 * np.maximum(1.0, mx**2)
    mean, sd = priors.coefficients(mean_y, np.sqrt(var_y), g.n, np.sqrt(np.maximum(var_x, 0.0)), flat)
    return Kernel(
        spec.process, terms, get(terms, terms), get(terms, [y])[:, 0], float(get([y], [y])[0, 0]), get(terms, [wy])[:, 0], float(get([y], [wy])[0, 0]), float(get([wy], [wy])[0, 0]),
        get(terms, wz) if wz else zero, get(wz, wz) if wz else zero, get(wz, [y])[:, 0] if wz else np.zeros(k), get(wz, [wy])[:, 0] if wz else np.zeros(k),
        n, mean, 1 / sd**2, priors.sigma_shape, priors.sigma_scale if priors.sigma_scale is not None else var_y, priors.low, priors.high, jacobian, times, shift, filtered,
    )


def fit(model: str, units: DataFrame, edges: DataFrame, y: str, xs: list[str], key: str = "unit_id", time: str | None = None, effects: str = "pooled", dynamic: str | None = None, durbin: list[str] | None = None, priors=None, draws: int = 2000, tune: int = 1000, n_chains: int = 4, seed: int = 0, method: str = "auto") -> Fit:
    """Estimate OLS, SLX, SAR, SEM, SDM or SDEM.

    All that is as large as the data happens in two joins and one aggregate; only k x k sums reach
    the driver. A restricted dynamic SDM ties the coefficient of W y_t-1 to -rho phi. Fixed effects use within-transformed columns, and count the Jacobian T - 1 times
    under unit effects, less log(1 - rho) under time effects.
    """
    spec = SPECS[model]
    if spec.likelihood != "gaussian":
        raise ValueError(f"{model} is not a Gaussian model")
    validate(spec, effects, dynamic, time is not None)
    if effects == "random":
        raise NotImplementedError("random effects are in random_effects.fit")
    priors = Priors.of(priors, model, panel=time is not None, effects=effects, dynamic=dynamic)
    spark = units.sparkSession
    checked(units, edges, [y, *xs], key, time, balanced=effects != "pooled" or dynamic is not None)
    work, terms, needs = design(units, edges, spec, y, xs, key, time, effects, dynamic, durbin)
    columns = list(dict.fromkeys([y, *terms, *needs]))
    g = Gram.of(work.drop("_one") if "_one" in columns else work, [c for c in columns if c != "_one"])
    periods = units.select(time).distinct().count() - bool(dynamic) if time else 1
    n_units = g.n / periods
    times = periods - (effects in ("unit", "two_way"))
    n = (n_units - (effects in ("time", "two_way"))) * times
    jacobian = log_det(units, edges, priors.low, priors.high, key, method) if spec.process != "none" else None
    kernel = kernel_of(g, spec, y, terms, priors, jacobian, n, times, times if effects in ("time", "two_way") else 0.0, f"L_{y}" if dynamic == "restricted" else None)
    names = ["_spatial", "sigma", *terms]
    out = chains(spark, kernel, names, draws, tune, n_chains, seed)
    label = {"lag": "rho", "error": "lam"}.get(spec.process)
    out = out.withColumnRenamed("_spatial", label) if label else out.drop("_spatial")
    return Fit(model, spec, kernel, out, units, edges, y, key, work, terms, time)


def fit_formula(model: str, formula: str, units: DataFrame, edges: DataFrame, key: str = "unit_id", time: str | None = None, **how) -> Fit:
    """As ``fit``, with outcome and covariates from ``y ~ terms``; rows with a null in a term raise.

    The models have a constant of their own, so a formula without one is refused.
    """
    compiled = compile_formula(formula, units)
    if not compiled.intercept:
        raise ValueError("the models have a constant; leave '0' and '-1' out")
    keys = [key, *([time] if time else [])]
    plain, names = compiled.apply(units, keys)
    if plain.count() != units.count():
        raise ValueError("a term or the outcome is null in some rows")
    safe = {n: f"t{i}" for i, n in enumerate(names) if not n.isidentifier()}
    done = fit(model, plain.withColumnsRenamed(safe), edges, compiled.outcome, [safe.get(n, n) for n in names], key, time, **how)
    done.labels = {v: k for k, v in safe.items()}
    return done


def predict_new(fit_: Fit, units: DataFrame, edges: DataFrame, draws: int = 200, most: int = 2000) -> DataFrame:
    """(key, mean, sd) for the units of ``units`` whose outcome is null, given those that have one.

    ``units`` holds all units, old and new, with covariates, and ``edges`` join them. Under each of
    ``draws`` posterior draws the new outcomes are normal given the old ones, with precision
    (I - rW)'(I - rW) / sigma^2; mean and sd are over these. W is dense, for ``most`` units at most.
    """
    key, y = fit_.key, fit_.y
    if fit_.time is not None:
        raise ValueError("new units are predicted in cross-sections")
    ids = index_of(units, key, most)
    w = dense(edges, ids, most)
    xs = [t for t in fit_.kernel.names if t != "_one" and not t.startswith("W_")]
    rows = {r[key]: r for r in units.select(key, y, *xs).collect()}
    x = np.array([[float(rows[i][c]) for c in xs] for i in ids]).reshape(len(ids), len(xs))
    known = {"_one": np.ones(len(ids))} | {c: x[:, k] for k, c in enumerate(xs)} | {f"W_{c}": w @ x[:, k] for k, c in enumerate(xs)}
    z = np.column_stack([known[t] for t in fit_.kernel.names])
    new = np.array([rows[i][y] is None for i in ids])
    seen = np.array([0.0 if rows[i][y] is None else float(rows[i][y]) for i in ids])
    if not new.any():
        raise ValueError("no unit without an outcome")
    some = fit_.draws.orderBy("chain", "draw").toPandas()
    some = some.iloc[:: max(1, len(some) // draws)]
    means, variances = [], []
    for d in some.to_dict("records"):
        r = d.get(fit_.spatial, 0.0) if fit_.spatial else 0.0
        a = np.eye(len(ids)) - r * w
        mean = z @ np.array([d[t] for t in fit_.kernel.names])
        if fit_.spec.process == "lag":
            mean = np.linalg.solve(a, mean)
        q = a.T @ a / d["sigma"] ** 2
        cover = np.linalg.inv(q[np.ix_(new, new)])
        means.append(mean[new] - cover @ q[np.ix_(new, ~new)] @ (seen - mean)[~new])
        variances.append(np.diag(cover))
    mean, sd = np.mean(means, 0), np.sqrt(np.mean(variances, 0) + np.var(means, 0))
    out = [(i, float(m), float(s)) for i, m, s in zip(np.array(ids, object)[new], mean, sd, strict=True)]
    return units.sparkSession.createDataFrame(out, f"{key} {units.schema[key].dataType.simpleString()}, mean double, sd double")


def compare(fits: dict[str, Fit]) -> DataFrame:
    """(model, log_marginal, log_bf, probability): evidences, log Bayes factors against the best, equal prior odds."""
    spark = next(iter(fits.values())).units.sparkSession
    values = {k: f.log_marginal() for k, f in fits.items()}
    top = max(values.values())
    total = sum(np.exp(v - top) for v in values.values())
    return spark.createDataFrame([(k, float(v), float(v - top), float(np.exp(v - top) / total)) for k, v in values.items()], "model string, log_marginal double, log_bf double, probability double")


def bayes_factor(a: Fit, b: Fit) -> float:
    """log evidence of a less that of b."""
    return a.log_marginal() - b.log_marginal()


__all__ = ["Fit", "Kernel", "bayes_factor", "chains", "fit", "ols"]
