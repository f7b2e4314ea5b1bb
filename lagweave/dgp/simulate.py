"""Simulated tables with known parameters.

Spatial filters are applied by a Neumann series of lag joins, so that nothing n-sized is on the
driver; terms are added until the next one's bound is below ``tolerance``. Noise comes from hashes
of the keys: the same keys and seed give the same table, on any number of partitions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import gammaln, ndtr
from ..lineage import cut
from ..operators.lags import spatial_lag
from ..shipping import ship


def uniform(seed: int, label: str, *keys: str) -> Column:
    """A uniform number in (0, 1) from the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(label), *[F.col(k) for k in keys]), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, label: str, *keys: str) -> Column:
    radius = F.sqrt(-2 * F.log(uniform(seed, label + "/r", *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, label + "/a", *keys))


def filtered(df: DataFrame, edges: DataFrame, column: str | list[str], rho: float, key: str = "unit_id", over: list[str] | None = None, tolerance: float = 1e-10, dense_most: int = 1000) -> DataFrame:
    """``df`` with ``column`` (or each of several) replaced by (I - rho W)^-1 of it; rows of W sum to 1 at most.

    Graphs of up to ``dense_most`` units are solved exactly, a period (or other value of ``over``)
    to a task's group; larger ones by the series, to ``tolerance``.
    """
    if not abs(rho) < 1:
        raise ValueError("the series needs |rho| < 1")
    if rho == 0:
        return df
    columns = [column] if isinstance(column, str) else column
    rows = edges.select("focal", "neighbor", "w").limit(50 * dense_most + 1).collect()
    if len(rows) <= 50 * dense_most and len(known := sorted({r[0] for r in rows} | {r[1] for r in rows})) <= dense_most:
        return _solved(df, columns, rho, key, over or [], known, rows)
    steps = max(1, math.ceil(math.log(tolerance) / math.log(abs(rho))))
    terms = [f"_term{i}" for i in range(len(columns))]
    work = df.withColumns({f"_sum{i}": F.col(c) for i, c in enumerate(columns)} | {t: F.col(c) for t, c in zip(terms, columns, strict=True)}).drop(*columns)
    for k in range(steps):
        lagged = spatial_lag(work, edges, terms, key=key, over=over)
        work = lagged.withColumns({f"_sum{i}": F.col(f"_sum{i}") + rho * F.col(f"W_{t}") for i, t in enumerate(terms)} | {t: rho * F.col(f"W_{t}") for t in terms}).drop(*[f"W_{t}" for t in terms])
        if k % 4 == 3:
            work = cut(work)
    return work.withColumnsRenamed({f"_sum{i}": c for i, c in enumerate(columns)}).drop(*terms)


def _solved(df: DataFrame, columns: list[str], rho: float, key: str, over: list[str], known: list, rows: list) -> DataFrame:
    place = {u: i for i, u in enumerate(known)}
    at = np.array([(place[r[0]], place[r[1]]) for r in rows], np.int64).reshape(-1, 2)
    a = np.eye(len(known))
    np.subtract.at(a, (at[:, 0], at[:, 1]), rho * np.array([r[2] for r in rows], float))
    shared = df.sparkSession.sparkContext.broadcast(np.linalg.inv(a))

    def run(pdf):
        spot = pdf[key].map(place)
        some = spot.notna().to_numpy()
        values = np.zeros((len(known), len(columns)))
        values[spot[some].astype(int)] = pdf.loc[some, columns].to_numpy()
        pdf.loc[some, columns] = (shared.value @ values)[spot[some].astype(int)]
        return pdf

    names = [c for c in df.columns if c not in columns] + columns
    groups = over or [F.lit(0).alias("_all")]
    return ship_and(df).groupBy(*groups).applyInPandas(run, df.schema).select(*names)


def ship_and(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df


def gaussian(units: DataFrame, edges: DataFrame, beta: list[float], rho: float = 0.0, lam: float = 0.0, theta: list[float] | None = None, sigma: float = 1.0, seed: int = 0, key: str = "unit_id", time: str | None = None, unit_sd: float = 0.0, time_sd: float = 0.0, err_hetero: bool = False) -> DataFrame:
    """(keys, x1.., y): y = (I - rho W)^-1 (b0 + X b + W X theta + effects + (I - lam W)^-1 e).

    ``unit_sd`` and ``time_sd`` are the sds of unit and period effects, the first period's 0;
    ``err_hetero`` scales e by sqrt(1 + |row of the design|^2).
    """
    keys, over = [key, *([time] if time else [])], [time] if time else None
    xs = [f"x{i}" for i in range(1, len(beta))]
    df = units.select(*keys).withColumns({x: normal(seed, x, *keys) for x in xs})
    size = F.lit(2.0)
    for x in xs:
        size = size + F.col(x) * F.col(x)
    df = df.withColumn("_u", (sigma * F.sqrt(size) if err_hetero else F.lit(float(sigma))) * normal(seed, "noise", *keys))
    df = filtered(df, edges, "_u", lam, key, over)
    mean = F.lit(beta[0])
    for x, b in zip(xs, beta[1:], strict=True):
        mean = mean + b * F.col(x)
    if theta:
        df = spatial_lag(df, edges, xs, key=key, over=over)
        for x, t in zip(xs, theta, strict=True):
            mean = mean + t * F.col(f"W_{x}")
    if unit_sd:
        mean = mean + unit_sd * normal(seed, "unit", key)
    if time and time_sd:
        first = units.agg(F.min(time).alias("t")).first()["t"]
        mean = mean + F.when(F.col(time) == first, 0.0).otherwise(time_sd * normal(seed, "period", time))
    df = df.withColumn("y", mean + F.col("_u")).select(*keys, *xs, "y")
    return filtered(df, edges, "y", rho, key, over)


def tobit(units: DataFrame, edges: DataFrame, beta: list[float], censoring: float = 0.0, **how) -> DataFrame:
    """As gaussian, with y left-censored; (.., y, censored)."""
    df = gaussian(units, edges, beta, **how)
    return df.withColumn("censored", F.col("y") <= censoring).withColumn("y", F.greatest(F.col("y"), F.lit(censoring)))


def _from_eta(df: DataFrame, seed: int, keys: list[str], draw) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pdf.assign(y=draw(pdf["y"].to_numpy(), pdf["_q"].to_numpy()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("_q", uniform(seed, "outcome", *keys)).mapInPandas(run, f"{fields}, _q double").drop("_q")


def binary(units: DataFrame, edges: DataFrame, beta: list[float], rho: float, link: str = "logit", seed: int = 0, key: str = "unit_id") -> DataFrame:
    """Reduced form: eta = (I - rho W)^-1 X b, y a 0/1 draw."""
    eta = gaussian(units, edges, beta, rho=rho, sigma=0.0, seed=seed, key=key)
    chance = (lambda e: 1 / (1 + np.exp(-e))) if link == "logit" else ndtr
    return _from_eta(eta, seed, [key], lambda e, q: (q < chance(e)).astype(float))


def negbin(units: DataFrame, edges: DataFrame, beta: list[float], rho: float, alpha: float, seed: int = 0, key: str = "unit_id") -> DataFrame:
    """Reduced form: counts with mean exp(eta) and size alpha, by inverting the distribution."""
    eta = gaussian(units, edges, beta, rho=rho, sigma=0.0, seed=seed, key=key)

    def draw(e, q):
        out, total, k = np.zeros(len(e)), np.zeros(len(e)), 0
        left = np.ones(len(e), bool)
        log_p = np.log(alpha) - np.logaddexp(np.log(alpha), e)
        while left.any() and k < 100_000:
            mass = np.exp(gammaln(k + alpha) - gammaln(alpha) - gammaln(k + 1.0) + alpha * log_p + k * (e - np.logaddexp(np.log(alpha), e)))
            total = total + mass
            left = total < q
            out = np.where(left, k + 1, out)
            k += 1
        return out

    return _from_eta(eta, seed, [key], draw)
