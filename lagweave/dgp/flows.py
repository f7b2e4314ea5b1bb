"""Simulated origin-destination flows.

The filter I - rd Wd - ro Wo - rw Ww (lags over destinations, origins and both) is inverted by a
series of flow lags, or, where rw = -rd ro, by one series over each end. No pairs x pairs matrix
is formed. Rows are keyed by origin, dest and, in panels, time.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.lags import flow_lags
from .designs import drawn, intercept_shift, negbin_at, poisson_at
from .simulate import filtered, normal, uniform

ENDS = ["origin", "dest"]


def stable(rd: float, ro: float, rw: float) -> bool:
    """Whether the sufficient bound of the unrestricted filter holds; warns where it doesn't."""
    if abs(rd) + abs(ro) + abs(rw) < 1:
        return True
    warnings.warn("|rho_d| + |rho_o| + |rho_w| is 1 or more: the flow filter may not be stable", stacklevel=2)
    return False


def flow_filtered(flows: DataFrame, edges: DataFrame, column: str, rd: float, ro: float, rw: float | None = None, extra: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """``flows`` with ``column`` replaced by the inverse filter of it; ``rw`` None is -rd ro."""
    extra = extra or []
    if rw is None or math.isclose(rw, -rd * ro, abs_tol=1e-15):
        one = filtered(flows, edges, column, rd, "dest", ["origin", *extra], tolerance)
        return filtered(one, edges, column, ro, "origin", ["dest", *extra], tolerance)
    size = abs(rd) + abs(ro) + abs(rw)
    if size >= 1:
        raise ValueError("the series needs |rho_d| + |rho_o| + |rho_w| < 1")
    if size == 0:
        return flows
    work = flows.withColumns({"_sum": F.col(column), "_term": F.col(column)}).drop(column)
    for k in range(max(1, math.ceil(math.log(tolerance) / math.log(size)))):
        lagged = flow_lags(work, edges, "_term", extra)
        term = rd * F.col("Wd__term") + ro * F.col("Wo__term") + rw * F.col("Ww__term")
        work = lagged.withColumn("_term", term).drop("Wd__term", "Wo__term", "Ww__term").withColumn("_sum", F.col("_sum") + F.col("_term"))
        if k % 3 == 2:
            work = cut(work)
    return work.withColumnRenamed("_sum", column).drop("_term")


def pairs(units: DataFrame, k_d: int, k_o: int, seed: int, key: str = "unit_id") -> tuple[DataFrame, list[str], list[str]]:
    """All pairs, with covariates of both ends and log1p of their distance.

    Units have places (px, py), their own where the table has them and random ones in a square
    otherwise. The result has as many rows as there are pairs, which is what is simulated.
    """
    place = {} if {"px", "py"} <= set(units.columns) else {p: uniform(seed, p, key) for p in ("px", "py")}
    known = units.withColumns(place) if place else units
    ds, os = [f"d{i}" for i in range(1, k_d + 1)], [f"o{i}" for i in range(1, k_o + 1)]
    o = known.select(F.col(key).alias("origin"), F.col("px").alias("_ox"), F.col("py").alias("_oy"), *[normal(seed, f"orig{i}", key).alias(c) for i, c in enumerate(os)])
    d = known.select(F.col(key).alias("dest"), F.col("px").alias("_dx"), F.col("py").alias("_dy"), *[normal(seed, f"dest{i}", key).alias(c) for i, c in enumerate(ds)])
    far = F.sqrt(F.pow(F.col("_ox") - F.col("_dx"), 2) + F.pow(F.col("_oy") - F.col("_dy"), 2))
    return o.crossJoin(d).withColumn("log_distance", F.log1p(far)).drop("_ox", "_oy", "_dx", "_dy"), ds, os


def _mean(beta_d: list[float], beta_o: list[float], gamma: float, intercept: float, ds: list[str], os: list[str]) -> Column:
    total = F.lit(float(intercept)) + float(gamma) * F.col("log_distance")
    for c, b in [*zip(ds, beta_d, strict=True), *zip(os, beta_o, strict=True)]:
        total = total + float(b) * F.col(c)
    return total


def _spread(sigma: float, ds: list[str], os: list[str], err_hetero: bool) -> Column:
    """sigma, or sigma sqrt(1 + |x_dest|^2 + |x_orig|^2)."""
    if not err_hetero:
        return F.lit(float(sigma))
    total = F.lit(1.0)
    for c in [*ds, *os]:
        total = total + F.col(c) * F.col(c)
    return sigma * F.sqrt(total)


def flows(units: DataFrame, edges: DataFrame, process: str = "lag", rho_d: float = 0.3, rho_o: float = 0.2, rho_w: float | None = 0.1, beta_d: list[float] = (1.0, 0.5), beta_o: list[float] = (0.5, 0.3), gamma_dist: float = -0.5, intercept: float = 0.0, sigma: float = 1.0, periods: int = 1, pair_sd: float = 0.0, time_sd: float = 0.0, err_hetero: bool = False, family: str = "gaussian", alpha: float = 2.0, mean_count: float | None = None, seed: int = 0, key: str = "unit_id") -> DataFrame:
    """(origin, dest, [time,] covariates, log_distance, eta, y).

    A lag process filters mean, pair effects and noise; an error process filters the noise alone.
    ``family``: gaussian, lognormal (y = exp(eta)), or the reduced forms negbin and poisson, whose
    eta is the filtered mean without noise; ``mean_count`` then shifts eta so that the mean count is
    that. ``rho_w`` None is the separable filter. Panels repeat pairs with effects of sd ``pair_sd``.
    """
    counts = family in ("negbin", "poisson")
    if family not in ("gaussian", "lognormal", "negbin", "poisson"):
        raise ValueError(f"unknown family {family!r}")
    stable(rho_d, rho_o, -rho_d * rho_o if rho_w is None else rho_w) if rho_w is not None else None
    df, ds, os = pairs(units, len(beta_d), len(beta_o), seed, key)
    keys, extra = list(ENDS), []
    if periods > 1:
        df, keys, extra = df.withColumn("time", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(periods - 1).cast("long")))), [*ENDS, "time"], ["time"]
    mean = _mean(beta_d, beta_o, gamma_dist, intercept, ds, os)
    if pair_sd:
        mean = mean + pair_sd * normal(seed, "pair", *ENDS)
    noise = F.lit(0.0) if counts else _spread(sigma, ds, os, err_hetero) * normal(seed, "noise", *keys)
    names = df.columns
    if process == "lag":
        out = flow_filtered(df.withColumn("eta", mean + noise), edges, "eta", rho_d, rho_o, rho_w, extra)
    elif process == "error":
        out = flow_filtered(df.withColumns({"_mean": mean, "eta": noise}), edges, "eta", rho_d, rho_o, rho_w, extra).withColumn("eta", F.col("eta") + F.col("_mean"))
    else:
        raise ValueError(f"unknown process {process!r}")
    if time_sd and periods > 1:
        out = out.withColumn("eta", F.col("eta") + F.when(F.col("time") == 0, 0.0).otherwise(time_sd * normal(seed, "period", "time")))
    out = out.select(*names, "eta")
    if mean_count is not None:
        out = cut(out)
        now = out.agg(F.avg(F.exp("eta")).alias("m")).first()["m"]
        out = out.withColumn("eta", F.col("eta") + float(np.log(mean_count) - np.log(now)))
    if not counts:
        return out.withColumn("y", F.exp("eta") if family == "lognormal" else F.col("eta"))
    draw = (lambda q, e: negbin_at(q, np.clip(e, -30, 30), alpha)) if family == "negbin" else (lambda q, e: poisson_at(q, np.exp(np.clip(e, -30, 30))))
    return drawn(out, seed, keys, "y", ["eta"], draw)


def poisson_flows(units: DataFrame, edges: DataFrame, signal: float = 0.3, mean_count: float = 8.0, **how) -> DataFrame:
    """Poisson flows of a given mean, every coefficient of size ``signal``."""
    settings = {"beta_d": [signal, signal], "beta_o": [signal, signal], "gamma_dist": -signal} | how
    return flows(units, edges, family="poisson", mean_count=mean_count, **settings)


def two_part_flows(units: DataFrame, edges: DataFrame, kind: str = "zinb", rho_d: float = 0.3, rho_o: float = 0.2, rho_d_zero: float = 0.2, rho_o_zero: float = 0.1, beta_zero: list[float] = (0.3, 0.5, 0.5), target_pi: float | None = None, pair_sd: float = 0.0, periods: int = 1, alpha: float = 2.0, seed: int = 0, key: str = "unit_id", **how) -> DataFrame:
    """(origin, dest, [time,] covariates, eta, u, active, y): separable zero-inflated or hurdle flows.

    ``beta_zero``: constant, destination's and origin's first covariate in the activity part.
    """
    if kind not in ("zinb", "hurdle"):
        raise ValueError(f"unknown kind {kind!r}")
    count = flows(units, edges, rho_d=rho_d, rho_o=rho_o, rho_w=None, family="negbin", alpha=alpha, pair_sd=pair_sd, periods=periods, seed=seed, key=key, **how)
    extra, keys = (["time"], [*ENDS, "time"]) if periods > 1 else ([], list(ENDS))
    mean = float(beta_zero[0]) + float(beta_zero[1]) * F.col("d1") + float(beta_zero[2]) * F.col("o1")
    if pair_sd:
        mean = mean + pair_sd * normal(seed, "pair/zero", *ENDS)
    work = flow_filtered(count.drop("y").withColumn("u", mean), edges, "u", rho_d_zero, rho_o_zero, None, extra)
    if target_pi is not None:
        work = cut(flow_filtered(work.withColumn("_a", F.lit(1.0)), edges, "_a", rho_d_zero, rho_o_zero, None, extra))
        work = work.withColumn("u", F.col("u") + intercept_shift(work, "u", "_a", target_pi) * F.col("_a")).drop("_a")
    work = work.withColumn("active", (uniform(seed, "active", *keys) < 1 / (1 + F.exp(-F.col("u")))).cast("double"))
    out = drawn(work, seed, keys, "_count", ["eta"], lambda q, e: negbin_at(q, np.clip(e, -30, 30), alpha, kind == "hurdle"))
    return out.withColumn("y", F.when(F.col("active") == 1, F.col("_count")).otherwise(0.0)).drop("_count")
