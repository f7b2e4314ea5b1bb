"""Tables derived from draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval(c: str | Column, level: float = 0.95) -> Column:
    a = (1 - level) / 2
    return F.percentile(c, F.array(F.lit(a), F.lit(1 - a)))


def pvalue(c: Column) -> Column:
    """Twice the smaller of the shares of draws above and below 0."""
    return 2 * F.least(F.avg((c > 0).cast("double")), F.avg((c < 0).cast("double")))


def effects(draws: DataFrame, variables: dict[str, tuple[Column, Column]], level: float = 0.95) -> DataFrame:
    """For each variable's (direct, total) per draw: mean, interval and p-value of direct, indirect, total."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), d.cast("double").alias("d"), t.cast("double").alias("t")) for v, (d, t) in variables.items()]))
    long = draws.select(rows.alias("r")).select("r.variable", "r.d", "r.t")
    parts = {"direct": F.col("d"), "indirect": F.col("t") - F.col("d"), "total": F.col("t")}
    sums = [x for n, c in parts.items() for x in (F.avg(c).alias(f"{n}_mean"), interval(c, level).alias(f"_{n}"), pvalue(c).alias(f"{n}_pvalue"))]
    found = long.groupBy("variable").agg(*sums)
    return found.select("variable", *[x for n in parts for x in (F.col(f"{n}_mean"), F.col(f"_{n}")[0].alias(f"{n}_ci_lower"), F.col(f"_{n}")[1].alias(f"{n}_ci_upper"), F.col(f"{n}_pvalue"))])


def long_draws(draws: DataFrame, columns: list[str]) -> DataFrame:
    """(chain, draw, label, value) from one column for each parameter."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in columns]))
    return draws.select("chain", "draw", cells.alias("c")).select("chain", "draw", "c.*")


def summary(long: DataFrame, level: float = 0.95) -> DataFrame:
    """(label, mean, sd, lower, upper)."""
    found = long.groupBy("label").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), interval("value", level).alias("i"))
    return found.select("label", "mean", "sd", F.col("i")[0].alias("lower"), F.col("i")[1].alias("upper"))


def thinned(draws: DataFrame, step: int) -> DataFrame:
    return draws.filter(F.pmod("draw", F.lit(step)) == 0)


def predict_in_sample(units: DataFrame, edges: DataFrame, y: str, fit: Column, theta: float, key: str = "unit_id") -> DataFrame:
    """(unit_id, y_bp): each unit's mean given all others, y - (A'A r)_i / (A'A)_ii with A = I - theta W."""
    from ..operators.lags import spatial_lag

    r = units.withColumn("_r", F.col(y) - fit)
    a = spatial_lag(r, edges, ["_r"], key=key).withColumn("_a", F.col("_r") - theta * F.col("W__r"))
    b = spatial_lag(a, edges, ["_a"], key=key, transpose=True)
    own = edges.groupBy(F.col("neighbor").alias("_k")).agg(F.sum(F.col("w") * F.col("w")).alias("_ww"))
    self_loops = edges.filter("focal = neighbor").select(F.col("focal").alias("_s"), F.col("w").alias("_wii"))
    joined = b.join(own, F.col(key) == F.col("_k"), "left").join(self_loops, F.col(key) == F.col("_s"), "left")
    diagonal = 1 - 2 * theta * F.coalesce("_wii", F.lit(0.0)) + theta * theta * F.coalesce("_ww", F.lit(0.0))
    return joined.select(F.col(key), (F.col(y) - (F.col("_a") - theta * F.col("W__a")) / diagonal).alias("y_bp"))


def lag_totals(rho: Column, n: int, isolates: int) -> Column:
    """Mean row sum of (I - rho W)^-1 for standardized W with isolates, whose rows are those of I."""
    return ((n - isolates) / (1 - rho) + isolates) / n


def log_mean_exp(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, lpd): log of the mean of exp(value) over draws, from the largest value down."""
    top = draws.groupBy(*keys).agg(F.max(value).alias("_m"))
    joined = draws.join(top, keys)
    found = joined.groupBy(*keys).agg((F.first("_m") + F.log(F.avg(F.exp(F.col(value) - F.col("_m"))))).alias("lpd"))
    return found


def bic(draws: DataFrame, log_lik: str, parameters: int, n: int) -> DataFrame:
    """One row: bic from the largest log-likelihood among draws."""
    import math

    return draws.agg((parameters * math.log(n) - 2 * F.max(log_lik)).alias("bic"))


def negbin_zero(eta: Column, alpha: Column) -> Column:
    """P(0) of NB2 with mean exp(eta)."""
    return F.exp(alpha * (F.log(alpha) - F.log(alpha + F.exp(eta))))


def pg_weight(shape: Column, psi: Column) -> Column:
    """Mean of PG(shape, psi)."""
    return F.when(F.abs(psi) < 1e-6, shape / 4).otherwise(shape * F.tanh(psi / 2) / (2 * psi))
