"""Lagrange-multiplier tests at a least-squares fit, from one Gram matrix and one trace."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf
from ..operators.gram import Gram
from ..operators.lags import spatial_lag
from ..operators.weights import trace_information

SCHEMA = "test string, statistic double, df int, p_value double, error string"


def efficient(g: np.ndarray, j: np.ndarray, tested: list[int], robust: list[int], free: list[int]) -> float:
    """g' V^-1 g for the tested scores, with nuisance parameters projected out.

    ``free`` are estimated under the null (their scores vanish); ``robust`` are fixed at 0 there
    but may differ from it, and their scores are projected out too.
    """
    def project(idx: list[int], off: list[int], g: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not off:
            return g[idx], j[np.ix_(idx, idx)]
        b = np.linalg.solve(j[np.ix_(off, off)], j[np.ix_(off, idx)]).T
        return g[idx] - b @ g[off], j[np.ix_(idx, idx)] - b @ j[np.ix_(off, idx)]

    rest = [*tested, *robust]
    score, info = project(rest, free, g, j)
    k = len(tested)
    score, info = project(list(range(k)), list(range(k, len(rest))), score, info)
    return float(score @ np.linalg.solve(info, score))


def battery(units: DataFrame, edges: DataFrame, y: str, xs: list[str], key: str = "unit_id", periods: int = 1, over: list[str] | None = None) -> DataFrame:
    """(test, statistic, df, p_value, error) for the tests of an OLS null.

    Parameters are (beta, rho, lambda, theta); the information is that of the full model at the
    fit. A test that can't be computed gives a row with its error.
    """
    spark = units.sparkSession
    work = units.withColumn("_one", F.lit(1.0)) if "_one" not in units.columns else units
    lagged = spatial_lag(work, edges, [y, *xs, "_one"], key=key, over=over)
    # Columns less their means: what the intercept takes is taken exactly, so that sums don't cancel
    # however far y is from 0. A second pass is over the residuals themselves.
    x, wx = ["_one", *xs], [f"W_{c}" for c in xs]
    columns = [y, *xs, f"W_{y}", *wx, "W__one"]
    mean = lagged.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centred = lagged.select(*[(F.col(c) - float(mean[f"m{i}"] or 0.0)).alias(c) for i, c in enumerate(columns)])
    at = {c: float(mean[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
    g = Gram.of(centred, [y, *xs])
    slopes = np.linalg.solve(g.get(xs, xs), g.get(xs, [y])[:, 0])
    level = at[y] - sum(b * at[c] for b, c in zip(slopes, xs, strict=True))
    fitted = sum((float(v) * F.col(c) for c, v in zip(xs, slopes, strict=True)), F.lit(0.0))
    lagged_fit = sum((float(v) * F.col(c) for c, v in zip(wx, slopes, strict=True)), float(level) * F.col("W__one"))
    seen = centred.withColumns({"e": F.col(y) - fitted, "Wf": lagged_fit}).withColumn("We", F.col(f"W_{y}") - F.col("Wf"))
    h = Gram.of(seen, ["e", "We", "Wf", f"W_{y}", *xs, *wx])
    s2 = h.get(["e"], ["e"])[0, 0] / h.n
    trace = trace_information(edges).first()["trace"] * periods
    k, m = len(x), len(xs)
    names = {"rho": [k], "lambda": [k + 1], "theta": list(range(k + 2, k + 2 + m))}
    score = np.zeros(k + 2 + m)
    score[k], score[k + 1] = h.get(["e"], [f"W_{y}"])[0, 0] / s2, h.get(["e"], ["We"])[0, 0] / s2
    score[k + 2 :] = h.get(["e"], wx)[0] / s2
    cols = [*x, "Wf", *wx]
    cross = h.get(cols, cols) / s2
    info = np.zeros((k + 2 + m, k + 2 + m))
    beta, theta = list(range(k)), names["theta"]
    at = [*beta, k, *theta]
    info[np.ix_(at, at)] = cross
    info[k, k] += trace
    info[k + 1, k + 1] = trace
    info[k, k + 1] = info[k + 1, k] = trace
    suite = {
        "LM-Lag": (["rho"], []), "LM-Error": (["lambda"], []), "Robust-LM-Lag": (["rho"], ["lambda"]), "Robust-LM-Error": (["lambda"], ["rho"]),
        "LM-WX": (["theta"], []), "LM-SDM-Joint": (["rho", "theta"], []), "LM-SLX-Error-Joint": (["lambda", "theta"], []), "Robust-LM-WX": (["theta"], ["rho"]),
    }
    rows = []
    for test, (tested, robust) in suite.items():
        t, r = (sorted(i for n in part for i in names[n]) for part in (tested, robust))
        try:
            stat = efficient(score, info, t, r, beta)
            rows.append((test, stat, len(t), chi2_sf(stat, len(t)), None))
        except np.linalg.LinAlgError as e:
            rows.append((test, float("nan"), len(t), float("nan"), str(e)))
    return spark.createDataFrame(rows, SCHEMA)


def decide(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row (model, path): the specification that the significant tests of ``battery`` imply."""
    from .score_tests import decide as read

    return read(tests, "OLS", alpha=alpha)
