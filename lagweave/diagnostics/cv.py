"""Spatial cross-validation of Gaussian models by the predictive density of held-out units."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import logsumexp, normal_logpdf
from ..models import gaussian
from ..models.logdet import dense, index_of
from ..operators.weights import row_standardize


def train_graph(edges: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """Edges between ``units`` only, standardized anew."""
    ids = units.select(key)
    inside = edges.join(ids.withColumnRenamed(key, "focal"), "focal", "left_semi").join(ids.withColumnRenamed(key, "neighbor"), "neighbor", "left_semi")
    return row_standardize(inside)


def log_density(fit: gaussian.Fit, units: DataFrame, edges: DataFrame, y: str, xs: list[str], held: set, key: str, draws: int) -> np.ndarray:
    """log p(y_i | y of the training units) for held-out units, averaged over draws.

    The joint Normal of all units under each draw is conditioned on the training ones.
    """
    ids = index_of(units, key)
    w = dense(edges, ids)
    rows = {r[key]: r for r in units.select(key, y, *xs).collect()}
    x = np.array([[1.0, *[float(rows[i][c]) for c in xs]] for i in ids])
    if fit.spec.durbin:
        x = np.c_[x, w @ x[:, 1:]]
    out = np.array([float(rows[i][y]) for i in ids])
    o = np.array([i in held for i in ids])
    some = fit.draws.orderBy("chain", "draw").limit(draws).collect()
    terms = []
    for d in some:
        r = d[fit.spatial] if fit.spatial else 0.0
        a = np.eye(len(ids)) - r * w
        mean = x @ np.array([d[c] for c in fit.kernel.names])
        if fit.spec.process == "lag":
            mean = np.linalg.solve(a, mean)
        q = a.T @ a / d["sigma"] ** 2
        cov = np.linalg.inv(q[np.ix_(o, o)])
        m = mean[o] - cov @ q[np.ix_(o, ~o)] @ (out - mean)[~o]
        terms.append(normal_logpdf(out[o] - m, np.sqrt(np.diag(cov))))
    return logsumexp(np.array(terms)) - np.log(len(terms))


def spatial_cv(model: str, units: DataFrame, edges: DataFrame, folds: DataFrame, y: str, xs: list[str], key: str = "unit_id", draws: int = 200, **how) -> DataFrame:
    """One row (elpd, se, folds) for folds (key, fold) that part the units."""
    names = sorted(r[0] for r in folds.select("fold").distinct().collect())
    if len(names) < 2:
        raise ValueError("cross-validation needs two folds at least")
    each = []
    for f in names:
        held = {r[key] for r in folds.filter(F.col("fold") == f).collect()}
        train = units.join(folds.filter(F.col("fold") != f).select(key), key, "left_semi")
        fit = gaussian.fit(model, train, train_graph(edges, train, key), y, xs, key, draws=draws, tune=draws, n_chains=1, **how)
        each.append(log_density(fit, units, edges, y, xs, held, key, draws))
    every = np.concatenate(each)
    return units.sparkSession.createDataFrame([(float(every.sum()), float(np.sqrt(len(every) * every.var(ddof=1))), len(names))], "elpd double, se double, folds int")
