"""Spatial count flows: filters and chains against known truths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.models import flow_counts, flows, solves
from lagweave.models.flows import Shocks
from lagweave.models.spec import Priors
from lagweave.operators import lags, weights
from lagweave.sources import tables


def ring(n):
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i - 1) % n] = w[i, (i + 1) % n] = 0.5
    return w


def test_filters_are_the_solves():
    rng, w = np.random.default_rng(0), ring(7)
    x = rng.standard_normal((49, 2))
    one = flow_counts.FlowFilter(x, w, True)(np.array([0.3, 0.2]))
    assert np.allclose(one[:, 1], solves.kron_solve(w, x[:, 1].reshape(7, 7), 0.3, 0.2).ravel())
    full = flow_counts.FlowFilter(x, w, False)(np.array([0.3, 0.2, 0.1]))
    assert np.allclose(full[:, 0], solves.unrestricted_solve(w, x[:, 0].reshape(7, 7), 0.3, 0.2, 0.1).ravel())


@pytest.mark.parametrize("kind,separable", [("negbin", True), ("poisson", True), ("poisson", False), ("zinb", True), ("hurdle", True)])
def test_chains_find_their_parameters(kind, separable):
    n, rng = 16, np.random.default_rng(2)
    w, x = ring(n), np.column_stack([np.ones(n * n), rng.standard_normal(n * n)])
    r = np.array([0.35, 0.2] if separable else [0.35, 0.2, 0.1])
    mu = np.exp(flow_counts.FlowFilter(x, w, separable)(r) @ [0.6, 0.7])
    y = rng.poisson(mu) if kind == "poisson" else rng.poisson(rng.gamma(3.0, mu / 3.0))
    z = None
    if kind in ("zinb", "hurdle"):
        z = x
        on = rng.random(n * n) < 1 / (1 + np.exp(-flow_counts.FlowFilter(x, w, True)(np.array([0.2, 0.1])) @ [0.8, 1.0]))
        y = np.where(on, np.maximum(y, 1) if kind == "hurdle" else y, 0)
    out = flow_counts.FlowCountKernel(kind, y.astype(float), x, z, w, separable, Priors()).run(120, 80, 3)
    mean, sd = out.mean(0), out.std(0)
    at = len(r) + (kind != "poisson")
    if kind != "hurdle":  # counts were raised to 1 there, which is no truncated draw
        assert abs(mean[0] - 0.35) < 4 * sd[0] + 0.05 and abs(mean[at + 1] - 0.7) < 4 * sd[at + 1] + 0.05
    assert np.isfinite(out).all()


def test_fits_need_every_pair(spark):
    edges = weights.ring(spark, 5)
    units = spark.range(5).selectExpr("id AS unit_id", "CAST(id AS DOUBLE) / 5 AS v")
    table = lags.flow_design(units, ["v"]).selectExpr("*", "CAST((origin * 3 + dest * 2) % 4 AS DOUBLE) AS y")
    fit = flow_counts.fit("SARZINBFlow", table, edges, ["intercept", "dest_v", "orig_v"], draws=10, tune=5, n_chains=2)
    assert fit.draws.count() == 20 and fit.posterior_predictive(2).count() >= 50 and fit.summary().count() == len(fit.names)
    with pytest.raises(ValueError, match="every pair"):
        flow_counts.fit("SARNegBinFlow", table.filter("origin <> 2 OR dest <> 1"), edges, ["intercept"])
    with pytest.raises(ValueError):
        flow_counts.fit("OLSFlow", table, edges, ["intercept"])


def test_effects_of_shocks_are_those_of_the_cube():
    rng, n = np.random.default_rng(3), 6
    w = rng.random((n, n)) * (1 - np.eye(n))
    w /= w.sum(1, keepdims=True)
    for rd, ro, rw in ((0.3, 0.2, -0.06), (0.3, 0.2, 0.1), (0.0, 0.0, 0.0)):
        got = Shocks(w)(rd, ro, rw)
        eye = np.eye(n)
        for k, shock in enumerate((lambda j: np.outer(np.ones(n), eye[j]), lambda j: np.outer(eye[j], np.ones(n)), lambda j: np.outer(eye[j], eye[j]))):
            moved = [solves.unrestricted_solve(w, shock(j), rd, ro, rw) for j in range(n)]
            want = [sum(m.sum() for m in moved), sum(m[j, j] for j, m in enumerate(moved)), sum(m[j].sum() for j, m in enumerate(moved)), sum(m[:, j].sum() for j, m in enumerate(moved))]
            assert np.allclose(got[k], want)


def test_flow_replicates(spark):
    edges = weights.ring(spark, 5)
    units = spark.range(5).selectExpr("id AS unit_id", "CAST(id AS DOUBLE) / 5 AS v")
    table = lags.flow_design(units, ["v"]).selectExpr("*", "CAST((origin * 3 + dest * 2) % 4 AS DOUBLE) AS y").cache()
    fit = flows.fit("SARFlow", table, edges, units, ["intercept", "dest_v", "orig_v"], draws=20, tune=10, n_chains=1)
    assert fit.posterior_predictive(table, 4).count() >= 100
    assert fit.impacts().count() == 5


def test_arrays_and_choices_of_graphs(spark):
    w = ring(6)
    units, edges = tables.from_arrays(spark, np.arange(6.0), np.arange(12.0).reshape(6, 2), w)
    assert units.columns == ["unit_id", "y", "x1", "x2"] and edges.count() == 12
    assert weights.resolve(spark, edges, units).count() == 12 and weights.resolve(spark, n_side=3, kind="rook").count() == 24
    with pytest.raises(ValueError):
        tables.from_arrays(spark, np.arange(5.0), np.arange(12.0).reshape(6, 2), w)
    with pytest.raises(ValueError):
        weights.resolve(spark)
    assert lags.has_level(units.withColumn("one", F.lit(1.0)), ["x1", "one"]) and not lags.has_level(units, ["x1", "y"])
