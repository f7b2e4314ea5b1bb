"""Evidence by bridge sampling against closed forms and quadrature; random effects of error processes."""

import numpy as np
import pandas as pd

from lagweave.dgp import simulate
from lagweave.diagnostics import bridge
from lagweave.models import gaussian, random_effects
from lagweave.operators import weights


def test_bridges_meet_closed_forms():
    rng = np.random.default_rng(0)
    draws = np.column_stack([rng.gamma(3.0, 0.5, 6000), rng.normal(1, 2, 6000), rng.uniform(-1, 1, 6000)])
    # An unnormalized product: gamma(3, rate 2) x normal x uniform, times e^2.
    f = lambda r: 2 + 3 * np.log(2) - np.log(2) + 2 * np.log(r[0]) - 2 * r[0] - 0.5 * ((r[1] - 1) / 2) ** 2 - np.log(2 * np.sqrt(2 * np.pi)) - np.log(2)
    assert abs(bridge.log_evidence(draws, [(0, np.inf), (-np.inf, np.inf), (-1, 1)], f) - 2) < 0.05
    assert bridge.effective_size(rng.standard_normal(4000)) > 2500
    p = bridge.posterior_probabilities({"a": -10.0, "b": -11.0}, {"b": np.e})
    assert np.isclose(p["a"], 0.5) and np.isclose(bridge.bic_to_bf(10.0, 12.0), np.e)


def test_bridge_agrees_with_quadrature(spark):
    edges = weights.lattice(spark, 6).cache()
    table = simulate.gaussian(spark.range(36).withColumnRenamed("id", "unit_id"), edges, [1.0, 2.0], rho=0.4, seed=2).cache()
    for model in ("OLS", "SAR"):
        fit = gaussian.fit(model, table, edges, "y", ["x1"], draws=1500, tune=300, n_chains=2)
        assert abs(bridge.gaussian_evidence(fit) - fit.log_marginal()) < 0.3


def test_random_effects_of_error_processes(spark):
    edges = weights.lattice(spark, 8).cache()
    units = pd.DataFrame({"unit": np.repeat(np.arange(64), 6), "time": np.tile(np.arange(6), 64)})
    panel = simulate.gaussian(spark.createDataFrame(units), edges, [1.0, 2.0], lam=0.5, unit_sd=1.5, seed=4, key="unit", time="time").cache()
    for model, names in (("SEM", {"x1"}), ("SDEM", {"x1", "W_x1"})):
        mean = random_effects.fit(model, panel, edges, "y", ["x1"], draws=200, tune=100, n_chains=1).toPandas().mean()
        assert abs(mean["lam"] - 0.5) < 0.2 and abs(mean["sigma"] - 1) < 0.15 and abs(mean["sigma_alpha"] - 1.5) < 0.5 and abs(mean["x1"] - 2) < 0.2 and names <= set(mean.index)
