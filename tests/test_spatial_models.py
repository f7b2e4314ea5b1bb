"""Weights, determinants, samplers and tests on graphs whose answers are known."""

import numpy as np
import pandas as pd
import pytest

from lagweave.diagnostics import lm
from lagweave.functions import special
from lagweave.models import gaussian, logdet, rowwise
from lagweave.models.spec import SPECS, Priors, validate
from lagweave.operators import lags, weights


def rook(n):
    w = np.zeros((n * n, n * n))
    for i in range(n * n):
        r, c = divmod(i, n)
        for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            if 0 <= r + a < n and 0 <= c + b < n:
                w[i, (r + a) * n + c + b] = 1
    return w / w.sum(1, keepdims=True)


@pytest.fixture(scope="module")
def world(spark):
    n = 12
    w, rng = rook(n), np.random.default_rng(1)
    x = rng.standard_normal(n * n)
    y = np.linalg.solve(np.eye(n * n) - 0.5 * w, 1 + 2 * x + rng.standard_normal(n * n))
    units = spark.createDataFrame(pd.DataFrame({"unit_id": np.arange(n * n), "y": y, "x1": x})).cache()
    return w, y, x, units, weights.lattice(spark, n).cache()


def test_lattice_is_the_dense_rook(spark, world):
    w, *_, units, edges = world
    assert np.allclose(logdet.dense(edges, logdet.index_of(units)), w)
    weights.check(edges, units)


def test_lag_is_the_matrix_product(world):
    w, y, _, units, edges = world
    out = lags.spatial_lag(units, edges, ["y"]).orderBy("unit_id").toPandas()
    assert np.allclose(out["W_y"], w @ y)


def test_nearest_neighbours_are_brute_force(spark):
    rng = np.random.default_rng(2)
    p = np.r_[rng.random((60, 2)), 50 + rng.random((5, 2))]
    pts = spark.createDataFrame(pd.DataFrame({"unit_id": range(65), "px": p[:, 0], "py": p[:, 1]}))
    got = {(r["focal"], r["neighbor"]) for r in weights.k_nearest(pts, 4).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) + np.eye(65) * 1e9
    assert got == {(i, j) for i in range(65) for j in np.argsort(d[i], kind="stable")[:4]}


def test_determinants_agree(spark, world):
    w, *_, units, edges = world
    eig = logdet.log_det(units, edges, -0.95, 0.95)
    series = logdet.log_det(units, edges, -0.95, 0.95, method="chebyshev")
    exact = np.linalg.slogdet(np.eye(len(w)) - 0.6 * w)[1]
    assert abs(eig(0.6) - exact) < 1e-9 and abs(series(0.6) - exact) < 1e-5
    assert abs(eig.slope(0.6) - series.slope(0.6)) < 1e-3


def test_lm_tests_equal_closed_forms(world):
    w, y, x, units, edges = world
    z = np.c_[np.ones(len(y)), x]
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ b
    s2, m = e @ e / len(y), np.eye(len(y)) - z @ np.linalg.pinv(z)
    t = np.trace(w.T @ w + w @ w)
    f = w @ z @ b
    d, gl, ge = f @ m @ f / s2, e @ w @ y / s2, e @ w @ e / s2
    found = {r["test"]: r["statistic"] for r in lm.battery(units, edges, "y", ["x1"]).collect()}
    assert np.isclose(found["LM-Lag"], gl**2 / (t + d)) and np.isclose(found["LM-Error"], ge**2 / t)
    assert np.isclose(found["Robust-LM-Lag"], (gl - ge) ** 2 / d)
    assert np.isclose(found["LM-SDM-Joint"], found["LM-Lag"] + found["Robust-LM-WX"])
    assert lm.decide(lm.battery(units, edges, "y", ["x1"])).first()["model"] in ("SAR", "SDM")


def test_sar_chains_find_the_grid_posterior(world):
    *_, units, edges = world
    fit = gaussian.fit("SAR", units, edges, "y", ["x1"], draws=800, tune=300, n_chains=2, seed=3)
    again = gaussian.fit("SAR", units, edges, "y", ["x1"], draws=800, tune=300, n_chains=2, seed=3)
    a, b = (f.draws.orderBy("chain", "draw").toPandas() for f in (fit, again))
    assert a.equals(b)
    k = fit.kernel
    grid = np.linspace(-0.9, 0.95, 400)
    s2 = float((a["sigma"] ** 2).mean())
    p = np.array([k.log_density(r, s2) for r in grid])
    p = np.exp(p - p.max())
    assert abs((grid * p).sum() / p.sum() - a["rho"].mean()) < 0.03
    row = fit.impacts().first()
    assert row["direct_mean"] + row["indirect_mean"] == pytest.approx(row["total_mean"])
    ols = gaussian.fit("OLS", units, edges, "y", ["x1"], draws=50, tune=50, n_chains=1)
    assert gaussian.bayes_factor(fit, ols) > 3


def test_reduced_probit_keeps_zero_one(world):
    *_, units, edges = world
    with pytest.raises(ValueError):
        rowwise.fit("SARProbit", units, edges, "y", ["x1"])


def test_designs_that_do_not_exist_raise():
    with pytest.raises(ValueError):
        validate(SPECS["SLX"], "random", None, True)
    with pytest.raises(ValueError):
        validate(SPECS["SAR"], "unit", "unrestricted", True)
    with pytest.raises(ValueError):
        Priors.of({"rho": 1})


def test_special_functions():
    rng = np.random.default_rng(0)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.gammaln(np.array([0.5, 5.0])) == pytest.approx([0.5723649429247001, 3.1780538303479458])
    for b, z in ((1.0, 0.0), (2.5, 1.5), (20.3, -2.0)):
        x = special.polya_gamma(np.full(20_000, b), np.full(20_000, z), rng)
        assert x.mean() == pytest.approx(float(special.pg_mean(b, z)), rel=0.02)
    y = np.arange(400)
    assert np.exp(special.negbin_logpmf(y, np.log(3.0), 2.0)).sum() == pytest.approx(1)


def test_two_part_kernels_recover_parts():
    from lagweave.models.two_part import TwoPartKernel

    rng = np.random.default_rng(1)
    n = 600
    x = rng.standard_normal(n)
    design = np.c_[np.ones(n), x]
    eta, on = 0.8 + 0.6 * x, rng.random(n) < 1 / (1 + np.exp(-(0.5 - x)))
    counts = rng.poisson(np.exp(eta) * rng.gamma(2, 0.5, n))
    while (zero := counts == 0).any():
        counts = np.where(zero, rng.poisson(np.exp(eta) * rng.gamma(2, 0.5, n)), counts)
    found = TwoPartKernel("hurdle", (on * counts).astype(float), design, design, None, Priors()).run(150, 100, 0).mean(0)
    assert np.allclose(found[3:], [0.8, 0.6, 0.5, -1.0], atol=0.35)


def test_random_effects_density_equals_the_dense_one():
    from lagweave.models.random_effects import RandomKernel

    rng = np.random.default_rng(2)
    units, periods = 6, 4
    w = np.kron(np.eye(periods), np.roll(np.eye(units), 1, 1) / 2 + np.roll(np.eye(units), -1, 1) / 2)
    x = np.c_[np.ones(units * periods), rng.standard_normal(units * periods)]
    y = rng.standard_normal(units * periods)
    z = np.c_[y, w @ y, x]
    means = z.reshape(periods, units, -1).mean(0)
    total, between = z.T @ z, periods * means.T @ means
    values = np.linalg.eigvals(w[:units, :units])
    jacobian = lambda r: np.log(np.abs(1 - r * values)).sum()
    k = RandomKernel("lag", ["a", "b"], total - between, between, units, periods, np.zeros(2), np.ones(2), 2.0, 1.0, -1.0, 1.0, jacobian, 2.0)

    def dense(r, s, a):
        s2, a2 = np.exp(s), np.exp(2 * a)
        d = np.tile(np.eye(units), (periods, 1))
        cov = s2 * np.eye(len(y)) + a2 * d @ d.T + x @ x.T
        e = y - r * w @ y
        like = periods * jacobian(r) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * e @ np.linalg.solve(cov, e)
        return like - 2 * s - 1 / s2 + a - np.log1p(a2 / 4)

    points = [(0.1, 0.2, -0.5), (0.4, -0.3, 0.3), (-0.2, 0.5, -1.0)]
    gaps = [k.log_density(*p) - dense(*p) for p in points]
    assert np.ptp(gaps) < 1e-8
