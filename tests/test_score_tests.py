"""Score tests against dense algebra, and the checks that fits make of their input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagweave.diagnostics import score_tests
from lagweave.models import gaussian, logdet, priors, rowwise, two_part
from lagweave.models.spec import Priors
from lagweave.operators import lags, traces, weights


@pytest.fixture(scope="module")
def world(spark):
    n, rng = 6, np.random.default_rng(3)
    edges = weights.lattice(spark, n).cache()
    ids = spark.range(n * n).withColumnRenamed("id", "unit_id")
    w = logdet.dense(edges, logdet.index_of(ids))
    x = rng.standard_normal(n * n)
    y = np.linalg.solve(np.eye(n * n) - 0.4 * w, 1 + 2 * x + rng.standard_normal(n * n))
    return w, y, x, spark.createDataFrame(pd.DataFrame({"unit_id": np.arange(n * n), "y": y, "x1": x})).cache(), edges


def dense_test(w, y, x, fit, tested, robust):
    """The test at the posterior mean, from n x n matrices."""
    d = fit.draws.toPandas()
    n = len(y)
    z = np.column_stack([np.ones(n), x, w @ x])
    b = np.array([d[c].mean() if c in d else 0.0 for c in ("_one", "x1", "W_x1")])
    r, lam, v = (d["rho"].mean() if "rho" in d else 0.0), (d["lam"].mean() if "lam" in d else 0.0), (d["sigma"] ** 2).mean()
    eye = np.eye(n)
    u = y - r * w @ y - z @ b
    bm = eye - lam * w
    e = bm @ u
    ga, gb = (np.linalg.solve(eye - k * w, w) for k in (r, lam))
    score = np.r_[(bm @ z).T @ e / v, -np.trace(ga) + (bm @ w @ y) @ e / v, -np.trace(gb) + (w @ u) @ e / v, -n / (2 * v) + e @ e / (2 * v**2)]
    m = bm @ w @ np.linalg.solve(eye - r * w, z @ b)
    cols = np.column_stack([bm @ z, m])
    info = np.zeros((6, 6))
    info[:4, :4] = cols.T @ cols / v
    mixed = ga if r else gb
    info[3, 3] += np.trace(ga.T @ ga + ga @ ga)
    info[3, 4] = info[4, 3] = np.trace(w.T @ mixed + w @ mixed)
    info[4, 4] = np.trace(gb.T @ gb + gb @ gb)
    info[3, 5] = info[5, 3] = np.trace(ga) / v
    info[4, 5] = info[5, 4] = np.trace(gb) / v
    info[5, 5] = n / (2 * v**2)
    place = {"theta": [2], "rho": [3], "lam": [4]}
    free = [0, 1, 5] + ([2] if "W_x1" in d else []) + ([3] if "rho" in d else []) + ([4] if "lam" in d else [])
    t, rob = [i for k in tested for i in place[k]], [i for k in robust for i in place[k] if i not in free]
    for off in (free, rob):
        if off:
            by = np.linalg.solve(info[np.ix_(off, off)], info[off])
            score, info = score - by.T @ score[off], info - info[:, off] @ by
    return float(score[t] @ np.linalg.solve(info[np.ix_(t, t)], score[t]))


@pytest.mark.parametrize("model", ["OLS", "SAR", "SEM", "SDEM"])
def test_score_tests_equal_dense_ones(world, model):
    w, y, x, units, edges = world
    fit = gaussian.fit(model, units, edges, "y", ["x1"], draws=150, tune=80, n_chains=1)
    found = {r["test"]: r["statistic"] for r in score_tests.tests(fit).collect()}
    assert set(found) == set(score_tests.suite(model))
    for label, (tested, robust) in score_tests.suite(model).items():
        assert np.isclose(found[label], dense_test(w, y, x, fit, tested, robust), rtol=1e-4, atol=1e-7), label


def test_panel_tests_have_their_labels(spark, world):
    *_, edges = world
    rng = np.random.default_rng(1)
    panel = spark.createDataFrame(pd.DataFrame({"unit_id": np.tile(np.arange(36), 3), "t": np.repeat([1, 2, 3], 36), "y": rng.standard_normal(108), "x1": rng.standard_normal(108)}))
    for effects in ("pooled", "unit", "two_way"):
        fit = gaussian.fit("OLS", panel, edges, "y", ["x1"], time="t", effects=effects, draws=60, tune=30, n_chains=1)
        out = score_tests.tests(fit).toPandas()
        assert out["test"].str.startswith("Panel-").all() and out["statistic"].ge(0).all() and out["error"].isna().all()


def test_link_tests_split_the_lag_score(world):
    w, y, x, units, edges = world
    binary = units.selectExpr("unit_id", "x1", "CAST(y > 1 AS DOUBLE) AS y")
    for model in ("Logit", "Probit"):
        found = {r["test"]: r["statistic"] for r in score_tests.glm_tests(rowwise.fit(model, binary, edges, "y", ["x1"], draws=60, tune=30, n_chains=1)).collect()}
        assert set(found) == set(score_tests.GLM_TESTS)
        assert np.isclose(found["LM-SARMA"], found["Robust-LM-Lag"] + found["LM-Error"])
        assert np.isclose(found["LM-WX"], found["Robust-LM-Lag"], rtol=1e-6)  # one covariate: its lag is the spillover


def test_count_moments_are_sums_over_counts():
    eta, size = np.array([-1.0, 0.5, 2.5]), 1.7
    rng = np.random.default_rng(0)
    draws = rng.poisson(rng.gamma(size, np.exp(eta) / size, (400_000, 3)))
    _, h = score_units = score_tests.score_units("negbin", draws.astype(float), eta, size)
    omega, tau, kappa = score_tests.information_units("negbin", eta, size)
    assert np.allclose(h.var(0), tau, rtol=0.03) and np.allclose((score_units[0] * h).mean(0), kappa, rtol=0.03) and np.allclose(score_units[0].var(0), omega, rtol=0.03)


def test_trees_reach_their_leaves():
    t = score_tests.tree("OLS")
    assert score_tests.walk(t, {"LM-Lag": 0.5, "LM-Error": 0.5, "LM-WX": 0.5})[0] == "OLS"
    assert score_tests.walk(t, {"LM-Lag": 0.01, "LM-Error": 0.01, "Robust-LM-Lag": 0.2, "Robust-LM-Error": 0.3})[0] == "SAR"
    assert score_tests.walk(score_tests.tree("SLX", panel=True), {"Panel-LM-Lag": 0.5, "Panel-LM-Error": 0.001})[0] == "SDEM"
    assert score_tests.walk(score_tests.tree("SARTobit"), {"LM-WX": 0.01, "LM-Error": 0.5})[0] == "SDMTobit"
    assert score_tests.walk(score_tests.tree("Logit"), {"Robust-LM-Lag": 0.01, "LM-Error": 0.5})[0] == "SARLogit(latent=False)"
    assert score_tests.tree("Multilevel") == "Multilevel"
    assert "LM-Lag?" in score_tests.as_text(t) and score_tests.as_dot(t).startswith("digraph")


def test_probed_traces_are_near_the_dense_ones(spark, world):
    w, *_, units, edges = world
    for centred in (True,):
        exact = traces.of_matrix(w, 0.4, centred)
        near = traces._probed(units.select("unit_id"), edges, 0.4, "unit_id", centred, 16, 1)
        assert all(abs(near[k] - exact[k]) < 6 for k in exact)


@pytest.mark.parametrize("change,message", [("CASE WHEN unit_id = 3 THEN NULL ELSE y END", "null"), ("CASE WHEN unit_id = 3 THEN double('nan') ELSE y END", "null")])
def test_bad_values_raise(world, change, message):
    *_, units, edges = world
    bad = units.selectExpr("unit_id", "x1", f"{change} AS y")
    with pytest.raises(ValueError, match=message):
        gaussian.fit("SAR", bad, edges, "y", ["x1"])


def test_bad_edges_and_panels_raise(spark, world):
    *_, units, edges = world
    with pytest.raises(ValueError, match="not among the units"):
        gaussian.fit("SAR", units, edges.union(spark.createDataFrame([(99, 0, 0.5)], edges.schema)), "y", ["x1"])
    with pytest.raises(ValueError, match="rows with equal"):
        gaussian.fit("OLS", units.union(units.limit(1)), edges, "y", ["x1"])
    panel = units.crossJoin(spark.range(3).withColumnRenamed("id", "t")).filter("NOT (unit_id = 2 AND t = 1)")
    with pytest.raises(ValueError, match="not balanced"):
        gaussian.fit("OLS", panel, edges, "y", ["x1"], time="t", effects="two_way")


def test_a_missing_period_gives_no_lag(spark):
    panel = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 4.0), (2, 3, 6.0)], "unit long, time long, y double")
    assert {(r["unit"], r["time"]): r["L_y"] for r in lags.time_lag(panel, ["y"]).collect()} == {(1, 2): 1.0, (1, 3): 2.0}


def test_default_priors_are_the_pinned_ones(world):
    w, y, x, units, edges = world
    k = gaussian.fit("SDM", units, edges, "y", ["x1"], draws=5, tune=5, n_chains=1).kernel
    assert np.allclose(k.mean, [y.mean(), 0, 0]) and np.allclose(1 / np.sqrt(k.precision), 2.5 * y.std() / np.array([1, x.std(), (w @ x).std()]))
    assert k.shape == 2.0 and np.isclose(k.scale, y.var()) and (k.low, k.high) == (-1.0, 1.0)
    assert Priors.of(None, "SARNegBin").alpha_scale == 2.5 and Priors.of(None, "SARLogit").low == -0.999
    assert priors.settings("SDM", panel=True, dynamic="unrestricted").__name__ == "PanelSDMUDynamicPriors"
    assert Priors.of({"rho_lower": 0.0}, "SAR").low == 0.0
    with pytest.raises(TypeError, match="has no rho_lo"):
        priors.resolve({"rho_lo": 0.0}, priors.settings("SAR"))
    with pytest.raises(ValueError, match="unknown priors"):
        Priors.of({"lam_lower": 0.0}, "SAR")
    mean, sd = priors.data_scaled(0.25, 0.4, 100, np.array([0.0, 2.0]), np.array([True, False]), "logit")
    assert np.allclose(mean, [np.log(1 / 3), 0]) and np.allclose(sd, [2.5, 1.25])


def test_two_part_results(spark, world):
    w, y, x, units, edges = world
    counted = units.selectExpr("unit_id", "x1", "CAST(floor(exp(y / 2)) AS DOUBLE) AS y")
    zinb = two_part.fit("SARZINB", counted, edges, "y", ["x1"], draws=30, tune=20, n_chains=1)
    assert {r["variable"] for r in zinb.impacts().collect()} == {r["variable"] for r in zinb.impacts("zero").collect()} == {"x1"}
    share = zinb.zero_attribution().toPandas()
    assert share["probability"].between(0, 1).all() and len(share) == 36
    hurdle = two_part.fit("HurdleNegBin", counted, None, "y", ["x1"], draws=30, tune=20, n_chains=1)
    assert hurdle.positive_mean().toPandas()["mean"].ge(1).all()
    assert hurdle.posterior_predictive(5).count() >= 5 * 36 and hurdle.activation_probabilities().count() == 36
    with pytest.raises(ValueError):
        zinb.positive_mean()


def test_lag_nulls_of_link_models(world):
    w, y, x, units, edges = world
    binary = units.selectExpr("unit_id", "x1", "CAST(y > 1 AS DOUBLE) AS y")
    fit = rowwise.fit("SARLogit", binary, edges, "y", ["x1"], draws=30, tune=20, n_chains=1)
    found = score_tests.glm_tests(fit).toPandas()
    assert list(found["test"]) == ["LM-Error", "LM-WX"] and found["statistic"].ge(0).all() and found["error"].isna().all()


def test_flow_tests_of_panels(spark):
    from lagweave.dgp import flows as dgp
    from lagweave.models import flows

    units, edges = spark.range(8).withColumnRenamed("id", "unit_id"), weights.ring(spark, 8)
    panel = dgp.flows(units, edges, rho_d=0.4, rho_o=0.0, rho_w=None, periods=3, seed=1).withColumn("one", F.lit(1.0)).cache()
    terms = ["one", "d1", "d2", "o1", "o2", "log_distance"]
    found = flows.lm_tests(panel, edges, units, terms, time="time").toPandas().set_index("test")["p_value"]
    assert found["Panel-LM-Flow-Joint"] < 0.01 and found["Panel-LM-Flow-Destination"] < found["Panel-LM-Flow-Origin"]
    assert score_tests.walk(score_tests.tree("OLSFlow", panel=True), dict(found))[0] == "SARFlow"
    with pytest.raises(ValueError, match="every pair"):
        flows.lm_tests(panel, edges, units, terms)


def test_stored_chains_are_not_run_again(spark, world, tmp_path):
    *_, units, edges = world
    kernel = gaussian.fit("OLS", units, edges, "y", ["x1"], draws=5, tune=5, n_chains=1).kernel
    names, path = ["_spatial", "sigma", "_one", "x1"], str(tmp_path / "draws")
    first = gaussian.stored_chains(spark, kernel, names, 10, 5, 2, 3, path).orderBy("chain", "draw").toPandas()
    files = len(list((tmp_path / "draws").glob("*.parquet")))
    again = gaussian.stored_chains(spark, kernel, names, 10, 5, 3, 3, path).orderBy("chain", "draw").toPandas()
    assert len(first) == 20 and len(again) == 30 and len(list((tmp_path / "draws").glob("*.parquet"))) == files + 1
    assert np.allclose(again[again["chain"] < 2].reset_index(drop=True)[names], first[names])
    plain = gaussian.chains(spark, kernel, names, 10, 5, 2, 3).orderBy("chain", "draw").toPandas()
    assert np.allclose(plain[names], first[names])
