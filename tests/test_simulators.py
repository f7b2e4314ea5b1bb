"""Simulated tables against the equations they are drawn from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.dgp import catalog, designs, flows, simulate
from lagweave.models import logdet
from lagweave.operators import weights


@pytest.fixture(scope="module")
def world(spark):
    edges = weights.lattice(spark, 5).cache()
    units = spark.range(25).withColumnRenamed("id", "unit_id")
    return units, edges, logdet.dense(edges, logdet.index_of(units))


def column(df, c, *by):
    return df.orderBy(*by).toPandas()[c].to_numpy()


def test_draws_have_their_distributions(spark):
    ids = spark.range(40_000)
    g = ids.select(F.exp(designs.log_gamma(3, "a", 2.0, "id")).alias("g"), F.exp(designs.log_gamma(3, "b", 0.5, "id")).alias("h"), designs.logistic(3, "l", "id").alias("l")).toPandas()
    assert abs(g["g"].mean() - 1) < 0.02 and abs(g["g"].var() - 0.5) < 0.03 and abs(g["h"].mean() - 1) < 0.04 and abs(g["h"].var() - 2) < 0.2
    assert abs(g["l"].var() - np.pi**2 / 3) < 0.1
    q = (np.arange(100_000) + 0.5) / 100_000
    for mu in (0.3, 4.0, 2000.0):
        y = designs.poisson_at(q, np.full(len(q), mu))
        assert abs(y.mean() / mu - 1) < 0.01 and abs(y.var() / mu - 1) < 0.02
        up = designs.poisson_at(q, np.full(len(q), mu), positive=True)
        assert up.min() >= 1 and abs(up.mean() * -np.expm1(-mu) / mu - 1) < 0.01
    y = designs.negbin_at(q, np.full(len(q), np.log(3.0)), 2.0)
    assert abs(y.mean() - 3) < 0.02 and abs(y.var() - 7.5) < 0.1
    assert designs.negbin_at(q, np.full(len(q), np.log(0.2)), 2.0, positive=True).min() == 1


def test_gaussian_panels_solve_their_equations(spark, world):
    units, edges, w = world
    out = catalog.simulated("SDM", units, edges, periods=3, effects="two_way", seed=4, err_hetero=True)
    rows = out.orderBy("time", "unit_id").toPandas()
    assert len(rows) == 75 and list(rows.columns) == ["unit_id", "time", "x1", "y"]
    noise = out.select("unit_id", "time", (simulate.normal(4, "noise", "unit_id", "time") * F.sqrt(2 + F.col("x1") ** 2) + 0.5 * simulate.normal(4, "unit", "unit_id") + F.when(F.col("time") == 0, 0.0).otherwise(0.5 * simulate.normal(4, "period", "time"))).alias("e"))
    e = column(noise, "e", "time", "unit_id").reshape(3, 25)
    y, x = rows["y"].to_numpy().reshape(3, 25), rows["x1"].to_numpy().reshape(3, 25)
    assert np.allclose(y - 0.4 * y @ w.T, 1 + 2 * x + 0.5 * x @ w.T + e, atol=1e-6)


def test_dynamic_panels_follow_their_recursion(spark, world):
    units, edges, w = world
    for how, theta in (({"restricted": True}, -0.12), ({"theta_lag": 0.2}, 0.2)):
        out = designs.dynamic_panel(units, edges, 3, rho=0.3, phi=0.4, seed=2, **how)
        rows = out.orderBy("time", "unit_id").toPandas()
        e = column(out.select("unit_id", "time", simulate.normal(2, "noise", "unit_id", "time").alias("e")), "e", "time", "unit_id").reshape(3, 25)
        y, x = rows["y"].to_numpy().reshape(3, 25), rows["x1"].to_numpy().reshape(3, 25)
        assert np.allclose(y[1:] - 0.3 * y[1:] @ w.T, 0.4 * y[:-1] + theta * y[:-1] @ w.T + 1 + 2 * x[1:] + e[1:], atol=1e-6)


def test_latent_outcomes_and_two_parts(spark, world):
    units, edges, w = world
    out = catalog.simulated("SDEMLogit", units, edges, seed=1)
    rows = out.select("*", designs.logistic(1, "noise", "unit_id").alias("e")).orderBy("unit_id").toPandas()
    u = rows["eta"] - 0.3 - rows["x1"] - 0.5 * (w @ rows["x1"])
    assert np.allclose(u - 0.35 * w @ u, rows["e"], atol=1e-6) and ((rows["eta"] > 0) == (rows["y"] == 1)).all()
    for kind in ("zinb", "hurdle"):
        for latent in (False, True):
            rows = designs.two_part(units, edges, kind, latent=latent, seed=3, target_pi=0.6).toPandas()
            assert (rows.loc[rows["active"] == 0, "y"] == 0).all()
            if kind == "hurdle":
                assert (rows.loc[rows["active"] == 1, "y"] >= 1).all()
            if latent:
                assert abs(rows["active"].mean() - 0.6) <= 0.05
            else:
                assert abs((1 / (1 + np.exp(-rows["u"]))).mean() - 0.6) < 1e-3
    assert catalog.simulated("SEMProbit", units, edges, effects="random", obs_per_unit=3).count() == 75


def test_series_agree_with_solves(spark, world):
    units, edges, w = world
    table = units.withColumn("v", simulate.normal(1, "v", "unit_id"))
    for most in (1000, 5):
        out = simulate.filtered(table, edges, "v", 0.3, dense_most=most, tolerance=1e-6)
        assert np.allclose(column(out, "v", "unit_id"), np.linalg.solve(np.eye(25) - 0.3 * w, column(table, "v", "unit_id")), atol=1e-5)


@pytest.mark.parametrize("rw,processes", [(None, ("lag", "error")), (0.02, ("lag",))])
def test_flows_solve_their_filter(spark, world, rw, processes):
    units, edges, w = world
    for process in processes:
        out = flows.flows(units, edges, process, rho_d=0.1, rho_o=0.05, rho_w=rw, seed=6)
        rows = out.select("*", simulate.normal(6, "noise", "origin", "dest").alias("e")).orderBy("origin", "dest").toPandas()
        r = -0.005 if rw is None else rw
        mean = -0.5 * rows["log_distance"] + rows["d1"] + 0.5 * rows["d2"] + 0.5 * rows["o1"] + 0.3 * rows["o2"]
        grid = lambda v: np.asarray(v).reshape(25, 25)
        y, m, e = grid(rows["y"]), grid(mean), grid(rows["e"])
        apply = lambda v: v - 0.1 * v @ w.T - 0.05 * w @ v - r * w @ v @ w.T
        assert np.allclose(apply(y), m + e if process == "lag" else apply(m) + e, atol=1e-5)


def test_flow_counts(spark, world):
    units, edges, _ = world
    rows = flows.poisson_flows(units, edges, rho_w=None, seed=2).toPandas()
    assert abs(np.exp(rows["eta"]).mean() - 8) < 1e-6 and abs(rows["y"].mean() - 8) < 1
    for kind in ("zinb", "hurdle"):
        rows = flows.two_part_flows(units, edges, kind, seed=2, target_pi=0.5).toPandas()
        assert (rows.loc[rows["active"] == 0, "y"] == 0).all() and abs((1 / (1 + np.exp(-rows["u"]))).mean() - 0.5) < 1e-3
    with pytest.warns(UserWarning):
        assert not flows.stable(0.5, 0.4, 0.3)


def test_levels_nest(spark):
    levels = designs.multilevel(spark, 8, (2, 2), seed=1)
    sizes = [t.count() for t, _ in levels]
    assert sizes == [64, 16, 4]
    table, edges = levels[0]
    w = logdet.dense(edges, logdet.index_of(table))
    rows = table.join(levels[1][0].selectExpr("unit_id AS p", "y AS above"), F.col("parent") == F.col("p")).select("*", simulate.normal(1, "noise", "unit_id").alias("e")).orderBy("unit_id").toPandas()
    assert np.allclose(rows["y"] - 0.4 * w @ rows["y"], 1 + rows["z1"] - rows["z2"] + rows["above"] + rows["e"], atol=1e-6)


@pytest.mark.parametrize("model", ["SARTobit", "SARLogit", "Probit", "SARNegBin", "SEMNegBin", "ZINB", "SARHurdleNegBin", "OLSFlow"])
def test_every_family_has_a_table(spark, world, model):
    units, edges, _ = world
    assert catalog.simulated(model, units, edges, seed=5).count() == (625 if "Flow" in model else 25)


def test_designs_that_models_lack_raise(world):
    units, edges, _ = world
    for model, how in (("SARLogit", {"periods": 3}), ("SARTobit", {"periods": 3, "effects": "unit"}), ("SEMNegBin", {"periods": 2}), ("SARNegBin", {"dynamic": "unrestricted"}), ("Nothing", {})):
        with pytest.raises(ValueError):
            catalog.simulated(model, units, edges, **how)
