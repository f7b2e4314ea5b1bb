"""Queries of the spatial operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dgp import catalog, simulate
from ..dgp import flows as flow_dgp
from ..diagnostics import cv, lm, mcmc, posterior, score_tests
from ..models import flow_counts, flows, gaussian, latent, logdet, multilevel, priors, random_effects, rowwise, solves, two_part
from ..operators import gram as g
from ..operators import lags, traces, weights
from ..sources import tables
from .spatial_sql import SQL


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _edges(make):
    return lambda spark, d: rounded(make(spark, d).select("focal", "neighbor", "w"), ["w"])


def _points(spark, d):
    return tables.nation_units(spark, d).withColumns({"px": F.col("x1"), "py": F.col("y") / 100})


def region(spark, d):
    return weights.same_group(tables.nation_units(spark, d), "region")


def grid(spark, d=None):
    return weights.lattice(spark, 5)


def knn(spark, d):
    return weights.k_nearest(_points(spark, d), 3)


def band(spark, d):
    return weights.distance_band(_points(spark, d), 4.0)


def _lagged(graph, columns, out, **how):
    return lambda spark, d: rounded(lags.spatial_lag(tables.nation_units(spark, d), graph(spark, d), columns, **how).select("unit_id", *out), out)


def lag_y(spark, d):
    return rounded(lags.spatial_lag(tables.nation_units(spark, d), weights.ring(spark, 25), ["y"]).select("unit_id", "y", "W_y"), ["y", "W_y"])


def lag_twice(spark, d):
    once = lags.spatial_lag(tables.nation_units(spark, d), grid(spark), ["y"])
    return rounded(lags.spatial_lag(once, grid(spark), ["W_y"]).select("unit_id", "W_y", "W_W_y"), ["W_y", "W_W_y"])


def lag_panel(spark, d):
    return rounded(lags.panel_lag(tables.nation_years(spark, d), grid(spark), ["y"]).select("unit", "time", "W_y"), ["W_y"])


def lag_panel_time_demeaned(spark, d):
    lagged = lags.panel_lag(tables.nation_years(spark, d), grid(spark), ["y"])
    return rounded(lags.within(lagged, ["W_y"], "time").select("unit", "time", "D_W_y"), ["D_W_y"])


def _dense(spark, d):
    return tables.dense_flows(tables.nation_flows(spark, d), tables.nation_units(spark, d))


def flow_lags(spark, d):
    out = ["Wd_y", "Wo_y", "Ww_y"]
    return rounded(lags.flow_lags(_dense(spark, d), grid(spark)).select("origin", "dest", *out), out)


def flow_design(spark, d):
    units = tables.nation_units(spark, d)
    ids = units.select(F.col("unit_id").alias("origin"))
    far = ids.crossJoin(ids.withColumnRenamed("origin", "dest")).withColumn("distance", F.abs(F.col("origin") - F.col("dest")).cast("double"))
    return rounded(lags.flow_design(units, ["x1"], distances=far), ["dest_x1", "orig_x1", "intra_x1", "log_distance"])


def flow_design_asymmetric(spark, d):
    out = lags.flow_design(tables.nation_units(spark, d), ["x1", "x2"], ["x1"])
    return rounded(out, [c for c in out.columns if c[:5] in ("dest_", "orig_", "intra")  and c != "intra_indicator"])


def _within(effects):
    return lambda spark, d: rounded(lags.within(tables.nation_years(spark, d), ["y", "x1"], effects).select("unit", "time", "D_y", "D_x1"), ["D_y", "D_x1"])


def absorbed_columns(spark, d):
    panel = tables.nation_years(spark, d).withColumn("size", F.col("unit") * 2.0)
    return lags.absorbed(panel, ["x1", "size"], "unit")


def mundlak_means(spark, d):
    return rounded(lags.mundlak(tables.nation_years(spark, d), ["x1"]).select("unit", "time", "mean_x1"), ["mean_x1"])


def dynamic_lag(spark, d):
    return rounded(lags.time_lag(tables.nation_years(spark, d), ["y"]).select("unit", "time", "y", "L_y"), ["y", "L_y"])


def panel_pivot_wide(spark, d):
    periods = list(range(1995, 2002))
    return rounded(lags.wide(tables.nation_years(spark, d), "y", periods), [f"y_{t}" for t in periods])


def gram(spark, d):
    units = tables.nation_units(spark, d).withColumn("one", F.lit(1.0))
    return rounded(g.gram(units, ["one", "x1", "y"]), ["value"], 4)


def ols_beta(spark, d):
    b = g.ols(g.Gram.of(tables.nation_units(spark, d), ["y", "x1"]), "y", ["_one", "x1"])[0]
    return rounded(spark.createDataFrame([tuple(float(v) for v in b)], "intercept double, x1 double"), ["intercept", "x1"], 4)


def ols_sigma2(spark, d):
    s = g.ols(g.Gram.of(tables.nation_units(spark, d), ["y", "x1"]), "y", ["_one", "x1"])[2]
    return rounded(spark.createDataFrame([(float(s),)], "sigma2 double"), ["sigma2"], 3)


def moran_i(spark, d):
    units = tables.nation_units(spark, d)
    centred = units.crossJoin(F.broadcast(units.agg(F.avg("y").alias("m")))).select("unit_id", (F.col("y") - F.col("m")).alias("z"))
    lagged = lags.spatial_lag(centred, grid(spark), ["z"])
    return rounded(lagged.agg((F.sum(F.col("z") * F.col("W_z")) / F.sum(F.col("z") * F.col("z"))).alias("moran_i")), ["moran_i"])


def lm_battery(spark, d):
    tests = lm.battery(tables.nation_units(spark, d), grid(spark), "y", ["x1"])
    return rounded(tests.select("test", "statistic", "df"), ["statistic"])


def lm_decision(spark, d):
    return score_tests.decide(lm.battery(tables.nation_units(spark, d), grid(spark), "y", ["x1"]), "OLS").select("model")


EFFECTS = [f"{a}_{b}" for a in ("direct", "indirect", "total") for b in ("mean", "ci_lower", "ci_upper", "pvalue")]


def impacts_slx(spark, d):
    b = F.col("beta1")
    return rounded(posterior.effects(tables.demo_draws(spark), {"x1": (b, b + F.col("theta1"))}), EFFECTS)


def impacts_sem(spark, d):
    return rounded(posterior.effects(tables.demo_draws(spark), {"x1": (F.col("beta1"), F.col("beta1"))}), EFFECTS)


def ci_percentiles(spark, d):
    return rounded(tables.demo_draws(spark).agg(posterior.interval("rho").alias("i")).select(F.col("i")[0].alias("lower"), F.col("i")[1].alias("upper")), ["lower", "upper"])


def bayes_pvalue(spark, d):
    return rounded(tables.demo_draws(spark).agg(posterior.pvalue(F.col("beta1")).alias("pvalue")), ["pvalue"])


def draw_thinning(spark, d):
    return rounded(posterior.thinned(tables.demo_draws(spark), 5).select("chain", "draw", "rho"), ["rho"])


def posterior_summary(spark, d):
    long = posterior.long_draws(tables.demo_draws(spark), ["rho", "beta0", "beta1", "theta1", "sigma"])
    return rounded(posterior.summary(long), ["mean", "sd", "lower", "upper"])


def activation_probability(spark, d):
    units = tables.nation_units(spark, d).withColumn("x1", F.col("x1") / 100)
    draws = tables.demo_draws(spark).withColumnsRenamed({"beta0": "zero:_one", "beta1": "zero:x1"})
    return rounded(two_part.activation_of(draws, units, ["x1"]), ["probability"])


def predict_in_sample(spark, d):
    out = posterior.predict_in_sample(tables.nation_units(spark, d), knn(spark, d), "y", 4000.0 + 10.0 * F.col("x1"), 0.4)
    return rounded(out, ["y_bp"], 4)


def _flow_weights(kind):
    return lambda spark, d: rounded(lags.flow_weights(weights.ring(spark, 25), tables.nation_units(spark, d), kind), ["w"])


def impacts_isolates(spark, d):
    units, graph = tables.nation_units(spark, d), band(spark, d)
    alone = weights.isolates(graph, units).count()
    total = posterior.lag_totals(F.col("rho"), units.count(), alone) * F.col("beta1")
    return rounded(tables.demo_draws(spark).agg(F.avg(total).alias("total_mean")), ["total_mean"])


def _pointwise(spark, d):
    units = tables.nation_units(spark, d).select("unit_id", (F.col("y") / 1000).alias("y"))
    e = (F.col("y") - F.col("beta0") - 3) / F.col("sigma")
    return units.crossJoin(F.broadcast(tables.demo_draws(spark))).select("unit_id", "chain", "draw", (-0.5 * e * e - F.log("sigma")).alias("ll"))


def pointwise_lpd(spark, d):
    return rounded(posterior.log_mean_exp(_pointwise(spark, d), ["unit_id"], "ll"), ["lpd"])


def bic_of_draws(spark, d):
    joint = _pointwise(spark, d).groupBy("chain", "draw").agg(F.sum("ll").alias("ll"))
    return rounded(posterior.bic(joint, "ll", 2, 25), ["bic"], 4)


def scalar_functions(spark, d):
    k = F.col("id") / 10.0
    return rounded(spark.range(-40, 41).select("id", posterior.negbin_zero(k, F.lit(2.0)).alias("p0"), posterior.pg_weight(F.lit(3.0), k).alias("pg"), (1 / (1 + F.exp(-k))).alias("logistic"), F.log1p(F.abs(k)).alias("log1p")), ["p0", "pg", "logistic", "log1p"])


def _fit(model, **how):
    """The posterior summary of a model of the nations over the grid."""

    def run(spark, d):
        return gaussian.fit(model, tables.nation_units(spark, d), grid(spark), "y", ["x1"], draws=200, tune=100, n_chains=2, seed=1, **how).summary()

    return run


def _panel_fit(model, effects):
    def run(spark, d):
        return gaussian.fit(model, tables.nation_years(spark, d), grid(spark), "y", ["x1"], key="unit", time="time", effects=effects, draws=200, tune=100, n_chains=2, seed=1).summary()

    return run


def fit_impacts_sdm(spark, d):
    return gaussian.fit("SDM", tables.nation_units(spark, d), grid(spark), "y", ["x1"], draws=200, tune=100, n_chains=2, seed=1).impacts()


def fit_convergence(spark, d):
    fit = gaussian.fit("SAR", tables.nation_units(spark, d), grid(spark), "y", ["x1"], draws=200, tune=100, n_chains=2, seed=1)
    return mcmc.report(posterior.long_draws(fit.draws, fit.parameters()))


def fit_spatial_cv(spark, d):
    units = tables.nation_units(spark, d)
    folds = units.select("unit_id", F.pmod("unit_id", F.lit(3)).alias("fold"))
    return cv.spatial_cv("SAR", units, grid(spark), folds, "y", ["x1"], draws=60)


def _row_fit(model, outcome, **how):
    def run(spark, d):
        units = tables.nation_units(spark, d).select("unit_id", ((F.col("x1") - 60) / 10).alias("x"), F.expr(outcome).alias("y"))
        return rowwise.fit(model, units, grid(spark), "y", ["x"], draws=100, tune=50, n_chains=2, seed=1, **how).summary()

    return run


def _flow_terms(spark, d):
    units = tables.nation_units(spark, d)
    return lags.flow_design(units, ["x1"]).join(_dense(spark, d), ["origin", "dest"]), units, ["intercept", "dest_x1", "orig_x1"]


def _flow_fit(model):
    def run(spark, d):
        table, units, terms = _flow_terms(spark, d)
        return flows.fit(model, table, grid(spark), units, terms, draws=60, tune=40, n_chains=2, seed=1).summary()

    return run


def fit_negbin_flow(spark, d):
    table, _, terms = _flow_terms(spark, d)
    rows = table.withColumns({"pair": F.col("origin") * 25 + F.col("dest"), **{t: F.col(t) / 60 - 1 for t in terms[1:]}})
    none = weights.ring(spark, 2).limit(0)
    return rowwise.fit("NegBin", rows, none, "y", terms[1:], key="pair", draws=60, tune=40, n_chains=2, seed=1).summary()


def _two_part_fit(model):
    def run(spark, d):
        units = tables.nation_units(spark, d)
        counted = units.select("unit_id", F.greatest(F.floor(F.col("y") / 250) - 17, F.lit(0)).cast("double").alias("y"), ((F.col("x1") - 60) / 10).alias("x"))
        return two_part.fit(model, counted, grid(spark), "y", ["x"], draws=60, tune=40, n_chains=2, seed=1).summary()

    return run


def flow_lm_tests(spark, d):
    table, units, terms = _flow_terms(spark, d)
    return flows.lm_tests(table, grid(spark), units, terms)


def log_det_values(spark, d):
    f = logdet.log_det(tables.nation_units(spark, d), grid(spark), -0.95, 0.95)
    return spark.createDataFrame([(r / 10, float(f(r / 10)), float(f.slope(r / 10))) for r in range(-9, 10)], "rho double, log_det double, slope double")


def unit_sums(spark, d):
    """Sums over a unit's periods, by the operator that takes means of them."""
    return rounded(lags.unit_sums(tables.nation_years(spark, d), ["y"]).select("unit", "y"), ["y"])


def _gap(df, keys, left, right):
    """By how much the two sides of a simulator's equation differ: 0 to 6 digits."""
    return df.select(*keys, (F.round(left - right, 6) + 0.0).alias("gap"))


def sim_lag_equation(spark, d):
    """(I - rho W) y less mean and noise, for the lag model with lagged covariates."""
    out = catalog.simulated("SDM", tables.nation_units(spark, d).select("unit_id"), grid(spark), seed=3)
    seen = lags.spatial_lag(out, grid(spark), ["y", "x1"])
    return _gap(seen, ["unit_id"], F.col("y") - 0.4 * F.col("W_y"), 1 + 2 * F.col("x1") + 0.5 * F.col("W_x1") + simulate.normal(3, "noise", "unit_id"))


def sim_error_equation(spark, d):
    """(I - lam W)(y - mean) less noise, for the error model with lagged covariates."""
    out = catalog.simulated("SDEM", tables.nation_units(spark, d).select("unit_id"), grid(spark), seed=3)
    seen = lags.spatial_lag(out, grid(spark), ["x1"]).withColumn("u", F.col("y") - 1 - 2 * F.col("x1") - 0.5 * F.col("W_x1"))
    seen = lags.spatial_lag(seen, grid(spark), ["u"])
    return _gap(seen, ["unit_id"], F.col("u") - 0.4 * F.col("W_u"), simulate.normal(3, "noise", "unit_id"))


def sim_panel_equation(spark, d):
    """The lag model's equation in each period, with effects of units and periods."""
    out = catalog.simulated("SAR", tables.nation_units(spark, d).select("unit_id"), grid(spark), periods=3, effects="two_way", seed=3)
    seen = lags.spatial_lag(out, grid(spark), ["y"], over=["time"])
    period = F.when(F.col("time") == 0, 0.0).otherwise(0.5 * simulate.normal(3, "period", "time"))
    return _gap(seen, ["unit_id", "time"], F.col("y") - 0.5 * F.col("W_y"), 1 + 2 * F.col("x1") + 0.5 * simulate.normal(3, "unit", "unit_id") + period + simulate.normal(3, "noise", "unit_id", "time"))


def sim_dynamic_equation(spark, d):
    """The restricted dynamic panel's equation from the second period on."""
    out = catalog.simulated("SDM", tables.nation_units(spark, d).select("unit_id"), grid(spark), periods=3, dynamic="restricted", rho=0.3, phi=0.4, theta=None, seed=3)
    seen = lags.spatial_lag(out, grid(spark), ["y"], over=["time"]).withColumnsRenamed({"unit_id": "unit"})
    seen = lags.time_lag(seen, ["y", "W_y"]).withColumnRenamed("unit", "unit_id")
    right = 0.4 * F.col("L_y") - 0.12 * F.col("L_W_y") + 1 + 2 * F.col("x1") + simulate.normal(3, "noise", "unit_id", "time")
    return _gap(seen, ["unit_id", "time"], F.col("y") - 0.3 * F.col("W_y"), right)


def sim_flow_equation(spark, d):
    """The separable flow filter on flows less mean and noise."""
    out = flow_dgp.flows(tables.nation_units(spark, d).select("unit_id"), grid(spark), rho_w=None, seed=3)
    seen = lags.flow_lags(out, grid(spark), "y")
    mean = -0.5 * F.col("log_distance") + F.col("d1") + 0.5 * F.col("d2") + 0.5 * F.col("o1") + 0.3 * F.col("o2")
    return _gap(seen, ["origin", "dest"], F.col("y") - 0.3 * F.col("Wd_y") - 0.2 * F.col("Wo_y") + 0.06 * F.col("Ww_y"), mean + simulate.normal(3, "noise", "origin", "dest"))


def flow_solve(spark, d):
    """The filter on its own solution less what was solved for, with the flow table as right side."""
    ids = [r[0] for r in tables.nation_units(spark, d).select("unit_id").orderBy("unit_id").collect()]
    w = logdet.dense(grid(spark), ids)
    import numpy as np

    y = np.zeros((len(ids), len(ids)))
    for r in _dense(spark, d).collect():
        y[ids.index(r["origin"]), ids.index(r["dest"])] = r["y"]
    gap = solves.kron_apply(w, solves.unrestricted_solve(w, y, 0.3, 0.2, 0.1), 0.3, 0.2, 0.1) - y
    return spark.createDataFrame([(o, t, round(float(gap[i, j]), 6) + 0.0) for i, o in enumerate(ids) for j, t in enumerate(ids)], "origin long, dest long, gap double")


def prior_defaults(spark, d):
    """The default hyper-parameters of some models; null where the data decide."""
    rows = [(m, k, None if v is None else float(v)) for m in ("SAR", "NegBin", "SARLogit", "PanelSDMUDynamic", "PanelSARRE") for k, v in priors.FAMILIES[m].items()]
    return spark.createDataFrame(rows, "model string, setting string, value double")


def trace_resolvent(spark, d):
    """tr of W (I - rW)^-1 at r = 0, and its products: those of W."""
    t = traces.resolvent_traces(tables.nation_units(spark, d).select("unit_id"), grid(spark), 0.0)
    return rounded(spark.createDataFrame([(k, t[k]) for k in sorted(t)], "product string, value double"), ["value"])


def log_det_series(spark, d):
    """log|I - rho W| at small rho, where its power series is short."""
    f = logdet.log_det(tables.nation_units(spark, d), grid(spark), -0.95, 0.95)
    return rounded(spark.createDataFrame([(r / 20, float(f(r / 20))) for r in range(-4, 5)], "rho double, log_det double"), ["log_det"], 5)


def _score_fit(model):
    def run(spark, d):
        fit = gaussian.fit(model, tables.nation_units(spark, d), grid(spark), "y", ["x1"], draws=200, tune=100, n_chains=2, seed=1)
        return score_tests.tests(fit)

    return run


def score_tests_logit(spark, d):
    units = tables.nation_units(spark, d).select("unit_id", ((F.col("x1") - 60) / 10).alias("x"), F.expr("CAST(y > 4500 AS DOUBLE)").alias("y"))
    return score_tests.glm_tests(rowwise.fit("Logit", units, grid(spark), "y", ["x"], draws=100, tune=50, n_chains=2, seed=1))


def fit_formula_sar(spark, d):
    return gaussian.fit_formula("SAR", "y ~ x1 + log(x1)", tables.nation_units(spark, d).filter("x1 > 0"), grid(spark), draws=200, tune=100, n_chains=2, seed=1).summary()


def predict_new_units(spark, d):
    units = tables.nation_units(spark, d)
    fit = gaussian.fit("SAR", units, grid(spark), "y", ["x1"], draws=200, tune=100, n_chains=2, seed=1)
    return gaussian.predict_new(fit, units.withColumn("y", F.when(F.col("unit_id") % 6 != 0, F.col("y"))), grid(spark))


def _squares(spark):
    """A 5 x 5 map of unit squares, as rings."""
    r, c = F.floor(F.col("unit_id") / 5).cast("double"), F.pmod("unit_id", F.lit(5)).cast("double")
    corner = lambda a, b: F.struct((c + a).alias("x"), (r + b).alias("y"))
    return spark.range(25).withColumnRenamed("id", "unit_id").withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))


def column_kinds(spark, d):
    panel = tables.nation_years(spark, d).withColumns({"size": F.col("unit") * 2.0, "year": F.col("time") * 1.0, "one": F.lit(1.0)})
    return lags.column_kinds(panel, ["x1", "size", "year", "one"])


def flow_term_kinds(spark, d):
    table, _, terms = _flow_terms(spark, d)
    return lags.flow_term_kinds(table, [*terms, "y"])


def flow_mask(spark, d):
    flows_ = _dense(spark, d)
    return lags.kept_cells(flows_, flows_.select("origin", "dest", (F.col("origin") != F.col("dest")).alias("keep")))


def _latent_fit(model):
    def run(spark, d):
        units = tables.nation_units(spark, d).select("unit_id", ((F.col("x1") - 60) / 10).alias("x"), F.expr("CAST(y > 4500 AS DOUBLE)").alias("y"))
        return latent.fit(model, units, grid(spark), "y", ["x"], draws=60, tune=40, n_chains=2, seed=1).summary()

    return run


def fit_multilevel(spark, d):
    """Nations in regions: an error process among nations, plain effects of regions."""
    units = tables.nation_units(spark, d).select("unit_id", "region", (F.col("y") / 1000).alias("y"), ((F.col("x1") - 60) / 10).alias("x"))
    regions = units.groupBy(F.col("region").alias("unit_id")).agg(F.avg("x").alias("mean_x"))
    low = multilevel.Level(units, grid(spark), "SEM", ["x"], parent="region")
    return multilevel.fit([low, multilevel.Level(regions, None, "OLS", ["mean_x"])], "y", draws=80, tune=60, n_chains=2, seed=1).summary()


def _count_flow_fit(model):
    def run(spark, d):
        table, _, terms = _flow_terms(spark, d)
        scaled = table.withColumns({t: F.col(t) / 60 - 1 for t in terms[1:]})
        return flow_counts.fit(model, scaled, grid(spark), terms, draws=40, tune=30, n_chains=2, seed=1).summary()

    return run


def compare_models(spark, d):
    units = tables.nation_units(spark, d).withColumn("y", F.col("y") / 1000)
    return gaussian.compare({m: gaussian.fit(m, units, grid(spark), "y", ["x1"], draws=20, tune=20, n_chains=1, seed=1) for m in ("OLS", "SAR", "SEM")})


def _trace(make, graph=grid):
    return lambda spark, d: rounded(make(graph(spark, d)), ["trace"])


QUERIES = {
    "w_ring": _edges(lambda spark, d: weights.ring(spark, 25)),
    "w_region": _edges(region),
    "w_grid_rook": _edges(grid),
    "w_grid_queen": _edges(lambda spark, d: weights.lattice(spark, 5, contiguity="queen")),
    "w_knn": _edges(knn),
    "w_band": _edges(band),
    "w_row_sums": lambda spark, d: rounded(weights.row_sums(band(spark, d), tables.nation_units(spark, d)), ["row_sum"]),
    "w_isolates": lambda spark, d: weights.isolates(band(spark, d), tables.nation_units(spark, d)),
    "w_is_row_std": lambda spark, d: weights.is_row_standardized(grid(spark), tables.nation_units(spark, d)),
    "w_symmetrized": _edges(lambda spark, d: weights.symmetrized(knn(spark, d))),
    "w_asymmetry": lambda spark, d: rounded(weights.asymmetry(knn(spark, d)), ["asymmetry"]),
    "w_fillin_ratio": lambda spark, d: rounded(weights.fill_ratio(grid(spark)), ["fill_ratio"]),
    "w_trace_w2": _trace(lambda e: weights.trace_power(e, 2)),
    "w_trace_w3": _trace(lambda e: weights.trace_power(e, 3), region),
    "w_trace_w4": _trace(lambda e: weights.trace_power(e, 4)),
    "w_trace_w6": _trace(lambda e: weights.trace_power(e, 6)),
    "w_trace_wtw": _trace(weights.trace_gram),
    "w_trace_information": _trace(weights.trace_information),
    "lag_y": lag_y,
    "lag_x_multi": _lagged(grid, ["y", "x1", "x2"], ["W_y", "W_x1", "W_x2"]),
    "lag_transpose": _lagged(knn, ["y"], ["W_y"], transpose=True),
    "lag_twice": lag_twice,
    "lag_isolates_zero": _lagged(band, ["y"], ["W_y"]),
    "lag_panel": lag_panel,
    "lag_panel_time_demeaned": lag_panel_time_demeaned,
    "flow_table": tables.nation_flows,
    "flow_dense_zero_fill": _dense,
    "flow_lags": flow_lags,
    "flow_design": flow_design,
    "flow_design_asymmetric": flow_design_asymmetric,
    "within_unit": _within("unit"),
    "within_time": _within("time"),
    "within_two_way": _within("two_way"),
    "absorbed_columns": absorbed_columns,
    "mundlak_means": mundlak_means,
    "dynamic_lag": dynamic_lag,
    "panel_balance_check": lambda spark, d: tables.panel_is_balanced(tables.nation_years(spark, d)),
    "panel_dense_user_days": lambda spark, d: tables.dense_panel(tables.user_days(spark, d), ["y"]),
    "panel_pivot_wide": panel_pivot_wide,
    "gram": gram,
    "ols_beta": ols_beta,
    "ols_sigma2": ols_sigma2,
    "moran_i": moran_i,
    "lm_battery": lm_battery,
    "lm_decision": lm_decision,
    "impacts_slx": impacts_slx,
    "impacts_sem": impacts_sem,
    "ci_percentiles": ci_percentiles,
    "bayes_pvalue": bayes_pvalue,
    "draw_thinning": draw_thinning,
    "posterior_summary": posterior_summary,
    "activation_probability": activation_probability,
    "predict_in_sample": predict_in_sample,
    "flow_weights_destination": _flow_weights("destination"),
    "flow_weights_origin": _flow_weights("origin"),
    "flow_weights_network": _flow_weights("network"),
    "flow_live_cells": lambda spark, d: lags.live_cells(_dense(spark, d)),
    "left_censor": lambda spark, d: rounded(lags.left_censor(tables.nation_units(spark, d).select("unit_id", "y"), "y", 4500.0), ["y"]),
    "level_nesting": lambda spark, d: lags.nesting(tables.nation_units(spark, d), "unit_id", "region"),
    "counts_check": lambda spark, d: lags.are_counts(tables.nation_units(spark, d), "x1"),
    "unit_sums": unit_sums,
    "impacts_isolates": impacts_isolates,
    "pointwise_lpd": pointwise_lpd,
    "bic_of_draws": bic_of_draws,
    "scalar_functions": scalar_functions,
    "fit_panel_sar_random": lambda spark, d: posterior.summary(posterior.long_draws(random_effects.fit("SAR", tables.nation_years(spark, d), grid(spark), "y", ["x1"], draws=150, tune=100, n_chains=2, seed=1), ["rho", "sigma", "sigma_alpha", "_one", "x1"])),
    **{f"fit_{m.lower()}": _fit(m) for m in ("OLS", "SLX", "SAR", "SEM", "SDM", "SDEM")},
    **{f"fit_panel_sar_{e}": _panel_fit("SAR", e) for e in ("pooled", "unit", "time", "two_way")},
    "fit_panel_sem_unit": _panel_fit("SEM", "unit"),
    "fit_impacts_sdm": fit_impacts_sdm,
    "fit_convergence": fit_convergence,
    "fit_spatial_cv": fit_spatial_cv,
    "fit_sar_robust": _row_fit("SAR", "y / 1000", robust=True),
    "fit_sar_tobit": _row_fit("SARTobit", "greatest(y / 1000, 4.4D)", censoring=4.4),
    "fit_sar_probit": _row_fit("SARProbit", "CAST(y > 4500 AS DOUBLE)"),
    "fit_sar_logit": _row_fit("SARLogit", "CAST(y > 4500 AS DOUBLE)"),
    "fit_sar_negbin": _row_fit("SARNegBin", "CAST(floor(y / 1000) AS DOUBLE)"),
    "fit_ols_flow": _flow_fit("OLSFlow"),
    "fit_sar_flow": _flow_fit("SARFlow"),
    "fit_sem_flow": _flow_fit("SEMFlow"),
    "fit_negbin_flow": fit_negbin_flow,
    **{f"fit_{m.lower()}": _two_part_fit(m) for m in ("ZINB", "SARZINB", "HurdleNegBin", "SARHurdleNegBin")},
    "flow_lm_tests": flow_lm_tests,
    "sim_lag_equation": sim_lag_equation,
    "sim_error_equation": sim_error_equation,
    "sim_panel_equation": sim_panel_equation,
    "sim_dynamic_equation": sim_dynamic_equation,
    "sim_flow_equation": sim_flow_equation,
    "flow_solve": flow_solve,
    "prior_defaults": prior_defaults,
    "trace_resolvent": trace_resolvent,
    "log_det_series": log_det_series,
    **{f"score_tests_{m.lower()}": _score_fit(m) for m in ("SAR", "SEM", "SDM", "SDEM")},
    "score_tests_logit": score_tests_logit,
    **{f"fit_latent_{m.lower()}": _latent_fit(m) for m in ("SEMProbit", "SEMLogit", "SDEMProbit", "SDEMLogit")},
    "fit_multilevel": fit_multilevel,
    "w_polygons_queen": _edges(lambda spark, d: weights.contiguity(_squares(spark))),
    "w_polygons_rook": _edges(lambda spark, d: weights.contiguity(_squares(spark), "rook")),
    "column_kinds": column_kinds,
    "flow_term_kinds": flow_term_kinds,
    "flow_mask": flow_mask,
    **{f"fit_{m.lower()}": _count_flow_fit(m) for m in ("SARNegBinFlow", "SARPoissonFlow", "SARZINBFlow", "SARHurdleNegBinFlow")},
    "compare_models": compare_models,
    "fit_formula_sar": fit_formula_sar,
    "predict_new_units": predict_new_units,
    "log_det_values": log_det_values,
}
ORACLES = dict(SQL)
