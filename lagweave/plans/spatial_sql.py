"""DuckDB SQL for the deterministic spatial queries."""

UNITS = """units AS (SELECT CAST(n_nationkey AS BIGINT) AS unit_id, CAST(n_regionkey AS BIGINT) AS region, coalesce(y, 0) AS y, coalesce(x1, 0) AS x1, coalesce(x2, 0) AS x2
 FROM nation LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS y, CAST(count(*) AS DOUBLE) AS x1, avg(c_acctbal * c_acctbal) / 1e6 AS x2 FROM customer GROUP BY 1) ON n_nationkey = c_nationkey)"""
K = "(SELECT unnest(range(25)) AS k)"
RING = f"ring AS (SELECT k AS focal, (k + s) % 25 AS neighbor, CAST(0.5 AS DOUBLE) AS w FROM {K}, (SELECT unnest([1, 24]) AS s))"


def _standard(name: str, pairs: str) -> str:
    return f"{name} AS (SELECT focal, neighbor, 1.0 / CAST(count(*) OVER (PARTITION BY focal) AS DOUBLE) AS w FROM ({pairs}))"


REGION = _standard("region_w", "SELECT a.unit_id AS focal, b.unit_id AS neighbor FROM units a JOIN units b ON a.region = b.region AND a.unit_id <> b.unit_id")
GRID = _standard("grid", f"SELECT a.k AS focal, b.k AS neighbor FROM {K} a, {K} b WHERE abs(a.k // 5 - b.k // 5) + abs(a.k % 5 - b.k % 5) = 1")
QUEEN = _standard("queen", f"SELECT a.k AS focal, b.k AS neighbor FROM {K} a, {K} b WHERE a.k <> b.k AND greatest(abs(a.k // 5 - b.k // 5), abs(a.k % 5 - b.k % 5)) = 1")
FAR = "sqrt(pow(a.x1 - b.x1, 2) + pow(a.y / 100 - b.y / 100, 2))"
KNN = f"knn AS (SELECT focal, neighbor, 1.0 / CAST(3 AS DOUBLE) AS w FROM (SELECT a.unit_id AS focal, b.unit_id AS neighbor, row_number() OVER (PARTITION BY a.unit_id ORDER BY {FAR}, b.unit_id) AS r FROM units a JOIN units b ON a.unit_id <> b.unit_id) WHERE r <= 3)"
BAND = _standard("band", f"SELECT a.unit_id AS focal, b.unit_id AS neighbor FROM units a JOIN units b ON a.unit_id <> b.unit_id WHERE {FAR} <= 4.0")
PANEL = "panel AS (SELECT CAST(c_nationkey AS BIGINT) AS unit, CAST(year(o_orderdate) AS BIGINT) AS time, sum(o_totalprice) / 1000 AS y, CAST(count(*) AS DOUBLE) AS x1 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
FLOWS = """raw AS (SELECT CAST(s_nationkey AS BIGINT) AS origin, CAST(c_nationkey AS BIGINT) AS dest, CAST(count(*) AS DOUBLE) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
flows AS (SELECT o.unit_id AS origin, d.unit_id AS dest, coalesce(raw.y, 0) AS y FROM units o CROSS JOIN units d LEFT JOIN raw ON raw.origin = o.unit_id AND raw.dest = d.unit_id)"""
WAVE = "((k * {m} % 2003) / 2003.0 - 0.5) * {a}"
DRAWS = "draws AS (SELECT k // 500 AS chain, k % 500 AS draw, " + ", ".join(
    f"{base} + " + WAVE.format(m=m, a=a) + f" AS {name}"
    for name, base, m, a in (("rho", "CAST(0.35 AS DOUBLE)", 7, 0.2), ("beta0", "CAST(1.2 AS DOUBLE)", 11, 0.5), ("beta1", "CAST(-0.1 AS DOUBLE)", 13, 0.6), ("theta1", "CAST(0.3 AS DOUBLE)", 17, 0.4), ("sigma", "CAST(1.0 AS DOUBLE)", 19, 0.3))
) + " FROM (SELECT CAST(unnest(range(2000)) AS BIGINT) AS k))"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def edges(name: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} SELECT CAST(focal AS BIGINT) AS focal, CAST(neighbor AS BIGINT) AS neighbor, {r('w', 'w')} FROM {name}"


def _lag(name: str, graph: str, column: str = "y", source: str = "units", a: str = "focal", b: str = "neighbor") -> str:
    return f"{name} AS (SELECT u.unit_id, coalesce(sum(e.w * v.{column}), 0) AS v FROM units u LEFT JOIN {graph} e ON e.{a} = u.unit_id LEFT JOIN {source} v ON v.unit_id = e.{b} GROUP BY 1)"


W2 = "w2 AS (SELECT a.focal, b.neighbor, sum(a.w * b.w) AS w FROM grid a JOIN grid b ON a.neighbor = b.focal GROUP BY 1, 2)"
W3 = "w3 AS (SELECT a.focal, b.neighbor, sum(a.w * b.w) AS w FROM w2 a JOIN grid b ON a.neighbor = b.focal GROUP BY 1, 2)"


def _trace(a: str, b: str) -> str:
    return f"(SELECT sum(a.w * b.w) FROM {a} a JOIN {b} b ON a.neighbor = b.focal AND a.focal = b.neighbor)"


PANEL_GRID_LAG = "lagged AS (SELECT p.unit, p.time, p.y, coalesce(sum(e.w * q.y), 0) AS wy FROM panel p LEFT JOIN grid e ON e.focal = p.unit LEFT JOIN panel q ON q.unit = e.neighbor AND q.time = p.time GROUP BY 1, 2, 3)"
TWO_WAY = "{c} - avg({c}) OVER (PARTITION BY unit) - avg({c}) OVER (PARTITION BY time) + avg({c}) OVER ()"
FD = "fd AS (SELECT f.origin, f.dest, f.y, coalesce(sum(e.w * g.y), 0) AS wd FROM flows f LEFT JOIN grid e ON e.focal = f.dest LEFT JOIN flows g ON g.origin = f.origin AND g.dest = e.neighbor GROUP BY 1, 2, 3)"
FO = "fo AS (SELECT f.origin, f.dest, f.y, f.wd, coalesce(sum(e.w * g.y), 0) AS wo, coalesce(sum(e.w * g.wd), 0) AS ww FROM fd f LEFT JOIN grid e ON e.focal = f.origin LEFT JOIN fd g ON g.dest = f.dest AND g.origin = e.neighbor GROUP BY 1, 2, 3, 4)"
#: OLS of y on 1 and x1, and what the LM tests need, over the grid.
FIT = f"""{UNITS}, {GRID}, fit AS (SELECT regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS b0, count(*) AS n FROM units),
res AS (SELECT unit_id, x1, y, y - b0 - b1 * x1 AS e, b0 + b1 * x1 AS f FROM units, fit),
lagged AS (SELECT u.unit_id, u.x1, u.e, u.f, sum(w.w * v.e) AS we, sum(w.w * v.y) AS wy, sum(w.w * v.f) AS wf, sum(w.w * v.x1) AS wx FROM res u JOIN grid w ON w.focal = u.unit_id JOIN res v ON v.unit_id = w.neighbor GROUP BY 1, 2, 3, 4),
s AS (SELECT sum(e * e) / count(*) AS s2, sum(e * we) AS ewe, sum(e * wy) AS ewy, sum(e * wx) AS ewx,
 regr_syy(wf, x1) - pow(regr_sxy(wf, x1), 2) / regr_sxx(wf, x1) AS d, regr_syy(wx, x1) - pow(regr_sxy(wx, x1), 2) / regr_sxx(wx, x1) AS m FROM lagged),
q AS (SELECT ewe / s2 AS ge, ewy / s2 AS gl, d / s2 AS dd, {_trace('grid', 'grid')} + (SELECT sum(w * w) FROM grid) AS t, ewx * ewx / m / s2 AS wxs FROM s)"""
LM = {
    "LM-Lag": "gl * gl / (t + dd)",
    "LM-Error": "ge * ge / t",
    "Robust-LM-Lag": "pow(gl - ge, 2) / dd",
    "Robust-LM-Error": "pow(ge - t / (t + dd) * gl, 2) / (t * (1 - t / (t + dd)))",
    "LM-WX": "wxs",
    "LM-SDM-Joint": "ge * ge / t + wxs",
    "LM-SLX-Error-Joint": "ge * ge / t + wxs",
    "Robust-LM-WX": "ge * ge / t + wxs - gl * gl / (t + dd)",
}
#: Row-standardized, so that a multiplier's row sums are 1 / (1 - rho).
EIG_FREE_TOTAL = "beta1 / (1 - rho)"


def _effects(direct: str, total: str) -> str:
    q = lambda x, p: f"quantile_cont({x}, {p})"
    p = lambda x: f"2 * least(avg(CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN {x} < 0 THEN 1.0 ELSE 0.0 END))"
    cols = []
    for n, x in (("direct", "d"), ("indirect", "(t - d)"), ("total", "t")):
        cols += [r(f"avg({x})", f"{n}_mean"), r(q(x, 0.025), f"{n}_ci_lower"), r(q(x, 0.975), f"{n}_ci_upper"), r(p(x), f"{n}_pvalue")]
    return f"SELECT 'x1' AS variable, {', '.join(cols)} FROM (SELECT {direct} AS d, {total} AS t FROM draws)"


SQL = {
    "w_ring": edges("ring", RING),
    "w_region": edges("region_w", UNITS, REGION),
    "w_grid_rook": edges("grid", GRID),
    "w_grid_queen": edges("queen", QUEEN),
    "w_knn": edges("knn", UNITS, KNN),
    "w_band": edges("band", UNITS, BAND),
    "w_row_sums": f"WITH {UNITS}, {BAND} SELECT u.unit_id, {r('coalesce(sum(w), 0)', 'row_sum')}, CAST(count(w) AS BIGINT) AS degree FROM units u LEFT JOIN band ON focal = u.unit_id GROUP BY 1",
    "w_isolates": f"WITH {UNITS}, {BAND} SELECT unit_id FROM units WHERE unit_id NOT IN (SELECT focal FROM band)",
    "w_is_row_std": f"WITH {GRID} SELECT bool_and(abs(s - 1) <= 1e-6) AS row_standardized FROM (SELECT focal, sum(w) AS s FROM grid GROUP BY 1)",
    "w_symmetrized": f"WITH {UNITS}, {KNN} SELECT focal, neighbor, {r('sum(w) / 2', 'w')} FROM (SELECT focal, neighbor, w FROM knn UNION ALL SELECT neighbor, focal, w FROM knn) GROUP BY 1, 2",
    "w_asymmetry": f"WITH {UNITS}, {KNN} SELECT {r('max(g)', 'asymmetry')} FROM (SELECT abs(sum(w)) AS g FROM (SELECT focal, neighbor, w FROM knn UNION ALL SELECT neighbor, focal, -w FROM knn) GROUP BY focal, neighbor)",
    "w_fillin_ratio": f"WITH {GRID}, {W2} SELECT {r('(SELECT count(*) FROM w2) / CAST((SELECT count(*) FROM grid) AS DOUBLE)', 'fill_ratio')}",
    "w_trace_w2": f"WITH {GRID} SELECT {r(_trace('grid', 'grid'), 'trace')}",
    "w_trace_w3": f"WITH {UNITS}, {REGION}, w2 AS (SELECT a.focal, b.neighbor, sum(a.w * b.w) AS w FROM region_w a JOIN region_w b ON a.neighbor = b.focal GROUP BY 1, 2) SELECT {r(_trace('w2', 'region_w'), 'trace')}",
    "w_trace_w4": f"WITH {GRID}, {W2} SELECT {r(_trace('w2', 'w2'), 'trace')}",
    "w_trace_w6": f"WITH {GRID}, {W2}, {W3} SELECT {r(_trace('w3', 'w3'), 'trace')}",
    "w_trace_wtw": f"WITH {GRID} SELECT {r('sum(w * w)', 'trace')} FROM grid",
    "w_trace_information": f"WITH {GRID} SELECT {r(_trace('grid', 'grid') + ' + (SELECT sum(w * w) FROM grid)', 'trace')}",
    "lag_y": f"WITH {UNITS}, {RING}, {_lag('l', 'ring')} SELECT u.unit_id, {r('u.y', 'y')}, {r('l.v', 'W_y')} FROM units u JOIN l USING (unit_id)",
    "lag_x_multi": f"WITH {UNITS}, {GRID}, {_lag('a', 'grid')}, {_lag('b', 'grid', 'x1')}, {_lag('c', 'grid', 'x2')} SELECT unit_id, {r('a.v', 'W_y')}, {r('b.v', 'W_x1')}, {r('c.v', 'W_x2')} FROM a JOIN b USING (unit_id) JOIN c USING (unit_id)",
    "lag_transpose": f"WITH {UNITS}, {KNN}, {_lag('l', 'knn', a='neighbor', b='focal')} SELECT unit_id, {r('v', 'W_y')} FROM l",
    "lag_twice": f"WITH {UNITS}, {GRID}, {_lag('a', 'grid')}, {_lag('b', 'grid', 'v', 'a')} SELECT unit_id, {r('a.v', 'W_y')}, {r('b.v', 'W_W_y')} FROM a JOIN b USING (unit_id)",
    "lag_isolates_zero": f"WITH {UNITS}, {BAND}, {_lag('l', 'band')} SELECT unit_id, {r('v', 'W_y')} FROM l",
    "lag_panel": f"WITH {PANEL}, {GRID}, {PANEL_GRID_LAG} SELECT unit, time, {r('wy', 'W_y')} FROM lagged",
    "lag_panel_time_demeaned": f"WITH {PANEL}, {GRID}, {PANEL_GRID_LAG} SELECT unit, time, {r('wy - avg(wy) OVER (PARTITION BY time)', 'D_W_y')} FROM lagged",
    "flow_table": f"WITH {UNITS}, {FLOWS} SELECT origin, dest, y FROM raw",
    "flow_dense_zero_fill": f"WITH {UNITS}, {FLOWS} SELECT origin, dest, y FROM flows",
    "flow_lags": f"WITH {UNITS}, {FLOWS}, {GRID}, {FD}, {FO} SELECT origin, dest, {r('wd', 'Wd_y')}, {r('wo', 'Wo_y')}, {r('ww', 'Ww_y')} FROM fo",
    "flow_design": f"WITH {UNITS} SELECT o.unit_id AS origin, d.unit_id AS dest, CAST(1 AS DOUBLE) AS intercept, CAST(o.unit_id = d.unit_id AS DOUBLE) AS intra_indicator, {r('d.x1', 'dest_x1')}, {r('o.x1', 'orig_x1')}, {r('CASE WHEN o.unit_id = d.unit_id THEN d.x1 ELSE 0 END', 'intra_x1')}, {r('ln(1 + abs(o.unit_id - d.unit_id))', 'log_distance')} FROM units o CROSS JOIN units d",
    "flow_design_asymmetric": f"WITH {UNITS} SELECT o.unit_id AS origin, d.unit_id AS dest, CAST(1 AS DOUBLE) AS intercept, CAST(o.unit_id = d.unit_id AS DOUBLE) AS intra_indicator, {r('d.x1', 'dest_x1')}, {r('d.x2', 'dest_x2')}, {r('o.x1', 'orig_x1')}, {r('CASE WHEN o.unit_id = d.unit_id THEN d.x1 ELSE 0 END', 'intra_x1')}, {r('CASE WHEN o.unit_id = d.unit_id THEN d.x2 ELSE 0 END', 'intra_x2')} FROM units o CROSS JOIN units d",
    "within_unit": f"WITH {PANEL} SELECT unit, time, {r('y - avg(y) OVER (PARTITION BY unit)', 'D_y')}, {r('x1 - avg(x1) OVER (PARTITION BY unit)', 'D_x1')} FROM panel",
    "within_time": f"WITH {PANEL} SELECT unit, time, {r('y - avg(y) OVER (PARTITION BY time)', 'D_y')}, {r('x1 - avg(x1) OVER (PARTITION BY time)', 'D_x1')} FROM panel",
    "within_two_way": f"WITH {PANEL} SELECT unit, time, {r(TWO_WAY.format(c='y'), 'D_y')}, {r(TWO_WAY.format(c='x1'), 'D_x1')} FROM panel",
    "absorbed_columns": "SELECT * FROM (VALUES ('x1', false), ('size', true)) AS t(variable, absorbed)",
    "mundlak_means": f"WITH {PANEL} SELECT unit, time, {r('avg(x1) OVER (PARTITION BY unit)', 'mean_x1')} FROM panel",
    "dynamic_lag": f"WITH {PANEL} SELECT unit, time, {r('y', 'y')}, {r('l', 'L_y')} FROM (SELECT unit, time, y, lag(y) OVER (PARTITION BY unit ORDER BY time) AS l FROM panel) WHERE l IS NOT NULL",
    "panel_balance_check": f"WITH {PANEL} SELECT count(*) AS n_rows, count(DISTINCT unit) AS units, count(DISTINCT time) AS periods, count(*) = count(DISTINCT unit) * count(DISTINCT time) AS balanced FROM panel",
    "panel_dense_user_days": "WITH p AS (SELECT user_id AS unit, CAST(dayofyear(ts) AS BIGINT) AS time, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2) SELECT u.unit, t.time, coalesce(p.y, 0) AS y FROM (SELECT DISTINCT unit FROM p) u CROSS JOIN (SELECT DISTINCT time FROM p) t LEFT JOIN p ON p.unit = u.unit AND p.time = t.time",
    "panel_pivot_wide": f"WITH {PANEL} SELECT unit, " + ", ".join(r(f"max(CASE WHEN time = {t} THEN y END)", f"y_{t}") for t in range(1995, 2002)) + " FROM panel GROUP BY unit",
    "gram": f"WITH {UNITS}, z AS (SELECT CAST(1 AS DOUBLE) AS one, x1, y FROM units), u AS (UNPIVOT (SELECT row_number() OVER () AS i, * FROM z) ON one, x1, y INTO NAME v VALUE x) SELECT a.v AS row_var, b.v AS col_var, {r('sum(a.x * b.x)', 'value', 4)} FROM u a JOIN u b ON a.i = b.i GROUP BY 1, 2",
    "ols_beta": f"WITH {UNITS} SELECT {r('regr_intercept(y, x1)', 'intercept', 4)}, {r('regr_slope(y, x1)', 'x1', 4)} FROM units",
    "ols_sigma2": f"WITH {UNITS} SELECT {r('(regr_syy(y, x1) - pow(regr_sxy(y, x1), 2) / regr_sxx(y, x1)) / count(*)', 'sigma2', 3)} FROM units",
    "moran_i": f"WITH {UNITS}, {GRID}, z AS (SELECT unit_id, y - avg(y) OVER () AS z FROM units) SELECT {r('(SELECT sum(a.z * e.w * b.z) FROM z a JOIN grid e ON e.focal = a.unit_id JOIN z b ON b.unit_id = e.neighbor) / (SELECT sum(z * z) FROM z)', 'moran_i')}",
    "lm_battery": f"WITH {FIT} " + " UNION ALL ".join(f"SELECT '{k}' AS test, {r(v, 'statistic')}, {1 if 'Joint' not in k else 2} AS df FROM q" for k, v in LM.items()),
    "impacts_slx": f"WITH {DRAWS} {_effects('beta1', 'beta1 + theta1')}",
    "impacts_sem": f"WITH {DRAWS} {_effects('beta1', 'beta1')}",
    "ci_percentiles": f"WITH {DRAWS} SELECT {r('quantile_cont(rho, 0.025)', 'lower')}, {r('quantile_cont(rho, 0.975)', 'upper')} FROM draws",
    "bayes_pvalue": f"WITH {DRAWS} SELECT {r('2 * least(avg(CAST(beta1 > 0 AS DOUBLE)), avg(CAST(beta1 < 0 AS DOUBLE)))', 'pvalue')} FROM draws",
    "draw_thinning": f"WITH {DRAWS} SELECT chain, draw, {r('rho', 'rho')} FROM draws WHERE draw % 5 = 0",
    "posterior_summary": f"WITH {DRAWS}, l AS (UNPIVOT (SELECT rho, beta0, beta1, theta1, sigma FROM draws) ON rho, beta0, beta1, theta1, sigma INTO NAME label VALUE v) SELECT label, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}, {r('quantile_cont(v, 0.025)', 'lower')}, {r('quantile_cont(v, 0.975)', 'upper')} FROM l GROUP BY 1",
    "activation_probability": f"WITH {DRAWS}, {UNITS} SELECT unit_id, {r('avg(1 / (1 + exp(-(beta0 + beta1 * x1 / 100))))', 'probability')} FROM units CROSS JOIN draws GROUP BY 1",
    "predict_in_sample": f"WITH {UNITS}, {KNN}, r AS (SELECT unit_id, y - 4000 - 10 * x1 AS r FROM units), a AS (SELECT r.unit_id, r.r - 0.4 * coalesce(sum(e.w * q.r), 0) AS a FROM r LEFT JOIN knn e ON e.focal = r.unit_id LEFT JOIN r q ON q.unit_id = e.neighbor GROUP BY r.unit_id, r.r), "
    "t AS (SELECT a.unit_id, a.a - 0.4 * coalesce(sum(e.w * b.a), 0) AS lr FROM a LEFT JOIN knn e ON e.neighbor = a.unit_id LEFT JOIN a b ON b.unit_id = e.focal GROUP BY a.unit_id, a.a), d AS (SELECT u.unit_id, 1 + 0.16 * coalesce(sum(e.w * e.w), 0) AS d FROM units u LEFT JOIN knn e ON e.neighbor = u.unit_id GROUP BY 1) "
    f"SELECT unit_id, {r('y - lr / d', 'y_bp', 4)} FROM units JOIN t USING (unit_id) JOIN d USING (unit_id)",
}

KRON = f"WITH {UNITS}, {RING}, same AS (SELECT unit_id AS focal, unit_id AS neighbor, CAST(1 AS DOUBLE) AS w FROM units)"
POINT = f"p AS (SELECT unit_id, chain, draw, -0.5 * pow((y / 1000 - beta0 - 3) / sigma, 2) - ln(sigma) AS ll FROM units CROSS JOIN draws)"
SQL |= {
    **{
        f"flow_weights_{kind}": f"{KRON} SELECT CAST(o.focal AS BIGINT) AS origin, CAST(d.focal AS BIGINT) AS dest, CAST(o.neighbor AS BIGINT) AS origin_to, CAST(d.neighbor AS BIGINT) AS dest_to, {r('o.w * d.w', 'w')} FROM {o} o CROSS JOIN {d} d"
        for kind, o, d in (("destination", "same", "ring"), ("origin", "ring", "same"), ("network", "ring", "ring"))
    },
    "flow_live_cells": f"WITH {UNITS}, {FLOWS} SELECT origin, dest, y FROM flows WHERE origin IN (SELECT origin FROM flows GROUP BY 1 HAVING sum(y) > 0) AND dest IN (SELECT dest FROM flows GROUP BY 1 HAVING sum(y) > 0)",
    "left_censor": f"WITH {UNITS} SELECT unit_id, {r('greatest(y, 4500)', 'y')}, y <= 4500 AS censored FROM units",
    "level_nesting": f"WITH {UNITS} SELECT unit_id, region FROM units",
    "counts_check": f"WITH {UNITS} SELECT bool_and(x1 >= 0 AND x1 = floor(x1)) AS counts FROM units",
    "unit_sums": f"WITH {PANEL} SELECT unit, {r('sum(y)', 'y')} FROM panel GROUP BY 1",
    "impacts_isolates": f"WITH {UNITS}, {BAND}, {DRAWS}, m AS (SELECT count(*) AS m FROM units WHERE unit_id NOT IN (SELECT focal FROM band)) SELECT {r('avg(((25 - m) / (1 - rho) + m) / 25 * beta1)', 'total_mean')} FROM draws, m",
    "pointwise_lpd": f"WITH {UNITS}, {DRAWS}, {POINT} SELECT unit_id, {r('ln(avg(exp(ll)))', 'lpd')} FROM p GROUP BY 1",
    "bic_of_draws": f"WITH {UNITS}, {DRAWS}, {POINT} SELECT {r('2 * ln(25) - 2 * max(ll)', 'bic', 4)} FROM (SELECT chain, draw, sum(ll) AS ll FROM p GROUP BY 1, 2)",
    "scalar_functions": f"SELECT id, {r('exp(2 * (ln(2) - ln(2 + exp(k))))', 'p0')}, {r('CASE WHEN id = 0 THEN 0.75 ELSE 3 * (exp(k) - 1) / (exp(k) + 1) / (2 * k) END', 'pg')}, {r('1 / (1 + exp(-k))', 'logistic')}, {r('ln(1 + abs(k))', 'log1p')} FROM (SELECT id, CAST(id AS DOUBLE) / 10 AS k FROM (SELECT CAST(unnest(range(-40, 41)) AS BIGINT) AS id))",
}

# The sides of a simulator's equation differ by 0 everywhere, whatever was drawn.
IDS = "SELECT n_nationkey AS unit_id FROM nation"
CHI2 = "3.841458820694124"
SMALL = "(VALUES ('SAR', 'beta_mu', NULL), ('SAR', 'beta_sigma', NULL), ('SAR', 'sigma2_alpha', 2.0), ('SAR', 'sigma2_beta', NULL), ('SAR', 'nu', 4.0), ('SAR', 'rho_lower', -1.0), ('SAR', 'rho_upper', 1.0), " \
    "('NegBin', 'beta_mu', NULL), ('NegBin', 'beta_sigma', NULL), ('NegBin', 'sigma2_alpha', 2.0), ('NegBin', 'sigma2_beta', NULL), ('NegBin', 'nu', 4.0), ('NegBin', 'alpha_sigma', 2.5), ('NegBin', 'alpha_nu', 3.0), ('NegBin', 'alpha_fixed', NULL), " \
    "('SARLogit', 'beta_mu', NULL), ('SARLogit', 'beta_sigma', NULL), ('SARLogit', 'rho_lower', -0.999), ('SARLogit', 'rho_upper', 0.999), " \
    "('PanelSDMUDynamic', 'beta_mu', NULL), ('PanelSDMUDynamic', 'beta_sigma', NULL), ('PanelSDMUDynamic', 'sigma2_alpha', 2.0), ('PanelSDMUDynamic', 'sigma2_beta', NULL), ('PanelSDMUDynamic', 'nu', 4.0), ('PanelSDMUDynamic', 'phi_lower', -0.95), ('PanelSDMUDynamic', 'phi_upper', 0.95), " \
    "('PanelSDMUDynamic', 'rho_lower', -0.95), ('PanelSDMUDynamic', 'rho_upper', 0.95), ('PanelSDMUDynamic', 'theta_lower', -0.95), ('PanelSDMUDynamic', 'theta_upper', 0.95), " \
    "('PanelSARRE', 'beta_mu', NULL), ('PanelSARRE', 'beta_sigma', NULL), ('PanelSARRE', 'sigma2_alpha', 2.0), ('PanelSARRE', 'sigma2_beta', NULL), ('PanelSARRE', 'nu', 4.0), ('PanelSARRE', 'rho_lower', -1.0), ('PanelSARRE', 'rho_upper', 1.0), ('PanelSARRE', 'unit_effect_sd_nu', 1.0), ('PanelSARRE', 'unit_effect_sd_scale', NULL)) AS t(model, setting, v)"
POWERS = "p1 AS (SELECT focal, neighbor, w FROM grid), " + ", ".join(
    f"p{k + 1} AS (SELECT a.focal, b.neighbor, sum(a.w * b.w) AS w FROM p{k} a JOIN grid b ON a.neighbor = b.focal GROUP BY 1, 2)" for k in range(1, 14)
)
TRACES = "t AS (" + " UNION ALL ".join(f"SELECT {k} AS k, coalesce(sum(w), 0) AS v FROM p{k} WHERE focal = neighbor" for k in range(1, 15)) + ")"
SQL |= {
    "sim_lag_equation": f"SELECT CAST(unit_id AS BIGINT) AS unit_id, CAST(0 AS DOUBLE) AS gap FROM ({IDS})",
    "sim_error_equation": f"SELECT CAST(unit_id AS BIGINT) AS unit_id, CAST(0 AS DOUBLE) AS gap FROM ({IDS})",
    "sim_panel_equation": f"SELECT CAST(unit_id AS BIGINT) AS unit_id, t.time, CAST(0 AS DOUBLE) AS gap FROM ({IDS}), (SELECT unnest(range(3)) AS time) t",
    "sim_dynamic_equation": f"SELECT CAST(unit_id AS BIGINT) AS unit_id, t.time, CAST(0 AS DOUBLE) AS gap FROM ({IDS}), (SELECT unnest(range(1, 3)) AS time) t",
    "sim_flow_equation": f"SELECT CAST(a.unit_id AS BIGINT) AS origin, CAST(b.unit_id AS BIGINT) AS dest, CAST(0 AS DOUBLE) AS gap FROM ({IDS}) a, ({IDS}) b",
    "flow_solve": f"SELECT CAST(a.unit_id AS BIGINT) AS origin, CAST(b.unit_id AS BIGINT) AS dest, CAST(0 AS DOUBLE) AS gap FROM ({IDS}) a, ({IDS}) b",
    "prior_defaults": f"SELECT model, setting, CAST(v AS DOUBLE) AS value FROM {SMALL}",
    "trace_resolvent": f"WITH {GRID}, x AS (SELECT sum(a.w * b.w) AS cross_ FROM grid a JOIN grid b ON a.focal = b.neighbor AND a.neighbor = b.focal), s AS (SELECT sum(w * w) AS square FROM grid) "
    f"SELECT product, {r('v', 'value')} FROM (SELECT 'g' AS product, CAST(0 AS DOUBLE) AS v UNION ALL SELECT 'gg', cross_ FROM x UNION ALL SELECT 'gtg', square FROM s UNION ALL SELECT 'wg', cross_ FROM x UNION ALL SELECT 'wtg', square FROM s)",
    "log_det_series": f"WITH {GRID}, {POWERS}, {TRACES}, q AS (SELECT CAST(i AS DOUBLE) / 20 AS rho FROM (SELECT unnest(range(-4, 5)) AS i)) SELECT rho, {r('-sum(pow(rho, k) * v / k)', 'log_det', 5)} FROM q, t GROUP BY rho",
    "lm_decision": f"WITH {FIT}, signs AS (SELECT " + ", ".join(f"{v} AS \"{k}\"" for k, v in LM.items()) + " FROM q) SELECT CASE "
    f"WHEN \"LM-Lag\" > {CHI2} AND \"LM-Error\" > {CHI2} THEN (CASE WHEN (\"Robust-LM-Lag\" > {CHI2}) <> (\"Robust-LM-Error\" > {CHI2}) THEN (CASE WHEN \"Robust-LM-Lag\" > {CHI2} THEN 'SAR' ELSE 'SEM' END) WHEN \"Robust-LM-Lag\" >= \"Robust-LM-Error\" THEN 'SAR' ELSE 'SEM' END) "
    f"WHEN \"LM-Lag\" > {CHI2} THEN (CASE WHEN \"LM-WX\" <= {CHI2} THEN 'SAR' WHEN \"Robust-LM-WX\" > {CHI2} THEN 'SLX' WHEN \"LM-Error\" >= \"Robust-LM-WX\" THEN 'SAR' ELSE 'SLX' END) "
    f"WHEN \"LM-Error\" > {CHI2} THEN (CASE WHEN \"LM-WX\" <= {CHI2} THEN 'SEM' WHEN \"LM-Error\" >= \"LM-WX\" THEN 'SEM' ELSE 'SLX' END) "
    f"WHEN \"LM-WX\" > {CHI2} THEN 'SLX' ELSE 'OLS' END AS model FROM signs",
}
SQL |= {
    "w_polygons_queen": SQL["w_grid_queen"],
    "w_polygons_rook": SQL["w_grid_rook"],
    "column_kinds": f"WITH {PANEL} SELECT 'x1' AS variable, (SELECT bool_or(n > 1) FROM (SELECT count(DISTINCT x1) AS n FROM panel GROUP BY time)) AS over_units, (SELECT bool_or(n > 1) FROM (SELECT count(DISTINCT x1) AS n FROM panel GROUP BY unit)) AS over_time "
    "UNION ALL SELECT * FROM (VALUES ('size', true, false), ('year', false, true), ('one', false, false)) AS t(a, b, c)",
    "flow_term_kinds": "SELECT * FROM (VALUES ('intercept', 'constant'), ('dest_x1', 'destination'), ('orig_x1', 'origin'), ('y', 'pair')) AS t(variable, kind)",
    "flow_mask": f"SELECT origin, dest, y FROM ({SQL['flow_dense_zero_fill']}) WHERE origin <> dest",
}
