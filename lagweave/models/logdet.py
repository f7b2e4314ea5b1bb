"""log|I - rho W| and its derivative.

Up to ``eigen_most`` units by eigenvalues; up to ``dense_most`` by a Chebyshev series through
dense factorizations, one node to a Spark task; beyond that by moments of Chebyshev polynomials of
W, from random probes carried through edge joins, with the first moments exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import weights


def index_of(units: DataFrame, key: str = "unit_id", most: int = 4000) -> list:
    """Unit keys in order, for ``most`` units at most."""
    found = units.select(key).distinct().orderBy(key).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} units are too many for a dense matrix")
    return [r[0] for r in found]


def dense(edges: DataFrame, ids: list, most: int = 4000) -> np.ndarray:
    """W as a matrix, for ``most`` units at most."""
    if len(ids) > most:
        raise ValueError(f"{len(ids)} units are too many for a dense matrix ({most})")
    at = {u: i for i, u in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in edges.collect():
        w[at[r["focal"]], at[r["neighbor"]]] += r["w"]
    return w


class Eigen:
    def __init__(self, values: np.ndarray):
        self.values = values

    def __call__(self, rho):
        rho = np.asarray(rho, float)
        return np.log(np.abs(1 - rho[..., None] * self.values)).sum(-1)

    def slope(self, rho):
        rho = np.asarray(rho, float)
        return -(self.values / (1 - rho[..., None] * self.values)).real.sum(-1)


class Series:
    """A Chebyshev series on (low, high), by Clenshaw's recurrence in numpy."""

    def __init__(self, coefficients: np.ndarray, low: float, high: float):
        self.series = np.polynomial.Chebyshev(coefficients, domain=(low, high))
        self.derivative = self.series.deriv()

    def __call__(self, rho):
        return self.series(np.asarray(rho, float))

    def slope(self, rho):
        return self.derivative(np.asarray(rho, float))


def nodes(order: int, low: float, high: float) -> np.ndarray:
    return (low + high) / 2 + (high - low) / 2 * np.cos((np.arange(order) + 0.5) * np.pi / order)


def order_for(low: float, high: float, n: int, tolerance: float = 1e-6) -> int:
    """Nodes for the tolerance, by the ellipse through the nearest singularity of log(1 - rho)."""
    gap = max(1e-6, min(1 - high, 1 + low) if low < 0 else 1 - high)
    z = 1 + 2 * gap / (high - low)
    rate = z + np.sqrt(z * z - 1)
    return int(np.clip(np.ceil(np.log(n / tolerance) / np.log(rate)), 4, 200))


def fit_series(values: np.ndarray, low: float, high: float) -> Series:
    order = len(values)
    k = np.arange(order)
    basis = np.cos(np.outer(k, (k + 0.5) * np.pi / order))
    c = 2 / order * basis @ values
    c[0] /= 2
    return Series(c, low, high)


def by_nodes(spark, w: np.ndarray, low: float, high: float, order: int | None = None) -> Series:
    """Dense log-determinants at the nodes, each in a task of its own."""
    at = nodes(order or order_for(low, high, len(w)), low, high)
    i, j = np.nonzero(w)
    shared = spark.sparkContext.broadcast((len(w), i, j, w[i, j]))

    def run(batches):
        n, a, b, v = shared.value
        for pdf in batches:
            out = []
            for rho in pdf["rho"]:
                m = np.eye(n)
                m[a, b] -= rho * v
                out.append(np.linalg.slogdet(m)[1])
            yield pdf.assign(value=out)

    tasks = min(len(at), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(k, float(r)) for k, r in enumerate(at)], "k int, rho double").repartition(tasks, "k")
    found = sorted(rows.mapInPandas(run, "k int, rho double, value double").collect(), key=lambda r: r["k"])
    return fit_series(np.array([r["value"] for r in found]), low, high)


def moments(units: DataFrame, edges: DataFrame, order: int, probes: int = 50, seed: int = 7, key: str = "unit_id") -> np.ndarray:
    """tr T_j(W) for j = 0..order: probes by joins, the first five exactly.

    A probe is a column of signs by hash, so that it is the same whenever it is computed; what a
    step needs is cut to the shared checkpoint folder.
    """
    from ..operators.lags import spatial_lag

    names = [f"p{i}" for i in range(probes)]
    sign = lambda i: F.when(F.xxhash64(F.lit(seed), F.lit(i), F.col(key)) % 2 == 0, 1.0).otherwise(-1.0)
    n = units.count()
    v0 = cut(units.select(key, *[sign(i).alias(c) for i, c in enumerate(names)]))
    rename = {f"W_{c}": c for c in names}
    last, now = v0, cut(spatial_lag(v0, edges, names, key=key).select(key, *[f"W_{c}" for c in names]).withColumnsRenamed(rename))
    out = [float(n)]
    for j in range(1, order + 1):
        b = now.withColumnsRenamed({c: f"b{c}" for c in names}).withColumnRenamed(key, "_b")
        dots = v0.join(b, F.col(key) == F.col("_b")).agg(*[F.sum(F.col(c) * F.col(f"b{c}")).alias(c) for c in names]).first()
        out.append(float(np.mean([dots[c] for c in names])))
        if j < order:
            up = spatial_lag(now, edges, names, key=key).select(F.col(key).alias("_u"), *[f"W_{c}" for c in names])
            prev = last.withColumnsRenamed({c: f"l{c}" for c in names})
            new = up.join(prev, F.col("_u") == F.col(key)).select(key, *[(2 * F.col(f"W_{c}") - F.col(f"l{c}")).alias(c) for c in names])
            last, now = now, cut(new)
    traces = [float(n)] + [weights.trace_power(edges, k).first()["trace"] for k in range(1, min(order, 4) + 1)]
    exact = [traces[0], *traces[1:2]]
    if order >= 2:
        exact.append(2 * traces[2] - n)
    if order >= 3:
        exact.append(4 * traces[3] - 3 * traces[1])
    if order >= 4:
        exact.append(8 * traces[4] - 8 * traces[2] + n)
    out[: len(exact)] = exact[: order + 1]
    return np.array(out)


class Stochastic:
    def __init__(self, m: np.ndarray):
        self.m = m

    def _coefficients(self, f) -> np.ndarray:
        p = 512
        x = np.cos((np.arange(p) + 0.5) * np.pi / p)
        c = 2 / p * np.cos(np.outer(np.arange(len(self.m)), (np.arange(p) + 0.5) * np.pi / p)) @ f(x)
        c[0] /= 2
        return c

    def __call__(self, rho):
        one = lambda r: float(self._coefficients(lambda x: np.log(np.maximum(1 - r * x, 1e-12))) @ self.m)
        return np.vectorize(one)(np.asarray(rho, float))

    def slope(self, rho):
        one = lambda r: float(self._coefficients(lambda x: -x / np.maximum(1 - r * x, 1e-12)) @ self.m)
        return np.vectorize(one)(np.asarray(rho, float))


def arrays(units: DataFrame, edges: DataFrame, key: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
    """focal, neighbor (places in no particular order), weights and n; None for over ``most`` units, or 50 edges a unit."""
    ids = [r[0] for r in units.select(key).distinct().limit(most + 1).collect()]
    rows = edges.select("focal", "neighbor", "w").limit(50 * most + 1).collect() if len(ids) <= most else []
    if len(ids) > most or len(rows) > 50 * most:
        return None
    at = {u: i for i, u in enumerate(sorted(ids))}
    place = lambda k: np.array([at[r[k]] for r in rows], np.int64)
    return place(0), place(1), np.array([r[2] for r in rows], float), len(ids)


def from_arrays(graph: tuple, low: float, high: float, method: str = "auto", spark=None, eigen_most: int = 500, dense_most: int = 4000, most_cost: float = 2e11):
    """An evaluator from a graph on the driver; None where none of the exact methods can carry it."""
    from . import rational
    from .banded import Banded

    focal, neighbor, value, n = graph
    low, high = (max(low, -0.999), min(high, 0.999)) if method != "eigenvalue" else (low, high)

    def matrix() -> np.ndarray:
        if n > dense_most:
            raise ValueError(f"{n} units are too many for a dense matrix ({dense_most})")
        w = np.zeros((n, n))
        np.add.at(w, (focal, neighbor), value)
        return w

    if method == "eigenvalue" or (method == "auto" and n <= eigen_most):
        return _named(Eigen(rational.symmetrized_eigenvalues(matrix())), "eigenvalue")
    band = Banded(focal, neighbor, value, n)
    if method == "auto" and band.cost > most_cost and n > dense_most:
        return None
    if method in ("auto", "chebyshev"):
        order = order_for(low, high, n)
        at = nodes(order, low, high)
        if method == "auto" and band.cost > most_cost:
            return _named(by_nodes(spark, matrix(), low, high, order), "chebyshev")
        return _named(fit_series(_at_nodes(spark, band, at), low, high), "chebyshev")
    if method == "rational":
        return _named(rational.rational(band.log_det, low, high), method)
    if method == "spline":
        return _named(rational.Spline(band.log_det, low, high), method)
    raise ValueError(f"unknown method {method!r}")


def _at_nodes(spark, band, at: np.ndarray, here: float = 2e10) -> np.ndarray:
    """Determinants at the nodes: on the driver while they are cheap, dealt to tasks otherwise."""
    if spark is None or band.cost * len(at) <= here:
        return band.log_dets(at)
    shared = spark.sparkContext.broadcast(band)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(value=[shared.value.log_det(r) for r in pdf["rho"]])

    tasks = min(len(at), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(k, float(r)) for k, r in enumerate(at)], "k int, rho double").repartition(tasks, "k")
    found = sorted(rows.mapInPandas(run, "k int, rho double, value double").collect(), key=lambda r: r["k"])
    return np.array([r["value"] for r in found])


def log_det(units: DataFrame, edges: DataFrame, low: float, high: float, key: str = "unit_id", method: str = "auto", eigen_most: int = 500, dense_most: int = 4000, sparse_most: int = 60_000, order: int = 30, probes: int = 50):
    """An evaluator; methods: auto, eigenvalue, chebyshev, rational, spline, stochastic.

    ``auto`` takes eigenvalues up to ``eigen_most`` units; up to ``sparse_most`` a Chebyshev series
    through exact determinants, of block tridiagonal form where the graph is narrow enough and of
    dense matrices up to ``dense_most`` otherwise; and stochastic moments, whose error is that of
    ``probes`` random vectors, beyond. The method that was taken is the evaluator's ``method``.
    """
    if method != "stochastic":
        graph = arrays(units, edges, key, sparse_most)
        found = None if graph is None else from_arrays(graph, low, high, method, units.sparkSession, eigen_most, dense_most)
        if found is not None:
            return found
        if method != "auto":
            raise ValueError(f"over {sparse_most} units are too many for {method}")
    if not edges.filter("w < 0").isEmpty() or not has_edges_back(edges):
        raise ValueError("stochastic moments need a W with real eigenvalues")
    return _named(Stochastic(moments(units.select(key).distinct(), edges, order, probes, key=key)), "stochastic")


def _named(evaluator, method: str):
    evaluator.method = method
    return evaluator


def has_edges_back(edges: DataFrame) -> bool:
    """Whether every edge has one back: what a standardized symmetric graph has, and with it real eigenvalues."""
    back = edges.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"))
    return edges.select("focal", "neighbor").exceptAll(back).isEmpty()


def flow_log_det(eigenvalues: np.ndarray, rd: float, ro: float, rw: float) -> float:
    """log of the flow filter's determinant, exactly, from the eigenvalues of W."""
    a, b = eigenvalues[:, None], eigenvalues[None, :]
    return float(np.log(np.abs(1 - ro * a - rd * b - rw * a * b)).sum())
