"""Traces of G = W (I - rW)^-1 and its products with W, exactly for small graphs and by probes beyond.

Keys: g = tr G, gg = tr G^2, gtg = tr G'G, wg = tr WG, wtg = tr W'G. With ``centred`` they are
those of J G (J takes a period's mean away): what time effects leave.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.logdet import dense, index_of
from .lags import spatial_lag
from .weights import trace_gram, trace_power


def of_matrix(w: np.ndarray, r: float, centred: bool = False) -> dict[str, float]:
    g = np.linalg.solve(np.eye(len(w)) - r * w, w)
    if centred:
        g, w = g - g.mean(0), w - w.mean(0)
    return {"g": float(np.trace(g)), "gg": float((g * g.T).sum()), "gtg": float((g * g).sum()), "wg": float((w * g.T).sum()), "wtg": float((w * g).sum())}


def resolvent_traces(units: DataFrame, edges: DataFrame, r: float, key: str = "unit_id", centred: bool = False, dense_most: int = 2000, probes: int = 64, seed: int = 5) -> dict[str, float]:
    """The traces at ``r``; for over ``dense_most`` units by ``probes`` random signs carried through joins."""
    n = units.select(key).distinct().count()
    if n <= dense_most:
        return of_matrix(dense(edges, index_of(units, key, dense_most), dense_most), r, centred)
    if r == 0.0 and not centred:
        square, cross = trace_power(edges, 2).first()["trace"], trace_gram(edges).first()["trace"]
        return {"g": trace_power(edges, 1).first()["trace"], "gg": square, "gtg": cross, "wg": square, "wtg": cross}
    return _probed(units.select(key).distinct(), edges, r, key, centred, probes, seed)


def _probed(units: DataFrame, edges: DataFrame, r: float, key: str, centred: bool, probes: int, seed: int) -> dict[str, float]:
    """Hutchinson's estimate: means over signs z of z'Gz and the like. Columns are probes."""
    from ..dgp.simulate import filtered

    names = [f"z{i}" for i in range(probes)]
    signs = [F.when(F.xxhash64(F.lit(seed), F.lit(i), F.col(key)) % 2 == 0, 1.0).otherwise(-1.0).alias(c) for i, c in enumerate(names)]
    z = units.select(key, *signs)

    def through(df: DataFrame, transpose: bool, prefix: str) -> DataFrame:
        """W (I - rW)^-1 z, or with ``transpose`` W' (I - rW')^-1 z, as prefixed columns."""
        graph = edges.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"), "w") if transpose else edges
        moved = filtered(df.select(key, *names), graph, names, r, key)
        lagged = spatial_lag(moved, graph, names, key=key)
        return lagged.select(F.col(key).alias(f"_{prefix}"), *[F.col(f"W_{c}").alias(f"{prefix}{c}") for c in names])

    def plain(transpose: bool, prefix: str) -> DataFrame:
        return spatial_lag(z, edges, names, key=key, transpose=transpose).select(F.col(key).alias(f"_{prefix}"), *[F.col(f"W_{c}").alias(f"{prefix}{c}") for c in names])

    table = z
    for side, prefix in ((through(z, False, "g"), "g"), (through(z, True, "t"), "t"), (plain(False, "w"), "w"), (plain(True, "v"), "v")):
        table = table.join(side, F.col(key) == F.col(f"_{prefix}"))
    pairs = {"g": ("", "g"), "gg": ("t", "g"), "gtg": ("g", "g"), "wg": ("v", "g"), "wtg": ("w", "g")}
    means = {f"m_{p}{c}": F.avg(f"{p}{c}") for p in ("", "g", "t", "w", "v") for c in names} if centred else {}
    dots = {f"d_{k}_{c}": F.sum(F.col(f"{a}{c}") * F.col(f"{b}{c}")) for k, (a, b) in pairs.items() for c in names}
    row = table.agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in (dots | means).items()]).first()
    out = {}
    for k, (a, b) in pairs.items():
        values = [row[f"d_{k}_{c}"] - (row["n"] * row[f"m_{a}{c}"] * row[f"m_{b}{c}"] if centred else 0.0) for c in names]
        out[k] = float(np.mean(values))
    return out
