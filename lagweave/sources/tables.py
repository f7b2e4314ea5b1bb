"""Spatial units, graphs, panels and flows made from keyed tables.

Every frame carries its keys; nothing here depends on row order. Graphs are edge lists
``(focal, neighbor, w)``; units are ``(unit_id, ...)``; panels ``(unit, time, ...)``; flows
``(origin, dest, ...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, region, y, x1, x2): mean balance, customers, mean squared balance in millions."""
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.avg("c_acctbal").alias("y"),
        F.count(F.lit(1)).cast("double").alias("x1"),
        (F.avg(F.col("c_acctbal") * F.col("c_acctbal")) / 1e6).alias("x2"),
    )
    nation = table(spark, sf_dir, "nation")
    joined = nation.join(per, nation["n_nationkey"] == per["c_nationkey"], "left")
    zero = F.lit(0.0)
    return joined.select(
        F.col("n_nationkey").cast("long").alias("unit_id"), F.col("n_regionkey").cast("long").alias("region"),
        *[F.coalesce(c, zero).alias(c) for c in ("y", "x1", "x2")],
    )


def nation_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, time, y, x1): order value in thousands and orders of each nation's customers by year."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("unit"), F.year("o_orderdate").cast("long").alias("time")).agg(
        (F.sum("o_totalprice") / 1000.0).alias("y"), F.count(F.lit(1)).cast("double").alias("x1")
    )


def nation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, dest, y): lines from suppliers' to customers' nations, where there are any."""
    line, supplier, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    joined = (
        line.select("l_orderkey", "l_suppkey")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    )
    return joined.groupBy(F.col("s_nationkey").cast("long").alias("origin"), F.col("c_nationkey").cast("long").alias("dest")).agg(F.count(F.lit(1)).cast("double").alias("y"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, time, y): events of each user on each day that has any."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("unit"), F.dayofyear("ts").cast("long").alias("time")).agg(F.count(F.lit(1)).cast("double").alias("y"))


def dense_flows(flows: DataFrame, units: DataFrame) -> DataFrame:
    """All origin-destination pairs of ``units``, 0 where ``flows`` has none."""
    ends = units.select(F.col("unit_id").alias("origin")).crossJoin(units.select(F.col("unit_id").alias("dest")))
    values = [c for c in flows.columns if c not in ("origin", "dest")]
    return ends.join(flows, ["origin", "dest"], "left").select("origin", "dest", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in values])


def dense_panel(panel: DataFrame, values: list[str]) -> DataFrame:
    """All unit-period cells, 0 where ``panel`` has none."""
    cells = panel.select("unit").distinct().crossJoin(panel.select("time").distinct())
    return cells.join(panel, ["unit", "time"], "left").select("unit", "time", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in values])


def panel_is_balanced(panel: DataFrame) -> DataFrame:
    """One row: rows, units, periods, balanced."""
    counted = panel.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("unit").alias("units"), F.count_distinct("time").alias("periods"))
    return counted.withColumn("balanced", F.col("n_rows") == F.col("units") * F.col("periods"))


def demo_draws(spark: SparkSession) -> DataFrame:
    """Posterior draws by a rule: (chain, draw, rho, beta0, beta1, theta1, sigma)."""
    base = spark.range(0, 4).withColumnRenamed("id", "chain").crossJoin(spark.range(0, 500).withColumnRenamed("id", "draw"))
    k = F.col("chain") * 500 + F.col("draw")
    wave = lambda m, a: (F.pmod(k * m, F.lit(2003)) / 2003.0 - 0.5) * a
    return base.select(
        "chain", "draw", (0.35 + wave(7, 0.2)).alias("rho"), (1.2 + wave(11, 0.5)).alias("beta0"),
        (-0.1 + wave(13, 0.6)).alias("beta1"), (0.3 + wave(17, 0.4)).alias("theta1"), (1.0 + wave(19, 0.3)).alias("sigma"),
    )


def from_arrays(spark: SparkSession, y, x, w, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Units (unit_id, y, covariates) and edges from arrays y (n), X (n x k) and W (n x n); raises where sizes differ or a value isn't finite."""
    import numpy as np
    import pandas as pd

    y, x, w = np.asarray(y, float).ravel(), np.atleast_2d(np.asarray(x, float)), np.asarray(w, float)
    x = x.T if x.shape[0] != len(y) and x.shape[1] == len(y) else x
    if w.shape != (len(y), len(y)) or len(x) != len(y):
        raise ValueError(f"y has {len(y)} values, X {x.shape} and W {w.shape}")
    if not (np.isfinite(y).all() and np.isfinite(x).all() and np.isfinite(w).all()):
        raise ValueError("values must be finite")
    names = names or [f"x{i + 1}" for i in range(x.shape[1])]
    units = spark.createDataFrame(pd.DataFrame({"unit_id": np.arange(len(y)), "y": y} | {c: x[:, i] for i, c in enumerate(names)}))
    focal, neighbor = np.nonzero(w)
    edges = spark.createDataFrame(pd.DataFrame({"focal": focal, "neighbor": neighbor, "w": w[focal, neighbor]}), "focal long, neighbor long, w double")
    return units, edges
