"""Spatial, panel and flow lags: joins of edges with keyed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spatial_lag(values: DataFrame, edges: DataFrame, columns: list[str], key: str = "unit_id", over: list[str] | None = None, transpose: bool = False, prefix: str = "W_") -> DataFrame:
    """``values`` and W times each of ``columns``, all in one join; 0 where there is no neighbour.

    ``over`` names further keys (a period, a draw) that stay fixed. With ``transpose`` it is W'.
    The edges are pre-aggregated nowhere and broadcast by nobody: Catalyst picks the join.
    """
    over = over or []
    focal, neighbor = ("neighbor", "focal") if transpose else ("focal", "neighbor")
    graph = edges.select(F.col(focal).alias("_to"), F.col(neighbor).alias("_from"), F.col("w").alias("_w"))
    carried = values.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(over)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    keys = ["_to", *[f"_o{i}" for i in range(len(over))]]
    sums = [F.sum(F.col("_w") * F.col(f"_v{i}")).alias(f"_s{i}") for i in range(len(columns))]
    lagged = graph.join(carried, F.col("_from") == F.col("_key")).groupBy(*keys).agg(*sums)
    match = F.col(key) == F.col("_to")
    for i, c in enumerate(over):
        match = match & (F.col(c) == F.col(f"_o{i}"))
    out = [F.coalesce(f"_s{i}", F.lit(0.0)).alias(f"{prefix}{c}") for i, c in enumerate(columns)]
    return values.join(lagged, match, "left").select(*[F.col(c) for c in values.columns], *out)


def panel_lag(panel: DataFrame, edges: DataFrame, columns: list[str], prefix: str = "W_") -> DataFrame:
    """The spatial lag within each period of (unit, time, ...)."""
    return spatial_lag(panel, edges, columns, key="unit", over=["time"], prefix=prefix)


def time_lag(panel: DataFrame, columns: list[str], prefix: str = "L_", drop_first: bool = True) -> DataFrame:
    """Each column one period earlier; rows without the period before go (or, kept, have nulls).

    The period before is the table's: a unit that lacks it has no lag, instead of an older one.
    """
    periods = panel.select(F.col("time").alias("_time")).distinct().withColumn("_p", F.row_number().over(Window.orderBy("_time")))
    order = Window.partitionBy("unit").orderBy("time")
    numbered = panel.join(F.broadcast(periods), F.col("time") == F.col("_time"))
    near = F.lag("_p", 1).over(order) == F.col("_p") - 1
    out = numbered.select(*panel.columns, *[F.when(near, F.lag(c, 1).over(order)).alias(f"{prefix}{c}") for c in columns], F.coalesce(near, F.lit(False)).alias("_near"))
    return (out.filter("_near") if drop_first else out).drop("_near")


def flow_lags(flows: DataFrame, edges: DataFrame, column: str | list[str] = "y", extra: list[str] | None = None) -> DataFrame:
    """``flows`` and Wd, Wo, Ww times ``column`` (or each of several, in the same two joins): over
    destinations, origins and both in turn."""
    extra, columns = extra or [], [column] if isinstance(column, str) else column
    dest = spatial_lag(flows, edges, columns, key="dest", over=["origin", *extra], prefix="Wd_")
    both = spatial_lag(dest, edges, [*columns, *[f"Wd_{c}" for c in columns]], key="origin", over=["dest", *extra], prefix="Wo_")
    return both.withColumnsRenamed({f"Wo_Wd_{c}": f"Ww_{c}" for c in columns})


def within(panel: DataFrame, columns: list[str], effects: str, prefix: str = "D_") -> DataFrame:
    """Columns less their means over units, periods, or both (plus the overall mean)."""
    unit, time, every = Window.partitionBy("unit"), Window.partitionBy("time"), ["unit", "time", "two_way", "pooled"]
    if effects not in every:
        raise ValueError(f"effects must be one of {every}")
    if effects != "two_way":
        window = {"unit": unit, "time": time}.get(effects)
        return panel.select("*", *[(F.col(c) - F.avg(c).over(window) if window else F.col(c)).alias(prefix + c) for c in columns])
    # The overall mean is one row: a window without keys would put all rows into one task.
    overall = panel.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    joined = panel.crossJoin(F.broadcast(overall))
    out = [(F.col(c) - F.avg(c).over(unit) - F.avg(c).over(time) + F.col(f"_m_{c}")).alias(prefix + c) for c in columns]
    return joined.select(*panel.columns, *out)


def absorbed(panel: DataFrame, columns: list[str], effects: str) -> DataFrame:
    """(variable, absorbed): columns that the within transform takes to 0."""
    moved = within(panel, columns, effects)
    both = moved.agg(*[F.struct(F.max(F.abs("D_" + c)).alias("d"), F.max(F.abs(c)).alias("m")).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), (F.col(f"{c}.d") <= 1e-10 * F.greatest(F.col(f"{c}.m"), F.lit(1.0))).alias("absorbed")) for c in columns]))
    return both.select(rows.alias("r")).select("r.*")


def mundlak(panel: DataFrame, columns: list[str], prefix: str = "mean_") -> DataFrame:
    """Unit means of columns as further columns."""
    unit = Window.partitionBy("unit")
    return panel.select("*", *[F.avg(c).over(unit).alias(prefix + c) for c in columns])


def unit_sums(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(unit, columns): sums over each unit's periods."""
    return panel.groupBy("unit").agg(*[F.sum(c).alias(c) for c in columns])


def wide(panel: DataFrame, column: str, periods: list[int]) -> DataFrame:
    """One row for each unit, one column for each period."""
    return panel.groupBy("unit").pivot("time", periods).agg(F.first(column)).select("unit", *[F.col(str(p)).alias(f"{column}_{p}") for p in periods])


def flow_design(units: DataFrame, columns: list[str], origin_columns: list[str] | None = None, distances: DataFrame | None = None, log_distance: bool = True, key: str = "unit_id") -> DataFrame:
    """(origin, dest, intercept, intra_indicator, dest_*, orig_*, intra_*[, log_distance])."""
    out_columns = columns if origin_columns is None else origin_columns
    o = units.select(F.col(key).alias("origin"), *[F.col(c).alias(f"orig_{c}") for c in out_columns])
    d = units.select(F.col(key).alias("dest"), *[F.col(c).alias(f"dest_{c}") for c in columns])
    same = (F.col("origin") == F.col("dest")).cast("double")
    out = o.crossJoin(d).select(
        "origin", "dest", F.lit(1.0).alias("intercept"), same.alias("intra_indicator"), *[f"dest_{c}" for c in columns], *[f"orig_{c}" for c in out_columns],
        *[(same * F.col(f"dest_{c}")).alias(f"intra_{c}") for c in columns],
    )
    if distances is None:
        return out
    d = F.log1p("distance").alias("log_distance") if log_distance else F.col("distance").alias("dist")
    return out.join(distances, ["origin", "dest"]).select(*out.columns, d)


def flow_weights(edges: DataFrame, units: DataFrame, kind: str, key: str = "unit_id") -> DataFrame:
    """(origin, dest, origin_to, dest_to, w): I x W ("destination"), W x I ("origin") or W x W ("network").

    For inspection; lags never form these.
    """
    same = units.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("v"))
    graph = edges.select(F.col("focal").alias("a"), F.col("neighbor").alias("b"), F.col("w").alias("v"))
    o, d = {"destination": (same, graph), "origin": (graph, same), "network": (graph, graph)}[kind]
    o, d = o.toDF("origin", "origin_to", "_x"), d.toDF("dest", "dest_to", "_y")
    return o.crossJoin(d).select("origin", "dest", "origin_to", "dest_to", (F.col("_x") * F.col("_y")).alias("w"))


def live_cells(flows: DataFrame, column: str = "y", levels: tuple[str, ...] = ("origin", "dest")) -> DataFrame:
    """Cells of levels that have any count."""
    for level in levels:
        some = flows.groupBy(level).agg(F.sum(column).alias("_s")).filter("_s > 0").select(level)
        flows = flows.join(some, level, "left_semi")
    return flows


def left_censor(df: DataFrame, column: str, at: float) -> DataFrame:
    """``column`` at ``at`` at least, and whether it was censored."""
    return df.withColumns({column: F.greatest(F.col(column), F.lit(at)), "censored": F.col(column) <= at})


def nesting(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parent) of a strict nesting; raises where a child has several parents."""
    found = df.groupBy(child).agg(F.count_distinct(parent).alias("_n"), F.min(parent).alias(parent))
    if not found.filter("_n <> 1").isEmpty():
        raise ValueError(f"{child} is not nested in {parent}")
    return found.select(child, parent)


def are_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: whether all values are whole and not negative."""
    return df.agg(F.bool_and((F.col(column) >= 0) & (F.col(column) == F.floor(column))).alias("counts"))


def column_kinds(panel: DataFrame, columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """(variable, over_units, over_time): whether a column varies between units of a period, and in time within a unit."""
    def spread(by: str) -> DataFrame:
        return panel.groupBy(by).agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns]).agg(*[F.max(c).alias(c) for c in columns])

    size = panel.agg(*[F.max(F.abs(c)).alias(c) for c in columns])
    parts = [d.select(*[F.col(c).alias(f"{n}_{i}") for i, c in enumerate(columns)]) for n, d in (("u", spread("time")), ("t", spread("unit")), ("m", size))]
    row = parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # a row each
    varies = lambda n, i: F.col(f"{n}_{i}") > tolerance * F.greatest(F.col(f"m_{i}"), F.lit(1.0))
    cells = [F.struct(F.lit(c).alias("variable"), varies("u", i).alias("over_units"), varies("t", i).alias("over_time")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def has_level(df: DataFrame, columns: list[str], tolerance: float = 1e-10) -> bool:
    """Whether one of the columns is constant (and not 0): the level of an outcome."""
    row = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return any(v["a"] is not None and v["b"] - v["a"] <= tolerance * max(1.0, abs(v["b"])) and v["b"] != 0 for v in row)


def flow_term_kinds(flows: DataFrame, columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """(variable, kind): constant, destination (the same for all origins), origin, or pair."""
    def varies(by: str | None) -> DataFrame:
        inside = flows.groupBy(*([by] if by else [])).agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns])
        return inside.agg(*[F.max(c).alias(c) for c in columns])

    parts = [varies(b).select(*[(F.col(c) > tolerance).alias(f"{n}_{i}") for i, c in enumerate(columns)]) for n, b in (("a", None), ("d", "dest"), ("o", "origin"))]
    row = parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))
    kind = lambda i: F.when(~F.col(f"a_{i}"), "constant").when(~F.col(f"d_{i}"), "destination").when(~F.col(f"o_{i}"), "origin").otherwise("pair")
    cells = [F.struct(F.lit(c).alias("variable"), kind(i).alias("kind")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def kept_cells(flows: DataFrame, mask: DataFrame) -> DataFrame:
    """Flows of the cells that ``mask`` (origin, dest[, keep]) keeps; cells that it lacks go, and so do null marks."""
    kept = mask.filter("keep") if "keep" in mask.columns else mask
    return flows.join(kept.select("origin", "dest").distinct(), ["origin", "dest"], "left_semi")
