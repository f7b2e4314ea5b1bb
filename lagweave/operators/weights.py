"""Spatial weights as edge lists (focal, neighbor, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-6
ROOK = [(0, 1), (1, 0), (0, -1), (-1, 0)]
QUEEN = [*ROOK, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def ring(spark: SparkSession, n: int) -> DataFrame:
    """Each of 0..n-1 with the one before and the one after it, weights one half."""
    step = F.explode(F.array(F.lit(1), F.lit(n - 1)))
    return spark.range(n).select(F.col("id").alias("focal"), step.alias("s")).select("focal", F.pmod(F.col("focal") + F.col("s"), F.lit(n)).alias("neighbor"), F.lit(0.5).alias("w"))


def lattice(spark: SparkSession, rows: int, columns: int | None = None, contiguity: str = "rook") -> DataFrame:
    """Contiguity of a grid, id = row * columns + column, row-standardized."""
    columns = columns or rows
    if rows < 1 or columns < 1 or rows * columns < 2:
        raise ValueError("a lattice needs two cells at least")
    moves = {"rook": ROOK, "queen": QUEEN}[contiguity]
    r0, c0 = F.floor(F.col("id") / columns), F.pmod("id", F.lit(columns))
    inside = lambda r, c: r.between(0, rows - 1) & c.between(0, columns - 1)
    degree = F.lit(0)
    for dr, dc in moves:  # a cell's number of neighbours is arithmetic: no shuffle
        degree = degree + inside(F.col("r") + dr, F.col("c") + dc).cast("int")
    cells = spark.range(rows * columns).select("id", r0.alias("r"), c0.alias("c"))
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in moves]))
    dealt = cells.select("id", "r", "c", degree.alias("n"), offsets.alias("o"))
    r, c = F.col("r") + F.col("o.dr"), F.col("c") + F.col("o.dc")
    near = dealt.filter(inside(r, c))
    return near.select(F.col("id").alias("focal"), (r * columns + c).alias("neighbor"), (F.lit(1.0) / F.col("n")).alias("w"))


def same_group(units: DataFrame, group: str, key: str = "unit_id") -> DataFrame:
    """Units of one group as each other's neighbours, row-standardized; nulls have none."""
    a = units.select(F.col(key).alias("focal"), F.col(group).alias("_g"))
    b = units.select(F.col(key).alias("neighbor"), F.col(group).alias("_h"))
    pairs = a.join(b, (F.col("_g") == F.col("_h")) & (F.col("focal") != F.col("neighbor")))
    return row_standardize(pairs.select("focal", "neighbor", F.lit(1.0).alias("w")))


def _celled(points: DataFrame, size: float, key: str) -> tuple[DataFrame, DataFrame]:
    """Points by grid cell, and points dealt to their own and the eight cells around."""
    cell = lambda v: F.floor(F.col(v) / size)
    own = points.select(F.col(key).alias("neighbor"), F.col("px").alias("qx"), F.col("py").alias("qy"), cell("px").alias("cx"), cell("py").alias("cy"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    dealt = points.select(F.col(key).alias("focal"), "px", "py", steps.alias("s"))
    return own, dealt.select("focal", "px", "py", (cell("px") + F.col("s.a")).alias("cx"), (cell("py") + F.col("s.b")).alias("cy"))


def _near(points: DataFrame, size: float, key: str, among: DataFrame | None = None) -> DataFrame:
    own, dealt = _celled(points, size, key)
    if among is not None:
        dealt = dealt.join(among.select(F.col(key).alias("focal")), "focal", "left_semi")
    far = F.sqrt(F.pow(F.col("px") - F.col("qx"), 2) + F.pow(F.col("py") - F.col("qy"), 2))
    met = dealt.join(own, ["cx", "cy"]).filter(F.col("focal") != F.col("neighbor"))
    return met.select("focal", "neighbor", far.alias("d"))


def distance_band(points: DataFrame, threshold: float, key: str = "unit_id") -> DataFrame:
    """Points (key, px, py) within ``threshold`` of each other, row-standardized.

    A range join on a grid of cells as wide as the threshold: only neighbouring cells meet.
    """
    near = _near(points, threshold, key).filter(F.col("d") <= threshold)
    return row_standardize(near.select("focal", "neighbor", F.lit(1.0).alias("w")))


def k_nearest(points: DataFrame, k: int, key: str = "unit_id", size: float | None = None) -> DataFrame:
    """The k nearest points of each point (ties: the smaller key), weights 1/k.

    Points meet in grid cells. Those whose k-th neighbour is farther than a cell may have missed a
    nearer one; they are tried again with cells twice as wide, until none is left.
    """
    box = points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count(F.lit(1))).first()
    n = box[4]
    if n <= k:
        raise ValueError("k must be smaller than the number of points")
    reach = max(box[1] - box[0], box[3] - box[2], 1e-12)
    size = size or reach * ((k + 1) / n) ** 0.5
    rank = Window.partitionBy("focal").orderBy("d", "neighbor")
    found, left = None, points
    while True:
        ranked = _near(points, size, key, None if found is None else left).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k)
        full = ranked.groupBy("focal").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("most")).filter((F.col("n") == k) & ((F.col("most") <= size) | F.lit(size > reach)))
        done = ranked.join(full.select("focal"), "focal", "left_semi").select("focal", "neighbor", F.lit(1.0 / k).alias("w"))
        found = done if found is None else found.unionByName(done)
        left = left.join(full.select(F.col("focal").alias(key)), key, "left_anti")
        if size > reach or left.isEmpty():
            return found
        size *= 2


def contiguity(polygons: DataFrame, kind: str = "queen", key: str = "unit_id", digits: int = 9) -> DataFrame:
    """Neighbours of polygons (key, ring: array of struct x, y, closed or not), row-standardized.

    Queen: a shared corner; rook: a shared side between the same two corners. Corners are equal
    where they agree to ``digits`` digits. Two joins on corners or sides, no pair of polygons else.
    """
    ring = polygons.select(F.col(key).alias("_k"), F.expr(f"transform(ring, p -> concat_ws(' ', round(p.x, {digits}) + 0.0D, round(p.y, {digits}) + 0.0D))").alias("_c"))
    if kind == "queen":
        parts = ring.select("_k", F.explode("_c").alias("_s"))
    elif kind == "rook":
        closed = ring.withColumn("_c", F.when(F.element_at("_c", 1) == F.element_at("_c", -1), F.col("_c")).otherwise(F.concat("_c", F.slice("_c", 1, 1))))
        sides = F.expr("transform(sequence(1, size(_c) - 1), i -> concat_ws('|', least(_c[i - 1], _c[i]), greatest(_c[i - 1], _c[i])))")
        parts = closed.filter(F.size("_c") > 1).select("_k", F.explode(sides).alias("_s"))
    else:
        raise ValueError(f"unknown contiguity {kind!r}")
    parts = parts.distinct()
    other = parts.select(F.col("_k").alias("neighbor"), F.col("_s").alias("_o"))
    met = parts.join(other, (F.col("_s") == F.col("_o")) & (F.col("_k") != F.col("neighbor"))).select(F.col("_k").alias("focal"), "neighbor").distinct()
    return row_standardize(met.withColumn("w", F.lit(1.0)))


def resolve(spark: SparkSession, edges: DataFrame | None = None, units: DataFrame | None = None, n_side: int | None = None, kind: str = "queen", k: int = 4, key: str = "unit_id") -> DataFrame:
    """Edges as given, of a lattice of ``n_side``, of polygons (ring), or of the ``k`` nearest points (px, py)."""
    if edges is not None:
        if units is not None:
            check(edges, units, key)
        return edges
    if n_side is not None:
        return lattice(spark, n_side, contiguity=kind)
    if units is not None and "ring" in units.columns:
        return contiguity(units, kind, key)
    if units is not None and {"px", "py"} <= set(units.columns):
        return k_nearest(units, k, key)
    raise ValueError("give edges, n_side, or units with polygons or points")


def row_sums(edges: DataFrame, units: DataFrame | None = None, key: str = "unit_id") -> DataFrame:
    """(unit_id, row_sum, degree); with ``units`` also those without neighbours."""
    sums = edges.groupBy(F.col("focal").alias("unit_id")).agg(F.sum("w").alias("row_sum"), F.count(F.lit(1)).alias("degree"))
    if units is None:
        return sums
    all_units = units.select(F.col(key).alias("unit_id"))
    return all_units.join(sums, "unit_id", "left").select("unit_id", F.coalesce("row_sum", F.lit(0.0)).alias("row_sum"), F.coalesce("degree", F.lit(0)).alias("degree"))


def row_standardize(edges: DataFrame) -> DataFrame:
    """Weights divided by their row's sum; rows that sum to 0 stay."""
    total = F.sum("w").over(Window.partitionBy("focal"))
    return edges.select("focal", "neighbor", F.when(total == 0, F.col("w")).otherwise(F.col("w") / total).alias("w"))


def isolates(edges: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """Units whose weights sum to 0."""
    return row_sums(edges, units, key).filter(F.abs("row_sum") <= TOLERANCE).select("unit_id")


def is_row_standardized(edges: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """One row: whether every row that isn't an isolate's sums to 1 (never, without any edge)."""
    s = F.col("row_sum")
    near = lambda v: F.abs(s - v) <= TOLERANCE
    return row_sums(edges, units, key).agg((F.bool_and(near(1.0) | near(0.0)) & F.bool_or(near(1.0))).alias("row_standardized"))


def check(edges: DataFrame, units: DataFrame, key: str = "unit_id") -> None:
    """Raises where an edge has no unit, is given twice, or has no finite weight."""
    ids = units.select(F.col(key).alias("id"))
    for end in ("focal", "neighbor"):
        if not edges.join(ids, F.col(end) == F.col("id"), "left_anti").isEmpty():
            raise ValueError(f"an edge's {end} is not among the units")
    if not edges.groupBy("focal", "neighbor").count().filter("count > 1").isEmpty():
        raise ValueError("an edge is given twice")
    if not edges.filter(F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf"))).isEmpty():
        raise ValueError("a weight is not finite")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("neighbor").alias("focal"), F.col("focal").alias("neighbor"), "w")


def symmetrized(edges: DataFrame) -> DataFrame:
    """(W + W') / 2."""
    both = edges.unionByName(transpose(edges))
    return both.groupBy("focal", "neighbor").agg((F.sum("w") / 2).alias("w"))


def asymmetry(edges: DataFrame) -> DataFrame:
    """One row: the largest |w_ij - w_ji|."""
    back = transpose(edges).withColumn("w", -F.col("w"))
    gaps = edges.unionByName(back).groupBy("focal", "neighbor").agg(F.abs(F.sum("w")).alias("gap"))
    return gaps.agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("asymmetry"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B, as an edge list."""
    right = b.select(F.col("focal").alias("_m"), F.col("neighbor").alias("_n"), F.col("w").alias("_v"))
    paths = a.join(right, F.col("neighbor") == F.col("_m"))
    return paths.groupBy("focal", F.col("_n").alias("neighbor")).agg(F.sum(F.col("w") * F.col("_v")).alias("w"))


def trace_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: trace = tr(A B), without forming A B."""
    right = b.select(F.col("focal").alias("_m"), F.col("neighbor").alias("_n"), F.col("w").alias("_v"))
    met = a.join(right, (F.col("neighbor") == F.col("_m")) & (F.col("focal") == F.col("_n")))
    return met.agg(F.coalesce(F.sum(F.col("w") * F.col("_v")), F.lit(0.0)).alias("trace"))


def trace_power(edges: DataFrame, k: int) -> DataFrame:
    """One row: trace = tr(W^k), from the two halves of the power."""
    if k == 1:
        return edges.filter(F.col("focal") == F.col("neighbor")).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("trace"))

    def power(m: int) -> DataFrame:
        out = edges
        for _ in range(m - 1):
            out = product(out, edges)
        return out

    return trace_product(power(k // 2), power(k - k // 2))


def trace_gram(edges: DataFrame) -> DataFrame:
    """One row: trace = tr(W'W)."""
    return edges.agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("trace"))


def trace_information(edges: DataFrame) -> DataFrame:
    """One row: trace = tr(W'W + W W), the information of an omitted spatial error."""
    return trace_gram(edges).unionByName(trace_power(edges, 2)).agg(F.sum("trace").alias("trace"))


def fill_ratio(edges: DataFrame) -> DataFrame:
    """One row: entries of W W over entries of W, a forecast of what factors would fill in."""
    return product(edges, edges).agg(F.count(F.lit(1)).alias("n2")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n1"))).select((F.col("n2") / F.col("n1")).alias("fill_ratio"))
