"""Cross-products in one aggregate, and what follows from them on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, columns: list[str], weight: Column | None = None) -> DataFrame:
    """(row_var, col_var, value): sums of products of all pairs of columns, in a single pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    term = lambda a, b: F.col(a) * F.col(b) * (weight if weight is not None else 1.0)
    sums = df.agg(*[F.sum(term(a, b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(r).alias("row_var"), F.lit(c).alias("col_var"), F.col(f"s{k}").alias("value")) for k, (a, b) in enumerate(pairs) for r, c in dict.fromkeys([(a, b), (b, a)])]
    return sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


class Gram:
    """A labelled symmetric matrix of cross-products, and the number of rows behind it."""

    def __init__(self, labels: list[str], matrix: np.ndarray, n: int):
        self.labels, self.matrix, self.n = labels, matrix, n
        self.at = {c: i for i, c in enumerate(labels)}

    @classmethod
    def of(cls, df: DataFrame, columns: list[str], weight: Column | None = None) -> Gram:
        """Only k x k sums reach the driver. They are rounded to 12 digits, so that the order in
        which partial sums meet doesn't reach seeded chains."""
        cells = gram(df.withColumn("_one", F.lit(1.0)), [*columns, "_one"], weight).collect()
        labels = [*columns, "_one"]
        at, m = {c: i for i, c in enumerate(labels)}, np.zeros((len(labels), len(labels)))
        for r in cells:
            m[at[r["row_var"]], at[r["col_var"]]] = float(f"{r['value'] or 0.0:.12g}")
        n = int(round(m[-1, -1])) if weight is None else df.count()
        return cls(labels, m, n)

    def get(self, rows: list[str], columns: list[str]) -> np.ndarray:
        return self.matrix[np.ix_([self.at[c] for c in rows], [self.at[c] for c in columns])]

    def combine(self, maps: dict[str, dict[str, float]]) -> Gram:
        """Cross-products of linear combinations of the columns."""
        t = np.zeros((len(maps), len(self.labels)))
        for i, terms in enumerate(maps.values()):
            for c, v in terms.items():
                t[i, self.at[c]] += v
        return Gram(list(maps), t @ self.matrix @ t.T, self.n)


def ols(g: Gram, y: str, xs: list[str]) -> tuple[np.ndarray, float, float]:
    """Coefficients, residual sum of squares, and that over n."""
    xx, xy = g.get(xs, xs), g.get(xs, [y])[:, 0]
    b = np.linalg.solve(xx, xy)
    rss = max(float(g.get([y], [y])[0, 0] - xy @ b), 0.0)
    return b, rss, rss / g.n


def residual_cross(g: Gram, xs: list[str], a: list[str], b: list[str]) -> np.ndarray:
    """A' M B with M the projection off ``xs``."""
    return g.get(a, b) - g.get(a, xs) @ np.linalg.solve(g.get(xs, xs), g.get(xs, b))
