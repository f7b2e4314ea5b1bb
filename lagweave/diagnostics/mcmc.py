"""Convergence of chains: split rank-normalized R-hat and effective sample sizes.

Draws are bounded by their own number (chains x draws), not by the data, so each parameter's draws
are handled in one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _quantile_normal(p: np.ndarray) -> np.ndarray:
    """The Normal quantile by Newton steps on the distribution function, from a logistic start."""
    from ..functions.special import ndtr

    x = np.log(p / (1 - p)) / 1.702
    for _ in range(6):
        x = x - (ndtr(x) - p) / np.maximum(np.exp(-x * x / 2) / np.sqrt(2 * np.pi), 1e-12)
    return x


def split(x: np.ndarray) -> np.ndarray:
    """Chains cut in halves."""
    half = x.shape[1] // 2
    return np.concatenate([x[:, :half], x[:, -half:]]) if half else x


def ranked(x: np.ndarray) -> np.ndarray:
    flat = x.ravel()
    order = np.argsort(np.argsort(flat, kind="stable"), kind="stable") + 1
    return _quantile_normal((order - 0.375) / (len(flat) + 0.25)).reshape(x.shape)


def r_hat(x: np.ndarray) -> float:
    n = x.shape[1]
    within = x.var(1, ddof=1).mean()
    between = n * x.mean(1).var(ddof=1)
    return float(np.sqrt(((n - 1) / n * within + between / n) / within)) if within > 0 else float("nan")


def effective(x: np.ndarray) -> float:
    """Effective sample size by Geyer's initial monotone sequence over all chains."""
    m, n = x.shape
    if n < 4 or x.std() == 0:
        return float("nan")
    centred = x - x.mean(1, keepdims=True)
    f = np.fft.rfft(centred, 2 * n, axis=1)
    cov = np.fft.irfft(f * f.conj(), 2 * n, axis=1)[:, :n].real / n
    within = cov[:, 0].mean() * n / (n - 1)
    total = within * (n - 1) / n + (x.mean(1).var(ddof=1) if m > 1 else 0.0)
    rho = 1 - (within - cov.mean(0)) / total
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
    end = int(np.argmax(pairs < 0)) if (pairs < 0).any() else len(pairs)
    tau = -1 + 2 * np.minimum.accumulate(pairs[: max(end, 1)]).sum()
    return float(m * n / max(tau, 1 / np.log10(m * n)))


def report(long: DataFrame) -> DataFrame:
    """(label, r_hat, ess_bulk, ess_tail, hdi_width) from (chain, draw, label, value)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = split(pdf.sort_values(["chain", "draw"]).pivot(index="chain", columns="draw", values="value").to_numpy())
        z = ranked(x)
        folded = ranked(np.abs(x - np.median(x)))
        low, high = np.quantile(x, [0.05, 0.95])
        tails = min(effective((x <= low).astype(float)), effective((x >= high).astype(float)))
        flat = np.sort(x.ravel())
        k = int(np.floor(0.95 * len(flat)))
        width = float((flat[k:] - flat[: len(flat) - k]).min()) if k < len(flat) else 0.0
        return pd.DataFrame([(pdf["label"].iloc[0], max(r_hat(z), r_hat(folded)), effective(z), tails, width)], columns=["label", "r_hat", "ess_bulk", "ess_tail", "hdi_width"])

    return long.groupBy("label").applyInPandas(run, "label string, r_hat double, ess_bulk double, ess_tail double, hdi_width double")
