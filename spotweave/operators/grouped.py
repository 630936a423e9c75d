"""Statistics of a site's spots or reads that need its rows in order: numpy over one group at a time.

A group is a site's spots or its reads after sample_fixed_n, so it has a bound that does not grow with the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def average_ranks(x: np.ndarray) -> np.ndarray:
    values, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[inverse]


def ranksum(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-sided p by the normal approximation, and the rank-biserial correlation 2 U / (n m) - 1."""
    n, m = len(x), len(y)
    if not n or not m:
        return math.nan, math.nan
    s = average_ranks(np.concatenate([x, y]))[:n].sum()
    z = (s - n * (n + m + 1) / 2) / math.sqrt(n * m * (n + m + 1) / 12)
    return 2 * normal_sf(abs(z)), 2 * (s - n * (n + 1) / 2) / (n * m) - 1


def signed_rank(d: np.ndarray) -> tuple[float, float]:
    """Two-sided p of Wilcoxon's signed-rank test, zeros left out, and (W+ - W-) / (W+ + W-)."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return math.nan, math.nan
    r = average_ranks(np.abs(d))
    plus, minus = r[d > 0].sum(), r[d < 0].sum()
    _, ties = np.unique(np.abs(d), return_counts=True)
    spread = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    z = (min(plus, minus) - n * (n + 1) / 4) / math.sqrt(spread) if spread > 0 else 0.0
    return min(1.0, 2 * normal_sf(abs(z))), (plus - minus) / (plus + minus)


def ks_two_sample(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The largest distance of two samples' distributions, and its asymptotic p."""
    n, m = len(x), len(y)
    if not n or not m:
        return math.nan, math.nan
    at = np.concatenate([x, y])
    d = float(np.abs(np.searchsorted(np.sort(x), at, "right") / n - np.searchsorted(np.sort(y), at, "right") / m).max())
    root = math.sqrt(n * m / (n + m))
    t = (root + 0.12 + 0.11 / root) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)) if t > 0.2 else 1.0
    return d, min(1.0, max(0.0, p))


def lda_direction(xy: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Fisher's direction of two groups in the plane."""
    a, b = xy[group], xy[~group]
    within = sum((np.cov(g.T, bias=True) * len(g) if len(g) > 1 else np.zeros((2, 2))) for g in (a, b)) + 1e-9 * np.eye(2)
    w = np.linalg.solve(within, a.mean(0) - b.mean(0))
    size = np.linalg.norm(w)
    return w / size if size > 0 else np.array([1.0, 0.0])


def morans_i(xy: np.ndarray, value: np.ndarray, k: int = 4) -> tuple[float, float]:
    """Moran's I with weights of the k nearest neighbours, and its two-sided p under randomisation."""
    n = len(value)
    z = value - value.mean()
    if n < 3 or not (z**2).sum():
        return math.nan, math.nan
    k = min(k, n - 1)
    d = ((xy[:, None] - xy[None]) ** 2).sum(2).astype(float)
    np.fill_diagonal(d, np.inf)
    w = np.zeros((n, n))
    w[np.repeat(np.arange(n), k), np.argsort(d, 1, kind="stable")[:, :k].ravel()] = 1 / k
    s0 = w.sum()
    i = n / s0 * (z @ w @ z) / (z @ z)
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(1) + w.sum(0)) ** 2).sum()
    b2 = n * (z**4).sum() / (z @ z) ** 2
    mean = -1 / (n - 1)
    if n < 4:
        return float(i), math.nan
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - mean**2
    return float(i), 2 * normal_sf(abs(i - mean) / math.sqrt(var)) if var > 0 else math.nan


def spatial_tests(spots: DataFrame, threshold: float = 0.5) -> DataFrame:
    """KS along Fisher's direction, Moran's I and the paired Wilcoxon test of each site's spots (x, y, depth, alt, mut_prob)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("barcode")
        xy, mutated = pdf[["x", "y"]].to_numpy(float), (pdf["mut_prob"] > threshold).to_numpy()
        ks, ks_p = math.nan, math.nan
        if 1 < mutated.sum() < len(pdf):
            along = xy @ lda_direction(xy, mutated)
            ks, ks_p = ks_two_sample(along[mutated], along[~mutated])
        moran, moran_p = morans_i(xy, mutated.astype(float))
        scale = lambda v: (v - v.mean()) / v.std() if v.std() > 0 else v * 0.0
        p, rbc = signed_rank(scale(pdf["depth"].to_numpy(float)) - scale(pdf["alt"].to_numpy(float)))
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[:1], "pos": pdf["pos"].iloc[:1], "ks": ks, "ks_p": ks_p, "moran": moran, "moran_p": moran_p, "wilcoxon_p": p, "wilcoxon_rbc": rbc})

    return spots.groupBy("chrom", "pos").applyInPandas(run, "chrom string, pos long, ks double, ks_p double, moran double, moran_p double, wilcoxon_p double, wilcoxon_rbc double")


def read_tests(reads: DataFrame, value: str) -> DataFrame:
    """Rank-sum test of a read value between alternative and reference reads of each site."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alt = pdf["is_alt"].to_numpy(bool)
        x = pdf[value].to_numpy(float)
        p, rbc = ranksum(x[alt], x[~alt])
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[:1], "pos": pdf["pos"].iloc[:1], "p": p, "rbc": rbc})

    return reads.groupBy("chrom", "pos").applyInPandas(run, "chrom string, pos long, p double, rbc double")


def dbscan_subdomain(spots: DataFrame, eps: float = 2.0) -> DataFrame:
    """Parts of each cluster whose spots (barcode, cluster, x, y) are connected by steps of at most eps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("barcode").reset_index(drop=True)
        cells: dict[tuple[int, int], list[int]] = {}
        xy = pdf[["x", "y"]].to_numpy(float)
        for i, (a, b) in enumerate(np.floor(xy / eps).astype(int)):
            cells.setdefault((a, b), []).append(i)
        part = np.full(len(pdf), -1)
        for i in range(len(pdf)):
            if part[i] >= 0:
                continue
            part[i], todo = part.max() + 1, [i]
            while todo:
                j = todo.pop()
                a, b = np.floor(xy[j] / eps).astype(int)
                for c in ((a + da, b + db) for da in (-1, 0, 1) for db in (-1, 0, 1)):
                    for k in cells.get(c, ()):
                        if part[k] < 0 and ((xy[j] - xy[k]) ** 2).sum() <= eps * eps:
                            part[k] = part[i]
                            todo.append(k)
        return pdf.assign(domain=pdf["cluster"] + "_" + pd.Series(part).astype(str))[["barcode", "cluster", "domain"]]

    return spots.groupBy("cluster").applyInPandas(run, "barcode string, cluster string, domain string")
