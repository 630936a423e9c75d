"""Shares of known error signatures in a spectrum, and what they make of a context.

The spectrum is fitted as a mixture of signatures by least squares, weights at least 0 and at most 1 in all. The fit needs the
signatures' products with each other and with the spectrum only: one aggregate over contexts gives that small matrix, and the
constrained minimum is found among the solutions for each set of signatures that are in use.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signatures of a fit at most: all their subsets are solved.
MOST_SIGNATURES = 12


def shares(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with `value` divided by its sum over the rows of equal keys (over all, without keys); 0 where that is 0."""
    total = rows.groupBy(*keys).agg(F.sum(value).cast("double").alias("_total"))
    joined = rows.join(total, keys) if keys else rows.crossJoin(F.broadcast(total))  # total is one row
    return joined.withColumn(value, F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(0.0)).drop("_total")


def least_squares(gram: np.ndarray, product: np.ndarray) -> np.ndarray:
    """w of the least w'Gw - 2 w'b with w >= 0 and sum(w) <= 1."""
    k = len(product)
    best, least = np.zeros(k), 0.0
    for size in range(1, k + 1):
        for used in combinations(range(k), size):
            g, b = gram[np.ix_(used, used)], product[list(used)]
            free = np.linalg.lstsq(g, b, rcond=None)[0]
            edge = np.linalg.lstsq(np.block([[g, np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]]), np.append(b, 1.0), rcond=None)[0][:size]
            for w in (free, edge):
                if w.min() >= -1e-12 and w.sum() <= 1 + 1e-9:
                    w = np.maximum(w, 0)
                    cost = w @ g @ w - 2 * w @ b
                    if cost < least - 1e-15:
                        best, least = np.zeros(k), cost
                        best[list(used)] = w
    return best


def signature_weights(spectrum: DataFrame, signatures: DataFrame, cutoff: float = 0.06) -> dict[str, float]:
    """The weight of each signature in a spectrum; weights under `cutoff` become 0.

    spectrum: (context, n); signatures: (context, signature, value), of which both are taken as shares. Contexts that only
    one side has count as 0 on the other.
    """
    shared = shares(signatures, ["signature"], "value")
    names = [r["signature"] for r in shared.select("signature").distinct().orderBy("signature").limit(MOST_SIGNATURES + 1).collect()]
    if len(names) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} signatures")
    if not names:
        return {}
    wide = shared.groupBy("context").agg(*[F.coalesce(F.sum(F.when(F.col("signature") == n, F.col("value"))), F.lit(0.0)).alias(f"s{i}") for i, n in enumerate(names)])
    joined = wide.join(shares(spectrum.groupBy("context").agg(F.sum("n").alias("n")), [], "n"), "context", "left")
    k = len(names)
    sums = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)] + [F.coalesce(F.sum(F.col(f"s{i}") * F.col("n")), F.lit(0.0)) for i in range(k)]
    row = np.array(joined.agg(*sums).first(), float)
    found = least_squares(row[: k * k].reshape(k, k), row[k * k :])
    return {n: float(w) if w >= cutoff else 0.0 for n, w in zip(names, found, strict=True)}


def context_weights(signatures: DataFrame, weights: dict[str, float], contexts: int = 192) -> DataFrame:
    """(context, rweigh): the even share of a context over its share in the mixture; infinite where the mixture has none."""
    shared = shares(signatures, ["signature"], "value")
    weight = F.coalesce(*[F.when(F.col("signature") == n, F.lit(w)) for n, w in weights.items()], F.lit(0.0))
    mixed = shared.groupBy("context").agg(F.sum(F.col("value") * weight).alias("mixed"))
    return mixed.select("context", F.when(F.col("mixed") > 0, 1.0 / contexts / F.col("mixed")).otherwise(float("inf")).alias("rweigh"))
