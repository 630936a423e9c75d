"""Signature weights against plain minimisation, and tails of distributions against exact fractions."""

from fractions import Fraction
from math import comb, lgamma, exp

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import prob
from spotweave.operators import signatures


def plain(g, b):
    w, rate = np.zeros(len(b)), 1 / np.linalg.eigvalsh(g)[-1]
    for _ in range(100_000):
        v = w + rate * (b - g @ w)
        v = np.maximum(v, 0)
        if v.sum() > 1:
            u = np.sort(v)[::-1]
            v = np.maximum(v - max((u[: j + 1].sum() - 1) / (j + 1) for j in range(len(u))), 0)
        w = v
    return w


@pytest.mark.parametrize("seed", range(4))
def test_least_squares_agrees_with_projected_steps(seed):
    rng = np.random.default_rng(seed)
    s = rng.random((50, 3))
    s /= s.sum(0)
    t = s @ np.array([[0.5, 0.2, 0.3], [0.9, 0, 0.4], [0, 0, 0], [0.05, 0.6, -0.3]][seed]) + rng.normal(0, 0.001, 50)
    got = signatures.least_squares(s.T @ s, s.T @ t)
    assert np.allclose(got, plain(s.T @ s, s.T @ t), atol=1e-6) and got.min() >= 0 and got.sum() <= 1 + 1e-9


def test_weights_and_context_weights(spark):
    known = [("a", "S1", 3.0), ("b", "S1", 1.0), ("b", "S2", 2.0), ("c", "S2", 2.0), ("d", "S3", 5.0)]
    spectrum = [("a", 45), ("b", 35), ("c", 20), ("z", 0)]  # 0.6 S1 + 0.4 S2
    sig, spec = spark.createDataFrame(known, "context string, signature string, value double"), spark.createDataFrame(spectrum, "context string, n long")
    w = signatures.signature_weights(spec, sig)
    assert w["S1"] == pytest.approx(0.6) and w["S2"] == pytest.approx(0.4) and w["S3"] == 0
    got = {r.context: r.rweigh for r in signatures.context_weights(sig, w, 4).collect()}
    assert got["a"] == pytest.approx(0.25 / 0.45) and got["b"] == pytest.approx(0.25 / 0.35) and got["d"] == float("inf")
    assert signatures.signature_weights(spec.where("false"), sig) == {"S1": 0, "S2": 0, "S3": 0}
    assert signatures.signature_weights(spec, sig.where("false")) == {}


def test_tails(spark):
    rows = [(k, n, p) for n in (1, 10, 400, 20_000) for p in (0.003, 0.5, 0.97) for k in (0, 1, n // 3, n // 2, n - 1, n, n + 1) if k >= 0]
    got = spark.createDataFrame(rows, "k long, n long, p double").select("*", prob.binom_sf(F.col("k"), F.col("n"), F.col("p")).alias("sf")).collect()
    for r in got:
        if r.n <= 400:
            q = Fraction(r.p)
            want = float(sum(comb(r.n, i) * q**i * (1 - q) ** (r.n - i) for i in range(max(r.k, 0), r.n + 1)))
            assert r.sf == pytest.approx(want, rel=1e-9, abs=1e-300)
        assert 0 <= r.sf <= 1
    beta = lambda a, b: lgamma(a) + lgamma(b) - lgamma(a + b)
    pmf = lambda i, n, a=0.107, b=47.58: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + beta(i + a, n - i + b) - beta(a, b))
    pairs = [(k, n) for n in (1, 5, 100, 900) for k in (0, 1, 2, n // 2, n, n + 1)]
    for r in spark.createDataFrame(pairs, "k long, n long").select("*", prob.beta_binomial_sf(F.col("k"), F.col("n")).alias("sf")).collect():
        assert r.sf == pytest.approx(sum(pmf(i, r.n) for i in range(r.k, r.n + 1)), rel=1e-8)  # small tails keep their digits
