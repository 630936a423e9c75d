"""Probability kernels as Column expressions, so that they stay in whole-stage code."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spotweave.functions.expressions import bind

# Lanczos coefficients for g = 7, n = 9 (public numerical tables).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """ln gamma(x) for x >= 0.5."""
    z = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(total)


def ln_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def ln_beta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def phred_to_q(phred: Column) -> Column:
    """Probability that a base of this quality is right."""
    return 1 - F.pow(F.lit(10.0), -phred / 10)


def miss_to_phred(miss: Column) -> Column:
    """Quality of a probability of error; 40 where it vanishes."""
    return F.when(miss < 1e-16, F.lit(40)).otherwise(F.ceil(F.round(-F.log10(miss) * 10, 9))).cast("int")


def _tail(first: Column, steps: Column, ratio: Callable[[Column], Column]) -> Column:
    """first + first * ratio(1) + first * ratio(1) * ratio(2) + ..., with `steps` further terms."""
    begin = F.struct(first.alias("t"), first.alias("s"))
    places = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(x: Column, i: Column) -> Column:
        return bind(x["t"] * ratio(i), lambda t: F.struct(t.alias("t"), (x["s"] + t).alias("s")))

    return F.aggregate(places, begin, step, lambda x: x["s"])


def binom_sf(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), 0 < p < 1: the smaller tail, term from term, as far as terms don't vanish.

    From k away from the mean, terms 10 sqrt(n) further on are below e^-200 of the first.
    """
    k, n = k.cast("double"), n.cast("double")
    at = lambda i: F.exp(ln_choose(n, i) + i * F.log(p) + (n - i) * F.log(1 - p))
    far = F.ceil(10 * F.sqrt(n)) + 50
    odds = p / (1 - p)
    upper = _tail(at(k), F.least(n - k, far), lambda i: (n - k - i + 1) / (k + i) * odds)
    lower = _tail(at(k - 1), F.least(k - 1, far), lambda i: (k - i) / (n - k + i + 1) / odds)
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(k > n * p, F.least(F.lit(1.0), upper)).otherwise(F.greatest(F.lit(0.0), 1 - lower))


def binom_two_sided(k: Column, n: Column) -> Column:
    """Two-sided exact test of k in n against one half."""
    return F.when(2 * k == n, 1.0).otherwise(F.least(F.lit(1.0), 2 * binom_sf(F.greatest(k, n - k), n, F.lit(0.5))))


def beta_binomial_sf(alt: Column, depth: Column, a: float = 0.107, b: float = 47.58) -> Column:
    """P(X >= alt) of a beta-binomial count: the smaller tail, term from term."""
    k, n = alt.cast("double"), depth.cast("double")
    at = lambda i: F.exp(ln_choose(n, i) + _ln_beta_small(i + a, n - i + b) - _ln_beta_small(F.lit(a), F.lit(b)))
    upper = _tail(at(k), n - k, lambda i: (n - k - i + 1) * (k + i - 1 + a) / ((k + i) * (n - k - i + b)))
    lower = _tail(at(k - 1), k - 1, lambda i: (k - i) * (n - k + i + b) / ((n - k + i + 1) * (k - i - 1 + a)))
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(k > n * a / (a + b), F.least(F.lit(1.0), upper)).otherwise(F.greatest(F.lit(0.0), 1 - lower))


def _ln_beta_small(a: Column, b: Column) -> Column:
    """ln Beta for a > 0: ln gamma(a) is ln gamma(a + 1) - ln a."""
    return lgamma(a + 1) - F.log(a) + lgamma(b) - (lgamma(a + b + 1) - F.log(a + b))


def erfc(x: Column) -> Column:
    """The complementary error function to double precision, for x >= 0: the trapezoidal rule of step 1/2 with its pole's residue."""
    step, terms = 0.5, 13
    total = sum((F.exp(F.lit(-((k * step) ** 2))) / (x * x + (k * step) ** 2) for k in range(1, terms + 1)), 0.5 / (x * x))
    far = 2 * step / math.pi * x * F.exp(-x * x) * total
    residue = F.when(x < math.pi / step, 2 / (1 - F.exp(2 * math.pi / step * F.least(x, F.lit(math.pi / step))))).otherwise(0.0)
    near = x - x * x * x * (1 / 3 - x * x * (1 / 10 - x * x * (1 / 42 - x * x / 216)))  # the two parts cancel at 0
    return F.when(x < 0.05, 1 - 2 / math.sqrt(math.pi) * near).otherwise(far + residue)


def normal_sf(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution."""
    tail = erfc(F.abs(z) / math.sqrt(2)) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def bh_adjusted(p: Column, every: Column) -> Column:
    """Benjamini-Hochberg's value of p among the array `every`; nulls count for nothing and stay null."""
    known = F.array_sort(F.filter(every, lambda x: x.isNotNull()))
    scaled = lambda k: F.transform(k, lambda x, i: F.struct(x.alias("p"), (x * F.size(k) / (i + 1)).alias("q")))
    return F.when(p.isNotNull(), bind(known, lambda k: F.least(F.lit(1.0), F.array_min(F.transform(F.filter(scaled(k), lambda s: s["p"] >= p), lambda s: s["q"])))))


def log10_sum(parts: list[Column]) -> Column:
    """log10 of a sum of powers of ten."""
    most = F.greatest(*parts)
    return most + F.log10(sum((F.pow(F.lit(10.0), p - most) for p in parts), F.lit(0.0)))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Exact test of the table (a, b), (c, d): all tables with the same margins that are no likelier, up to rounding.

    Terms come from one another and are divided by their sum. By Hoeffding's bound, tables further than sqrt(373 n) from the mean, n the
    least margin, have less than e^-746, which is 0 as a double; they are not listed, so the work grows with the root of the counts.
    """
    row, other, col = a + b, c + d, a + c
    half = F.ceil(F.sqrt(373 * F.least(row, other, col, b + d))) + 2
    middle = row * col / F.greatest(row + other, F.lit(1))
    first = F.greatest(F.floor(middle) - half, col - other, F.lit(0)).cast("long")
    last = F.least(F.floor(middle) + 1 + half, row, col).cast("long")
    margins = F.struct(*[x.cast("double").alias(n) for n, x in (("a", a), ("row", row), ("other", other), ("col", col))], first.alias("first"), last.alias("last"))

    def tail(m: Column) -> Column:
        at = lambda k: ln_choose(m["row"], k) + ln_choose(m["other"], m["col"] - k) - ln_choose(m["row"] + m["other"], m["col"])
        begin = F.struct(at(m["first"].cast("double")).alias("log"), F.lit(0.0).alias("all"), F.lit(0.0).alias("tail"))
        more = lambda k: F.log((m["row"] - k) * (m["col"] - k) / ((k + 1) * (m["other"] - m["col"] + k + 1)))  # noqa: E731  null behind the last table
        own = F.aggregate(F.slice(F.sequence(m["first"], m["last"]), F.lit(1), (m["a"] - m["first"]).cast("int")), begin["log"], lambda l, k: l + more(k))  # the same sum as the table's own below

        def step(x: Column, k: Column, limit: Column) -> Column:
            return F.struct((x["log"] + more(k)).alias("log"), (x["all"] + F.exp(x["log"])).alias("all"), F.when(x["log"] <= limit, x["tail"] + F.exp(x["log"])).otherwise(x["tail"]).alias("tail"))

        p = bind(own + 1e-7, lambda limit: F.aggregate(F.sequence(m["first"], m["last"]), begin, lambda x, k: step(x, k, limit), lambda x: x["tail"] / x["all"]))
        return F.when(m["a"].between(m["first"], m["last"]), p).when(m["a"].isNotNull(), 0.0)

    return F.least(F.lit(1.0), bind(margins, tail))


def chi_square_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """p of the chi-square test of the table (a, b), (c, d) with Yates' correction, that moves no cell past its expectation; margins above 0."""
    n, row, other, left, right = a + b + c + d, a + b, c + d, a + c, b + d
    away = F.abs(a * d - b * c) / n  # the distance of each cell from its expectation
    moved = F.greatest(away - 0.5, F.lit(0.0))
    statistic = moved * moved * n * n * n / (row * other * left * right)
    return erfc(F.sqrt(statistic / 2))
