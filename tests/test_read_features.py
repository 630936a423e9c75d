"""Rank sums, adjusted p-values and read features on rows worked by hand."""

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from spotweave.functions import prob
from spotweave.operators import read_features as R

READS = "read_id long, chrom string, ref_start long, mapq int, is_reverse boolean, seq string, quals array<int>, cigar array<struct<op:int,len:int>>, cb string, ub string, nm int, nh int"


def test_error_function(spark):
    at = [0.0, 1e-9, 1e-4, 0.049, 0.051, 0.7, 2.5, 6.0, 6.3, 11.0, 25.0]
    got = spark.createDataFrame([(x,) for x in at], "x double").select("x", prob.erfc(F.col("x")).alias("e"), prob.normal_sf(-F.col("x")).alias("s")).collect()
    for r in got:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-13) and r.s == pytest.approx(NormalDist().cdf(r.x), abs=1e-15)


def test_adjusted_values(spark):
    p = [0.01, None, 0.04, 0.03, 0.04, 0.5]
    df = spark.createDataFrame([(x, p) for x in p], "p double, every array<double>")
    got = [r.q for r in df.select(prob.bh_adjusted(F.col("p"), F.col("every")).alias("q")).collect()]
    want = [0.05, None, 0.05, 0.05, 0.05, 0.5]
    assert all(a is b is None or a == pytest.approx(b) for a, b in zip(got, want, strict=True))


def brute(x, y):
    both = sorted(x + y)
    rank = {v: (both.index(v) + 1 + len(both) - both[::-1].index(v)) / 2 for v in both}
    n, m = len(x), len(y)
    r = sum(rank[v] for v in x)
    z = (r - n * (n + m + 1) / 2) / math.sqrt(n * m * (n + m + 1) / 12)
    return z, 2 * (r - n * (n + 1) / 2) / (n * m) - 1


def test_rank_sums_of_counts(spark):
    rng = random.Random(1)
    x, y = [rng.choice([1.0, 2.0, 2.5, 9.0]) for _ in range(30)], [rng.choice([2.0, 2.5, 7.0]) for _ in range(21)]
    rows = [("a", v, x.count(v), y.count(v)) for v in {*x, *y}] + [("b", 1.0, 3, 0), ("c", 1.0, 2, 3)]
    df = spark.createDataFrame(rows, "k string, value double, x long, y long")
    z, rbc = brute(x, y)
    got = {(k, r.k): r for k, g in (("two", F.lit(False)), ("one", F.lit(True))) for r in R.rank_sums(df, ["k"], g).collect()}
    assert set(got) == {("two", "a"), ("two", "c"), ("one", "a"), ("one", "c")}  # b has an empty sample
    assert got["two", "a"].p == pytest.approx(2 * NormalDist().cdf(-abs(z))) and got["one", "a"].p == pytest.approx(NormalDist().cdf(-z)) and got["two", "a"].rbc == pytest.approx(rbc)
    assert got["two", "c"].p == 1 and got["two", "c"].rbc == 0


def read(i, start, cigar, seq, cb="B", ub="U", reverse=False, nm=1, nh=1, qual=30):
    return (i, "chr1", start, 255, reverse, seq, [qual + k % 5 for k in range(len(seq))], cigar, cb, ub, nm, nh)


def test_observations(spark):
    reads = [
        read(1, 100, [(5, 4), (4, 2), (0, 8), (4, 1)], "nnACGTACGTn"),  # hard and soft clips
        read(2, 100, [(0, 4), (2, 3), (0, 4)], "ACGTACGT", reverse=True),  # 104 to 106 deleted
        read(3, 100, [(0, 4), (1, 2), (0, 6)], "ACGTnnACGTAC"),  # two bases inserted behind 103: 104 and 105 count as gaps
        read(4, 100, [(0, 8)], "ACGTACGT", cb=None),
        read(5, 100, [(0, 8)], "ACGTACGT", qual=41),
    ]
    variants = spark.createDataFrame([("chr1", p, "A", "C") for p in (103, 105, 106, 107)], "chrom string, pos long, ref string, alt string")
    got = {(r.read_id, r.pos): r for r in R.observations(spark.createDataFrame(reads, READS), variants).collect()}
    assert set(got) == {(1, 103), (1, 105), (1, 106), (1, 107), (2, 103), (2, 105), (2, 106), (2, 107), (3, 103), (3, 105), (3, 106), (3, 107)}
    a = got[1, 103]
    assert (a.base, a.qual, a.next_qual, a.query, a.sequenced, a.softclip, a.n_indels, a.left, a.deleted) == ("G", 34, 30, 8, 7, 3, 0, 100, False) and a.end_share == pytest.approx(2 / 8)
    assert got[1, 107].base == "G" and got[2, 103].end_share == pytest.approx(6 / 8) and got[2, 103].base == "G"
    assert [got[2, p].deleted for p in (103, 105, 106, 107)] == [False, True, True, True] and got[2, 105].base is None
    assert [got[3, p].deleted for p in (103, 105, 106, 107)] == [False, True, True, False] and got[3, 107].base == "G"
    assert got[3, 103].n_indels == 1 and got[2, 107].next_qual is None


def test_read_features(spark):
    rows = []
    for i in range(40):
        base = "A" if i < 24 else "C" if i < 38 else "T"
        rows.append(("chr1", 7, "A", "C", i, f"B{i % 4}", f"U{i % 10}", False, base, 20 + i % 7 + 5 * (base == "A"), 30, 2 if base == "C" else 1, 255 if i % 3 else 3, 1 + i % 2, i % 5 == 0, 0, 11 * (i % 8 == 0), i % 6 == 0, i % 9, 9 - i % 9, (i % 9) / 10))
    rows.append((*rows[0][:4], 99, "B0", "U0", True, None, None, None, 1, 255, 1, False, 0, 0, 1, 3, 4, 0.3))
    rows.append((*("chr1", 9, "G", "T"), 100, "B0", "U0", False, "G", 30, None, 1, 255, 1, False, 0, 0, 0, 3, 4, 0.3))
    schema = "chrom string, pos long, ref string, alt string, read_id long, barcode string, umi string, deleted boolean, base string, qual int, next_qual int, mismatches int, mapq int, mappers int, is_reverse boolean, left long, softclip int, n_indels int, query int, sequenced int, end_share double"
    got = {r.pos: r for r in R.read_features(spark.createDataFrame([(*r[:17], int(r[17]), *r[18:]) for r in rows], schema)).collect()}
    r = got[7]
    x, y = [float(v[9]) for v in rows[:24]], [float(v[9]) for v in rows[24:38]]
    z, rbc = brute(x, y)
    assert r.baseq_p == pytest.approx(NormalDist().cdf(-z)) and r.baseq_rbc == pytest.approx(rbc)
    assert r.dp == 41 and r.indel_proportion_for_site == pytest.approx(1 / 41)
    assert r.alt_mismatches_mean == 1 and r.ref_mismatches_mean == 1 and r.mismatches_rbc == 0  # one mismatch is the mutation
    assert r.alt_multi_map_prop == pytest.approx(sum(v[13] != 1 for v in rows[24:38]) / 14)
    ps = [getattr(r, f"{t}_p") for t in R.TESTS]
    order = sorted(range(14), key=lambda i: ps[i])
    q = {i: min(ps[j] * 14 / (order.index(j) + 1) for j in order[order.index(i) :]) for i in order}
    assert all(getattr(r, f"{t}_p_adj") == pytest.approx(min(1, q[i])) for i, t in enumerate(R.TESTS))
    s = got[9]
    assert s.baseq_p is None and s.softclip_prop_p is None and s.multi_mapper_p == 1 and s.alt_softclip_prop is None and s.ref_softclip_prop == 0 and s.alt_UMI_avg_consistence is None and s.alt_querypos_num == 0


def test_exact_test_of_any_depth(spark):
    rng = random.Random(5)
    rows = [(0, 0, 0, 0), (5, 0, 0, 0), (0, 5, 7, 0), (2000, 0, 0, 2000), *[tuple(rng.randint(0, m) for _ in range(4)) for m in (3, 40, 900) for _ in range(12)]]
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def whole(a, b, c, d):
        logs = {k: choose(a + b, k) + choose(c + d, a + c - k) - choose(a + b + c + d, a + c) for k in range(max(0, a - d), min(a + b, a + c) + 1)}
        return min(1, sum(math.exp(x) for x in logs.values() if x <= logs[a] + 1e-7))

    deep = [(3e9, 3e9, 3e9, 3e9), (4e9, 2e9, 2e9, 4e9)]  # more tables than an array holds
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows + deep], "a double, b double, c double, d double")
    got = [r.p for r in df.select(prob.fisher_two_sided(*map(F.col, "abcd")).alias("p")).collect()]
    assert all(p == pytest.approx(whole(*r), rel=1e-9, abs=1e-300) for p, r in zip(got, rows))
    assert got[len(rows) :] == [pytest.approx(1), 0]
