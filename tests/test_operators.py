"""Operators on hand-made rows, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions import genome, prob
from spotweave.operators import events, features, genotype, grouped, intervals, reads
from spotweave.sources import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("x", [0.5, 1.0, 2.5, 30.0, 999.5])
def test_lgamma(spark, x):
    assert one(spark, prob.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("k,n,p", [(0, 5, 0.2), (1, 5, 0.2), (3, 40, 0.003), (6, 5, 0.2), (20, 40, 0.5)])
def test_binom_sf(spark, k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1))
    assert one(spark, prob.binom_sf(F.lit(float(k)), F.lit(float(n)), F.lit(p))) == pytest.approx(want, rel=1e-9)


def test_genome_functions(spark):
    assert one(spark, genome.context_dna96(F.lit("A"), F.lit("G"), F.lit("T"), F.lit("C"))) == "G[C>A]T"
    assert one(spark, genome.homopolymer(F.lit("ACAAAAAAGTTTTTTTC"))) == "A"
    assert one(spark, genome.homopolymer(F.lit("ACGT"))) is None
    assert one(spark, genome.gc_content(F.lit("GCgc"))) == 0.5


def test_pileup(spark):
    rows = spark.createDataFrame([("c", 1, "A", "^I.,+12AGAGAGAGAGAGt-1cT$*"), ("c", 2, "G", "<<<")], "chrom string, pos long, ref string, bases string")
    got = [tuple(r) for r in text.parse_pileup_bases(rows).orderBy("pos").collect()]
    assert got == [("c", 1, "A", 2, 2, 0, 0, 1, 1), ("c", 2, "G", 0, 0, 0, 0, 0, 0)]


def test_umi_consensus_prefers_what_is_seen(spark):
    e = spark.createDataFrame([("c", 1, "A", "b", "u", "G", 30, False)] * 3 + [("c", 1, "A", "b", "v", "A", 35, True)], "chrom string, pos long, ref string, barcode string, umi string, base string, qual int, is_reverse boolean")
    got = {r.umi: (r.allele, r.phred) for r in events.umi_consensus(events.agg_umi(e)).collect()}
    assert got["u"][0] == "G" and got["v"][0] == "A" and 0 < got["v"][1] <= 60


def test_candidates_at_thresholds(spark):
    rows = [("c", 1, "A", 95, 5, 0, 0, 100), ("c", 2, "A", 25, 4, 0, 0, 29), ("c", 3, "N", 95, 5, 0, 0, 100), ("c", 4, "A", 25, 5, 0, 0, 30)]
    got = {r.pos: (r.is_somatic, r.is_error) for r in events.classify_candidates(spark.createDataFrame(rows, "chrom string, pos long, ref string, nA long, nT long, nC long, nG long, depth long")).collect()}
    assert got == {1: (True, True), 4: (True, False)}


def test_range_join_is_a_nested_loop(spark):
    rng = np.random.default_rng(1)
    points = [(f"c{int(a)}", int(b)) for a, b in zip(rng.integers(0, 2, 60), rng.integers(0, 5000, 60), strict=True)]
    spans = [(f"c{int(a)}", int(b), int(b + n), f"g{i}") for i, (a, b, n) in enumerate(zip(rng.integers(0, 2, 30), rng.integers(0, 5000, 30), rng.integers(0, 3000, 30), strict=True))]
    p, s = spark.createDataFrame(points, "chrom string, pos long"), spark.createDataFrame(spans, "chrom string, start long, end long, gene string")
    got = sorted((r.chrom, r.pos, r.gene) for r in intervals.range_join(p, s).collect())
    assert got == sorted((c, x, g) for c, x in points for d, a, b, g in spans if c == d and a <= x < b)
    pairs = intervals.interval_join(s, s.withColumnRenamed("gene", "gene2")).count()
    full = [x for x in spans if x[1] < x[2]]
    assert pairs == sum(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for x in full for y in full)


def test_asof(spark):
    p = spark.createDataFrame([("a", 5), ("a", 10), ("a", 30), ("b", 1)], "chrom string, pos long")
    t = spark.createDataFrame([("a", 6, 12, 0.5), ("a", 8, 20, 0.7)], "chrom string, start long, end long, score double")
    assert {(r.chrom, r.pos): r.score for r in intervals.asof_join(p, t).collect()} == {("a", 5): 0.0, ("a", 10): 0.7, ("a", 30): 0.0, ("b", 1): None}


def test_merge_and_sessions(spark):
    i = spark.createDataFrame([("c", 0, 10), ("c", 15, 20), ("c", 26, 30)], "chrom string, start long, end long")
    assert sorted((r.start, r.end) for r in intervals.merge_intervals(i, ["chrom"], 5).collect()) == [(0, 20), (26, 30)]
    s = spark.createDataFrame([("c", x) for x in (1, 11, 22)], "chrom string, pos long")
    assert sorted((r.start, r.end, r.sites) for r in intervals.win_gap_sessionize(s).collect()) == [(1, 11, 2), (22, 22, 1)]
    assert [(r.pos_i, r.pos_j) for r in intervals.near_pairs(s).collect()] == [(1, 11)]


def test_posterior_sums_and_prior(spark):
    p = spark.createDataFrame([("A", 0.0, 0.9, 0.8, 0.1)], "ref string, fA double, fT double, fC double, fG double")
    r = genotype.prior_normalise(p).first()
    assert r.fA + r.fT + r.fC + r.fG == pytest.approx(1) and r.fA == pytest.approx(0.01)


def test_bh(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    got = {r.p: r.p_adj for r in features.bh_fdr(spark.createDataFrame([(1, x) for x in p], "g int, p double"), ["g"]).collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.03] == pytest.approx(0.16 / 3) and got[0.5] == 0.5 and got[None] is None


def test_rank_statistics():
    p, r = grouped.ranksum(np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))
    assert r == -1 and p == pytest.approx(0.0495, abs=1e-3)
    assert grouped.ks_two_sample(np.array([1.0, 2]), np.array([3.0, 4]))[0] == 1
    assert grouped.signed_rank(np.array([1.0, -2, 3, 0]))[1] == pytest.approx((4 - 2) / 6)


def test_vcf_lines(spark):
    v = spark.createDataFrame([("chr10", 5, "A", "G", "PASS", 7, 0.25), ("chr2", 9, "C", "T", "PASS", None, 0.5), ("chr2", 1, "C", "T", "LOW_VAF", 1, 0.5)], "chrom string, pos long, ref string, alt string, filter string, dp int, vaf double")
    got = [r.line for r in text.vcf_lines(v, {"DP": ("dp", "Integer"), "VAF": ("vaf", "Float")}).collect()]
    assert got[0].startswith("chr2\t9\t.\tC\tT\t.\tPASS\tVAF=0.5") and "DP=7;VAF=0.25" in got[1]


def test_explode_reads(spark):
    """Clips, insertions, deletions and skips; repeated sites, missing tags, short qualities, an unknown base."""
    kind = "read_id long, chrom string, ref_start long, is_reverse boolean, seq string, quals array<int>, cigar array<struct<op:int,len:int>>, cb string, ub string"
    rows = [
        (1, "c", 253, False, "TTACGTA", [1, 2, 3, 4, 5, 6, 7], [(4, 2), (0, 2), (1, 1), (2, 3), (7, 2)], "b", "u"),  # positions 254, 255 and 259, 260
        (2, "c", 253, True, "ANG", [41, 9], [(0, 3)], "b", "u"),  # too good, unknown, without a quality
        (3, "c", 253, False, "AAA", [9, 9, 9], [(0, 3)], None, "u"),
        (4, "c", 253, False, "AC", [9, 8], [(0, 1), (3, 1000), (8, 1)], "b", "u"),
        (5, "c", 253, False, "A", [9], None, "b", "u"),
        (6, "c", 253, False, None, None, [(0, 2)], "b", "u"),
    ]
    sites = spark.createDataFrame([("c", p, "A") for p in (254, 255, 255, 256, 259, 260, 1255)] + [("d", 254, "A")], "chrom string, pos long, ref string")
    got = sorted((r.read_id, r.pos, r.base, r.qual) for r in reads.explode_reads(spark.createDataFrame(rows, kind), sites).collect())
    assert got == [(1, 254, "A", 3), (1, 255, "C", 4), (1, 259, "T", 6), (1, 260, "A", 7), (4, 254, "A", 9), (4, 1255, "C", 8)]
    assert reads.explode_reads(spark.createDataFrame([], kind), sites).count() == 0


def test_homopolymer_reads_whole_texts(spark, tmp_path):
    import random

    from spotweave.plans.queries import QUERIES

    def plainly(x):
        middle, found = (len(x) + 1) / 2, []
        for i in range(1, len(x) - 4):
            if x[i - 1 : i + 5] in ("AAAAAA", "TTTTTT", "CCCCCC", "GGGGGG"):
                found.append((max(i - middle, middle - i - 5, 0), "ATCG".index(x[i - 1]), x[i - 1]))
        return min(found)[2] if found else None

    rng = random.Random(2)
    texts = ["".join(rng.choice("ATCGX") * rng.choice((1, 1, 1, 5, 6, 7, 13)) for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["X" * 3000 + "GGGGGG" + "X" * 2000, "", None]
    rows = [(3 * i + 1, x) for i, x in enumerate(texts)]  # ids to which the query adds a C
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.base for r in QUERIES["homopolymer"](spark, str(tmp_path)).collect()}
    assert got == {i: x if x is None else plainly(x + "C") for i, x in rows}
