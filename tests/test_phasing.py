"""Classes of phased pairs, origins and cluster events on rows worked by hand."""

import math

import pytest
from pyspark.sql import functions as F

from spotweave.functions import prob
from spotweave.operators import features, phasing

COUNTS = "germline array<string>, g1h1 long, g1h2 long, g2h1 long, g2h2 long, mh1 long, mh2 long"


def classified(spark, rows):
    df = spark.createDataFrame(rows, COUNTS).withColumn("dp", F.expr("g1h1 + g1h2 + g2h1 + g2h2 + mh1 + mh2")).withColumn("mut_allele", F.expr("mh1 + mh2"))
    out = phasing.mutation_origin(phasing.phase_classify(df)).collect()
    return {(tuple(r.germline), r.g1h1, r.g1h2, r.g2h1, r.g2h2, r.mh1, r.mh2): (r.haplo, r.annotated_type, r.mut_origin) for r in out}


@pytest.mark.parametrize(
    "row, want",
    [
        ((["A"], 6, 1, 0, 0, 0, 2), (2, "heterzygous", None)),  # both lean, apart
        ((["A"], 3, 0, 0, 0, 0, 1), (4, "artifacts", None)),  # the same with 4 molecules: the depth of the pair counts, not of a row
        ((["A"], 4, 0, 0, 0, 0, 1), (2, "heterzygous", None)),
        ((["A"], 1, 6, 0, 0, 0, 2), (4, "artifacts", None)),  # both lean to the same side
        ((["A"], 5, 1, 0, 0, 0, 2), (3, "mut_mosaic", "A")),  # five times is no lean; the mutant leans to the lesser side
        ((["A"], 5, 1, 0, 0, 0, 1), (4, "artifacts", None)),  # one mutant molecule
        ((["A"], 5, 5, 0, 0, 0, 3), (4, "artifacts", None)),  # no greater side
        ((["A"], 5, 3, 0, 0, 3, 0), (4, "artifacts", None)),  # the mutant is on the greater side
        ((["A"], 3, 5, 0, 0, 12, 2), (3, "mut_mosaic", "A")),
        ((["A"], 3, 5, 0, 0, 10, 2), (4, "artifacts", None)),  # the mutant doesn't lean
        ((["A", "C"], 9, 1, 1, 9, 2, 0), (3, "mut_mosaic", "A")),
        ((["A", "C"], 9, 1, 1, 9, 0, 2), (3, "mut_mosaic", "C")),
        ((["A", "C"], 1, 9, 9, 1, 2, 0), (3, "mut_mosaic", "C")),
        ((["A", "C"], 9, 1, 1, 9, 1, 0), (4, "artifacts", None)),  # one mutant molecule
        ((["A", "C"], 9, 1, 1, 9, 2, 1), (4, "artifacts", None)),  # the mutant doesn't lean
        ((["A", "C"], 9, 1, 9, 1, 2, 0), (4, "artifacts", None)),  # the germline alleles are on one side
        ((["A", "C"], 9, 1, 5, 1, 0, 2), (4, "artifacts", None)),
    ],
)
def test_classes(spark, row, want):
    assert classified(spark, [row])[(tuple(row[0]), *row[1:])] == want


def test_counts_of_pairs(spark):
    h = spark.createDataFrame([("c", 1, 9, b, s, n) for b, s, n in [("A", "G", 5), ("A", "T", 4), ("C", "T", 2), ("G", "T", 7), ("A", "C", 1)]] + [("c", 2, 9, "A", "G", 3), ("c", 3, 9, "A", "G", 3)], "chrom string, pos long, snp_pos long, base string, snp_base string, n long")
    gate = spark.createDataFrame([("c", 1, 9, "G", "T", True), ("c", 2, 9, "G", "T", True), ("c", 3, 9, "G", None, False)], "chrom string, pos long, snp_pos long, h1 string, h2 string, balanced boolean")
    sites = spark.createDataFrame([("c", 1, ["A", "A"], "C"), ("c", 2, ["A"], "T"), ("c", 3, ["A"], "T")], "chrom string, pos long, germline array<string>, mutant string")
    (r,) = phasing.phase_counts(h, gate, sites).collect()  # without a mutant molecule, or balance, a pair goes
    assert (r.pos, r.germline, r.g1h1, r.g1h2, r.g2h1, r.g2h2, r.mh1, r.mh2, r.dp, r.mut_allele) == (1, ["A"], 5, 4, 0, 0, 0, 2, 11, 2)


def test_cluster_events(spark):
    sites = spark.createDataFrame([("c", p, "A", "C") for p in (1, 5, 8)], "chrom string, pos long, germline string, mutant string")
    both = [("A", "A")] * 30 + [("C", "C")] * 12 + [("A", "C")] * 6 + [("C", "A")] * 7 + [("G", "A")] * 50
    calls = [("c", p, f"m{i}", b) for i, x in enumerate(both) for p, b in zip((1, 5), x)] + [("c", 8, f"m{i}", "A") for i in range(60)]
    pairs = spark.createDataFrame([("c", 1, 5), ("c", 1, 8)], "chrom string, pos_i long, pos_j long")
    calls = spark.createDataFrame(calls, "chrom string, pos long, molecule string, base string")
    got = {(r.pos_i, r.pos_j): r for r in phasing.cluster_events(pairs, calls, sites).collect()}
    r = got[1, 5]
    chi = sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((30, 36 * 37 / 55), (6, 36 * 18 / 55), (7, 19 * 37 / 55), (12, 19 * 18 / 55)))
    assert (r.rr, r.ra, r.ar, r.aa) == (30, 6, 7, 12) and r.p == pytest.approx(math.erfc(math.sqrt(chi / 2))) and r.event
    assert (got[1, 8].aa, got[1, 8].p, got[1, 8].event) == (0, 1, False)  # Fisher's test of cells of 0
    assert sorted(x.pos for x in phasing.cluster_event_sites(phasing.cluster_events(pairs, calls, sites)).collect()) == [1, 5]
    assert phasing.cluster_events(pairs, calls, sites, least=56).count() == 0


def test_yates_moves_no_cell_past_its_expectation(spark):
    got = spark.createDataFrame([(10.0, 10.0, 10.0, 11.0)], "a double, b double, c double, d double").select(prob.chi_square_yates(*map(F.col, "abcd")).alias("p")).first()
    assert got.p == 1


def test_site_spatial(spark):
    schema = "chrom string, pos long, depth long, vaf double, mut_prob double, l_mosaic double"
    rows = [("c", 1, 4, 0.5, 0.9, 0.2), ("c", 1, 4, 0.0, 0.9, 0.9), ("c", 1, 4, 0.25, 0.1, 0.9), ("c", 1, 4, 1.0, 0.6, None)]  # constant depth
    rows += [("c", 2, d, 0.0, 0.1, 0.1) for d in (1, 2, 3)] + [("c", 3, 10, 0.3, 0.5, 0.5), ("c", 3, 20, 0.2, 0.6, 0.6), ("c", 3, 30, 0.31, 0.6, 0.6)]
    got = {r.pos: r for r in features.agg_site_spatial(spark.createDataFrame(rows, schema)).collect()}
    a = got[1]
    assert (a.num_spots, a.num_mut_spots, a.r2) == (3, 2, 1) and [a.mut_rate, a.mut_rate_prob, a.mut_rate_likelihood, a.mut_rate_vaf] == pytest.approx([1 / 3, 2 / 3, 2 / 3, 2 / 3])
    assert a.vaf_mean_mut == a.vaf_median_mut == pytest.approx(0.375)
    assert got[2].r2 == 0 and got[2].vaf_mean_mut is None
    x, y = [10, 20, 30], [3, 4, 10]  # 30 * 0.31 = 9.3 counts as 10
    sxy = sum((a - 20) * (b - sum(y) / 3) for a, b in zip(x, y))
    assert got[3].r2 == pytest.approx(sxy**2 / (200 * sum((b - sum(y) / 3) ** 2 for b in y))) and got[3].mut_rate == pytest.approx(2 / 3)
