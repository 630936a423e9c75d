"""Histograms and individual genotypes against a plain reading of the rules."""

import itertools
import math
import random

import pytest

from spotweave.operators import histograms as H
from spotweave.operators import individual as I

B = "ATCG"
MU, VAF = 1e-7, 1e-5


def weighed(r, a, q, f):
    """Prior times likelihood of refhom, althom, het, mosaic; q has the list of qualities of each base."""
    nr, na = len(q[r]), len(q[a])
    choose = math.comb(nr + na, na)
    right, wrong = (lambda b: math.prod(1 - 10 ** (-x / 10) for x in q[b])), (lambda b: math.prod(10 ** (-x / 10) for x in q[b]))
    x = sum(10 ** (-v / 10) for v in q[r]) + sum(1 - 10 ** (-v / 10) for v in q[a])
    beta = math.exp(math.lgamma(x + 1) + math.lgamma(nr + na - x + 1) - math.lgamma(nr + na + 2))
    return [f[r] ** 2 * choose * right(r) * wrong(a), f[a] ** 2 * choose * wrong(r) * right(a), 2 * f[r] * f[a] * choose * 0.5 ** (nr + na), MU * choose * beta]


def expected(ref, cells, priors, most=1000, single=False):
    """(rows of candidate mutants, germline) of a site."""
    good = {b: {p: n for p, n in cells.get(b, {}).items() if p >= 20} for b in B}
    before = {b: sum(good[b].values()) for b in B}
    total = sum(before.values())
    q = {b: [p for p, n in good[b].items() for _ in range(round(n * (most / total)) if total > most else n)] for b in B}
    n = {b: len(q[b]) for b in B}
    f = {b: priors[b] or VAF for b in B}
    shown = [b for b in B if n[b]]
    if not shown or ref not in B:
        return [], None
    others = sorted((b for b in shown if b != ref), key=lambda b: (-n[b], B.index(b)))
    if len(shown) == 1:
        if not single:
            return [], None
        spare = next(b for b in B if b != shown[0])
        geno = "refhom" if shown[0] == ref else "althom"
        refs, alts = ([ref], [spare]) if geno == "refhom" else ([spare], shown)
        germline, named = ([ref] if geno == "refhom" else [ref, shown[0]]), [ref]
    else:
        w = weighed(ref, others[0], q, f)
        geno = ["refhom", "althom", "het", "refhom"][w.index(max(w))]
        if len(shown) == 2 and n[ref]:
            geno = geno if geno == "refhom" else "het"
            refs, alts, germline = [ref], others, [ref] if geno == "refhom" else [ref, others[0]]
            named = [ref]
        else:
            refs, alts = ([ref], others) if geno == "refhom" else ([ref, others[0]], others[1:])
            germline = named = refs
    rows = []
    for a in alts:
        p = [sum(x) for x in zip(*(weighed(r, a, q, f) for r in refs))]
        germ = p[0] if len(refs) > 1 else p[["refhom", "althom", "het"].index(geno)]
        mosaic = p[3] > germ
        gi = "0/1" if mosaic else {"refhom": "0/0", "althom": "1/1", "het": "0/1"}[geno]
        rows.append((",".join(named), a, "mosaic" if mosaic else "germline", p[3] / (p[3] + germ), gi, n[a] / sum(n.values())))
    return rows, (geno, ",".join(germline), ",".join(str(before[b]) for b in germline), [f[b] for b in germline])


def sites():
    rng = random.Random(5)
    out = []
    for shown in itertools.chain.from_iterable(itertools.combinations(B, k) for k in range(5)):
        for ref in B:
            for _ in range(4):
                cells = {b: {p: rng.choice([1, 2, 5, 30]) for p in rng.sample([12, 20, 25, 33, 40], rng.randint(1, 3))} for b in shown}
                out.append((ref, cells, {b: rng.choice([0.0, 0.0, 0.3, 0.9]) for b in B}))
    out.append(("N", {"A": {30: 4}, "C": {30: 4}}, dict.fromkeys(B, 0.0)))
    out.append(("A", {"A": {30: 5}, "C": {30: 5}, "G": {30: 5}}, dict.fromkeys(B, 0.0)))  # a tie of the others
    return out


def frame(spark, given):
    rows = [("chr1", i, "+", ref, "bulk", 3, [(b, p, n) for b in sorted(cells) for p, n in sorted(cells[b].items())], *[sum(cells.get(b, {}).values()) for b in B], *[priors[b] for b in B]) for i, (ref, cells, priors) in enumerate(given)]
    return spark.createDataFrame(rows, "chrom string, pos long, strand string, ref string, cluster string, spot_number long, cells array<struct<allele:string,phred:int,n:long>>, nA long, nT long, nC long, nG long, fA double, fT double, fC double, fG double")


@pytest.mark.parametrize(("most", "single"), [(1000, False), (1000, True), (40, False)])
def test_individual_genotypes(spark, most, single):
    given = sites()
    germlines = I.germline_alleles(frame(spark, given), most_depth=most, keep_single=single)
    got: dict[int, dict] = {}
    for r in I.individual_genotypes(germlines).collect():
        got.setdefault(r.pos, {})[r.mutant] = (r.germline, r.mutant, r.genotype, r.p_mosaic, r.Gi, r.vaf_hat)
    report = {r.pos: (r.germline_geno, r.germline_allele, r.germ_count, r.germ_prior) for r in I.germline_report(germlines).collect()}
    kinds = set()
    for i, (ref, cells, priors) in enumerate(given):
        rows, germline = expected(ref, cells, priors, most, single)
        assert sorted(got.get(i, {})) == sorted(x[1] for x in rows), (i, ref, cells)
        for x in rows:
            mine = got[i][x[1]]
            assert mine[:3] + mine[4:5] == x[:3] + x[4:5], (i, mine, x)
            assert mine[3] == pytest.approx(x[3], rel=1e-6, abs=1e-12) and mine[5] == pytest.approx(x[5])
            kinds.add((x[0].count(","), x[2], x[4]))
        assert report.get(i) == germline if germline is None else report[i][:3] == germline[:3] and report[i][3] == pytest.approx(germline[3])
    assert {(0, "germline", "0/0"), (0, "mosaic", "0/1"), (1, "germline", "0/1"), (1, "mosaic", "0/1")} <= kinds


def test_great_depths_keep_a_value(spark):
    """Likelihoods far below the least double still compare."""
    out = I.individual_genotypes(I.germline_alleles(frame(spark, [("A", {"A": {30: 5000}, "C": {30: 400}}, dict.fromkeys(B, 0.0))]), most_depth=10**6)).first()
    assert (out.genotype, out.p_mosaic) == ("mosaic", 1.0)


def test_histograms_sum_by_level(spark):
    """Two clusters, a tie of strands, an error seen by one molecule, and a base that errors explain."""
    m = lambda barcode, umi, allele, phred, strand, n=(5, 0, 0, 0): ("chr1", 7, "A", barcode, umi, *n, sum(n), strand, allele, phred)
    calls = [m("s1", "1", "A", 30, "+"), m("s1", "2", "A", 30, "-"), m("s1", "3", "C", 40, "+", (0, 0, 5, 0)), m("s2", "1", "A", 10, "-"), m("s3", "1", "A", 22, "+"), m("s3", "2", "G", 21, "-", (2, 0, 0, 3))]
    df = spark.createDataFrame(calls, "chrom string, pos long, ref string, barcode string, umi string, nA long, nT long, nC long, nG long, reads long, strand string, allele string, phred int")
    clusters = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "b")], "barcode string, cluster string")
    spots = H.spot_histograms(H.spot_cells(df))
    shown = {r.barcode: (r.strand, r.alt, r.error_allele, r.nA, r.qA, r.qC) for r in H.with_texts(spots, "rank").collect()}
    assert shown == {"s1": ("-", "C", "C", 2, "30:2", "40:1"), "s2": ("-", ".", None, 1, "10:1", "NA"), "s3": ("-", "G", None, 1, "22:1", "NA")}
    rows = H.cluster_histograms(spots, clusters)
    assert {r.cluster: (r.spot_number, r.alt, r.nA, r.qA, r.qC) for r in H.with_texts(rows, "name", 20).collect()} == {"a": (2, "C", 3, "30:2", "40:1"), "b": (1, "G", 1, "22:1", "NA")}
    whole = H.with_texts(H.individual_histograms(rows), "name", 20).first()
    assert (whole.spot_number, whole.alt, whole.nA, whole.qA, whole.qG, whole.cluster) == (3, "C,G", 4, "22:1,30:2", "21:1", "bulk")
    bulk = H.with_texts(H.cluster_histograms(spots, None), "name", 20).first()
    assert (bulk.cluster, bulk.spot_number, bulk.qA) == ("bulk", 3, "22:1,30:2")
    few = spark.createDataFrame([("chr1", 7, "+", "A", "a", 4, 1, 0, 998, 1, [("A", 30, 1), ("C", 30, 998), ("G", 30, 1)])], "chrom string, pos long, strand string, ref string, cluster string, spot_number long, nA long, nT long, nC long, nG long, cells array<struct<allele:string,phred:int,n:long>>")
    left = H.with_texts(H.filter_alleles(few), "count").first()
    assert (left.nA, left.nC, left.nG, left.alt, left.qA, left.qC) == (0, 998, 0, "C", "NA", "30:998")


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert I.individual_genotypes(I.germline_alleles(empty)).count() == 0
    assert H.cluster_histograms(H.spot_histograms(H.spot_cells(spark.createDataFrame([], "chrom string, pos long, ref string, barcode string, umi string, nA long, nT long, nC long, nG long, reads long, strand string, allele string, phred int"))), None).count() == 0
