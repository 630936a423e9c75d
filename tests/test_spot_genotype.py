"""Spot genotypes against a plain reading of the rules."""

import math
import random

import pytest

from spotweave.operators import spot_genotype as S

B = "ATCG"


def expected(germline, mutant, v, cells, number, most=1000):
    good = {b: {p: n for p, n in cells.get(b, {}).items() if p >= 20} for b in B}
    total = sum(sum(x.values()) for x in good.values())
    q = {b: [p for p, n in x.items() for _ in range(round(n * (most / total)) if total > most else n)] for b, x in good.items()}
    depth, bases = sum(map(len, q.values())), germline.split(",")
    if not any(q[b] for b in [*bases, mutant]):
        return (None, None, None, None, depth, None, None)
    refs = [b for b in bases if q[b]] or bases[:1]
    na, lg, lm = len(q[mutant]), 0.0, 0.0
    held = {0: 1e-5, 1: 1 - 1e-5}.get(v, v)
    for r in refs:
        e = lambda x: 10 ** (-x / 10)
        n = len(q[r]) + na
        x = sum(map(e, q[r])) + sum(1 - e(p) for p in q[mutant])
        lg += math.comb(n, na) * math.prod(1 - e(p) for p in q[r]) * math.prod(e(p) for p in q[mutant])
        lm += math.comb(n, na) * held**x * (1 - held) ** (n - x)
    none = (1 - 2 * v) ** number if v < 0.5 else 1e-5
    p = (1 - none) * lm / ((1 - none) * lm + none * lg)
    share = lm / (lm + lg)
    geno = "mosaic" if na and p > 0.5 else "germline"
    if (na == 0 and share > 0.5) or (na and share < 0.5):
        share = 0.5
    return (1 - share, share, geno, "0/1" if geno == "mosaic" else "0/0", depth, na / depth, min(p, 0.5) if na == 0 else p)


@pytest.mark.parametrize("most", [1000, 9])
def test_spot_genotypes(spark, most):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(300):
        germline, mutant = rng.choice([("A", "C"), ("T", "G"), ("A,C", "G"), ("A,C", "T")])
        cells = {b: {p: rng.randint(1, 4) for p in rng.sample([12, 20, 30, 40], rng.randint(1, 2))} for b in rng.sample(B, rng.randint(0, 3))}
        v, number = rng.choice([None, 0.0, 0.01, 0.2, 0.49, 0.5, 0.8, 1.0]), rng.choice([None, 1, 7, 25])
        rows.append(("chr1", i, "+", germline, mutant, "a", "s", [(b, p, n) for b in sorted(cells) for p, n in sorted(cells[b].items())], v, number))
        want[i] = expected(germline, mutant, v or 0.0, cells, number or 20, most)
    df = spark.createDataFrame(rows, "chrom string, pos long, strand string, germline string, mutant string, cluster string, barcode string, cells array<struct<allele:string,phred:int,n:long>>, cluster_vaf double, refined_cell_num long")
    got = {r.pos: tuple(r)[7:] for r in S.spot_genotypes(df, most_depth=most).collect()}
    assert len(got) == 300 and {w[2] for w in want.values()} == {None, "mosaic", "germline"}
    for i, w in want.items():
        g = got[i]
        assert g[2:5] == w[2:5], (i, rows[i], g, w)
        assert [g[0], g[1], g[5], g[6]] == [x if x is None else pytest.approx(x, rel=1e-6, abs=1e-9) for x in (w[0], w[1], w[5], w[6])], (i, rows[i])


def test_joins_keep_unknown_and_refuse_repeats(spark):
    spots = spark.createDataFrame([("chr1", 1, "+", "s1"), ("chr1", 1, "+", "s2"), ("chr1", 2, "+", "s1"), ("chr1", 1, "-", "s1")], "chrom string, pos long, strand string, barcode string")
    genotypes = spark.createDataFrame([("chr1", 1, "+", "A", "C", "mosaic", 0.2), ("chr1", 2, "+", "A", "C", "germline", 0.2)], "chrom string, pos long, strand string, germline string, mutant string, genotype string, vaf_hat double")
    clusters = spark.createDataFrame([("s1", "a")], "barcode string, cluster string")
    counts = spark.createDataFrame([("chr1", 1, "+", "a", 3, 0, 1, 0), ("chr1", 2, "+", "a", 0, 0, 0, 0)], "chrom string, pos long, strand string, cluster string, nA long, nT long, nC long, nG long")
    shares = S.cluster_shares(counts, genotypes)
    assert sorted((r.pos, r.cluster_vaf) for r in shares.collect()) == [(1, 0.25), (2, None)]
    cells = spark.createDataFrame([("s2", 9)], "barcode string, refined_cell_num long")
    out = S.join_spots(spots, genotypes, clusters, shares, cells)
    assert sorted(((r.barcode, r.cluster, r.cluster_vaf, r.refined_cell_num, r.ind_vaf) for r in out.collect()), key=str) == [("s1", "a", 0.25, None, 0.2), ("s2", None, None, 9, 0.2)]
    with pytest.raises(Exception, match="repeated key"):
        S.join_many_to_one(spots, clusters.union(clusters), ["barcode"]).collect()
