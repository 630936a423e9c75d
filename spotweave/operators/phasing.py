"""Phasing from molecules: pairs of mosaic and germline sites, haplotypes of molecules, and what gates them."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.expressions import bind
from spotweave.functions.genome import BASES
from spotweave.functions.prob import chi_square_yates, fisher_two_sided

PAIR = ["chrom", "pos", "snp_pos"]


def cross_mosaic_hsnp(mosaic: DataFrame, snps: DataFrame) -> DataFrame:
    """(chrom, region, pos, snp_pos): mosaic sites with all other informative sites of their region.

    mosaic, snps: (chrom, region, pos). Regions are bounded genome windows, so a join key never holds a chromosome.
    """
    pairs = mosaic.join(snps.withColumnRenamed("pos", "snp_pos"), ["chrom", "region"])
    return pairs.where("pos <> snp_pos").select("chrom", "region", "pos", "snp_pos")


def agg_phase_haplotypes(pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """(chrom, pos, snp_pos, base, snp_base, n): molecules that cover both sites of a pair, by their two bases.

    calls: (chrom, pos, molecule, base), one a molecule and site; null bases are not covered.
    """
    called = calls.where("base is not null")
    at_snp = called.select("chrom", "molecule", F.col("pos").alias("snp_pos"), F.col("base").alias("snp_base"))
    return pairs.select(*PAIR).join(called, ["chrom", "pos"]).join(at_snp, ["chrom", "molecule", "snp_pos"]).groupBy(*PAIR, "base", "snp_base").agg(F.count("*").alias("n"))


def haplotype_balance_gate(haplotypes: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(chrom, pos, snp_pos, h1, h2, dp, balanced): the two most frequent germline bases of a pair, ties in base order.

    Balanced if neither one's share, in whole hundredths rounded up, differs from one half; a pair with one base isn't.
    """
    of = lambda b: F.coalesce(F.sum(F.when(F.col("snp_base") == b, F.col("n"))), F.lit(0))
    counts = haplotypes.groupBy(*PAIR).agg(F.sum("n").alias("dp"), *[of(b).alias(f"s{b}") for b in BASES])
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"s{b}")).alias("less"), F.lit(i).alias("place"), F.lit(b).alias("base")) for i, b in enumerate(BASES)]), lambda x: x["less"] < 0))
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    low = next(k for k in range(51) if 2 * sum(comb(100, i) for i in range(k + 1)) / 2**100 > alpha)  # the least of 100 tosses that the two-sided exact test accepts
    even = lambda x: F.ceil(-100 * x["less"] / F.col("dp")).between(low, 100 - low)
    out = counts.withColumn("ranked", ranked)
    return out.select(*PAIR, first["base"].alias("h1"), second["base"].alias("h2"), "dp", F.coalesce(even(first) & even(second), F.lit(False)).alias("balanced"))


def phase_counts(haplotypes: DataFrame, gate: DataFrame, sites: DataFrame) -> DataFrame:
    """Molecules of each balanced pair by allele and germline haplotype: g1h1, g1h2, g2h1, g2h2 (0 with one germline allele), mh1, mh2.

    sites: (chrom, pos, germline, mutant), germline an array of one or two alleles. Pairs whose mutant has no molecule go.
    """
    open_pairs = gate.where("balanced and h2 is not null").select(*PAIR, "h1", "h2")
    rows = haplotypes.join(open_pairs, PAIR).join(sites.select("chrom", "pos", F.array_distinct("germline").alias("germline"), "mutant"), ["chrom", "pos"])
    second = F.get("germline", F.lit(1))
    alleles = {"g1": F.get("germline", F.lit(0)), "g2": second, "m": F.col("mutant")}
    cells = [F.coalesce(F.sum(F.when((F.col("base") == a) & (F.col("snp_base") == F.col(h)), F.col("n"))), F.lit(0)).alias(f"{n}{h}") for n, a in alleles.items() for h in ("h1", "h2")]
    out = rows.groupBy(*PAIR, "germline", "mutant", "h1", "h2").agg(*cells)
    all_cells = sum((F.col(f"{n}{h}") for n in alleles for h in ("h1", "h2")), F.lit(0))
    return out.withColumn("dp", all_cells).withColumn("mut_allele", F.col("mh1") + F.col("mh2")).where("mut_allele > 0")


def phase_classify(counts: DataFrame, times: int = 5) -> DataFrame:
    """haplo and annotated_type of `phase_counts`: how many haplotypes the pair shows.

    An allele leans if it has more than `times` as many molecules with one germline haplotype as with the other. With one
    germline allele: 2 (heterzygous) if it and the mutant lean apart and the pair has more than 4 molecules; 3 (mut_mosaic) if
    only the mutant leans, has at least 2, and the germline allele has more on the other side. With two: 3 (mut_mosaic) if they
    lean apart and the mutant leans too and has at least 2. All else is 4 (artifacts).
    """
    c = lambda n: F.col(n)
    up = lambda a: c(f"{a}h1") > times * c(f"{a}h2")
    down = lambda a: c(f"{a}h2") > times * c(f"{a}h1")
    leans = lambda a: up(a) | down(a)
    apart = lambda a, b: (up(a) & down(b)) | (down(a) & up(b))
    opposed = ((c("g1h1") > c("g1h2")) & (c("mh1") < c("mh2"))) | ((c("g1h2") > c("g1h1")) & (c("mh2") < c("mh1")))
    one = F.when(apart("g1", "m") & (c("dp") > 4), 2).when(~leans("g1") & leans("m") & (c("mut_allele") >= 2) & opposed, 3).otherwise(4)
    two = F.when(apart("g1", "g2") & (c("mut_allele") >= 2) & leans("m"), 3).otherwise(4)
    haplo = F.when(F.size("germline") == 1, one).when(F.size("germline") == 2, two)
    return counts.withColumn("haplo", haplo).withColumn("annotated_type", F.when(F.col("haplo") == 2, "heterzygous").when(F.col("haplo") == 3, "mut_mosaic").when(F.col("haplo") == 4, "artifacts"))


def mutation_origin(classified: DataFrame) -> DataFrame:
    """mut_origin of pairs with three haplotypes: the germline allele that the mutant arose on, by the haplotype that it leans to; else null."""
    first, second = F.get("germline", F.lit(0)), F.get("germline", F.lit(1))
    two = F.when(F.col("mh1") > F.col("mh2"), F.when(F.col("g1h1") > F.col("g2h1"), first).otherwise(second)).when(F.col("mh1") < F.col("mh2"), F.when(F.col("g1h2") > F.col("g2h2"), first).otherwise(second))
    return classified.withColumn("mut_origin", F.when(F.col("annotated_type") == "mut_mosaic", F.when(F.size("germline") == 1, first).otherwise(two)))


def cluster_events(pairs: DataFrame, calls: DataFrame, sites: DataFrame, least: int = 50, alpha: float = 0.05) -> DataFrame:
    """Near pairs of mosaic sites with (rr, ra, ar, aa), molecules by germline or mutant at the two, p and `event` (p < alpha).

    pairs: (chrom, pos_i, pos_j); calls: as in `agg_phase_haplotypes`; sites: (chrom, pos, germline, mutant), germline one allele.
    Pairs with fewer than `least` molecules go. Fisher's test if any cell is below 5, else chi-square with Yates' correction.
    """
    called = calls.where("base is not null").join(sites, ["chrom", "pos"]).where((F.col("base") == F.col("germline")) | (F.col("base") == F.col("mutant"))).select("chrom", "pos", "molecule", (F.col("base") == F.col("mutant")).alias("is_alt"))
    left = called.select("chrom", "molecule", F.col("pos").alias("pos_i"), F.col("is_alt").alias("i"))
    right = called.select("chrom", "molecule", F.col("pos").alias("pos_j"), F.col("is_alt").alias("j"))
    met = pairs.join(left, ["chrom", "pos_i"]).join(right, ["chrom", "molecule", "pos_j"])
    n = lambda c: F.count_if(c).cast("double")
    i, j = F.col("i"), F.col("j")
    cells = met.groupBy("chrom", "pos_i", "pos_j").agg(n(~i & ~j).alias("rr"), n(~i & j).alias("ra"), n(i & ~j).alias("ar"), n(i & j).alias("aa"))
    table = [F.col(x) for x in ("rr", "ra", "ar", "aa")]
    wide = cells.where(sum(table, F.lit(0.0)) >= least)
    p = F.when(F.least(*table) < 5, fisher_two_sided(*table)).otherwise(chi_square_yates(*table))
    return wide.withColumn("p", p).withColumn("event", F.col("p") < alpha)


def cluster_event_sites(events: DataFrame) -> DataFrame:
    """(chrom, pos): sites of any pair with an event."""
    return events.where("event").select("chrom", F.explode(F.array("pos_i", "pos_j")).alias("pos")).distinct()


def discordant_prop(details: Column) -> Column:
    """Share of the last count among every second count of `key:count;...`, of those that the smaller of the last two is in; 0 where undefined."""
    last = lambda v, k: F.get(v, F.size(v) - k)
    values = F.filter(F.transform(F.split(details, ";"), lambda x: F.split_part(x, F.lit(":"), F.lit(2)).try_cast("long")), lambda x: x.isNotNull())
    picked = bind(values, lambda v: F.filter(v, lambda x, i: (i % 2 == 0) == (last(v, 2) < last(v, 1))))  # null below two values
    share = bind(picked, lambda v: last(v, 1) / F.nullif(F.aggregate(v, F.lit(0).cast("long"), lambda t, x: t + x), F.lit(0).cast("long")))
    return F.coalesce(share, F.lit(0.0))
