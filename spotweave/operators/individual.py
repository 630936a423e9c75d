"""Genotypes of individuals with one to four alleles, from quality histograms and priors.

First the germline: the reference and the most frequent other base give a genotype. Then every other base is a candidate
mutant, whose mosaic likelihood is compared with the germline's, summed over the germline bases. All in log space, so depths of
any size keep a value; likelihoods read at most 164 cells a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.expressions import bind, once
from spotweave.functions.genome import BASES, base_rank
from spotweave.functions.prob import log10_sum
from spotweave.operators.genotype import GENOTYPES, genotype_likelihood


def downsampled(cells: Column, most_depth: int) -> Column:
    """Cells with counts scaled to about most_depth in all, rounded half to even; n0 is the count before."""
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda t, c: t + c["n"])
    factor = F.when(total > most_depth, F.lit(float(most_depth)) / total)
    return bind(F.struct(cells.alias("cells"), factor.alias("factor")), lambda x: F.transform(x["cells"], lambda c: F.struct(c["allele"].alias("allele"), c["phred"].alias("phred"), c["n"].alias("n0"), F.when(x["factor"].isNotNull(), F.bround(c["n"] * x["factor"]).cast("long")).otherwise(c["n"]).alias("n"))))


def allele_sums(cells: str, base: Column) -> Column:
    """Of the downsampled cells of a base: n0, n, and sums of ln(1 - e), ln(e) and e."""
    begin = F.struct(F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("right"), F.lit(0.0).alias("wrong"), F.lit(0.0).alias("miss"))

    def step(t: Column, c: Column) -> Column:
        e = F.pow(F.lit(10.0), -c["phred"] / 10)
        right, wrong = c["n"] * F.log(F.greatest(1 - e, F.lit(1e-12))), c["n"] * F.log(e)
        return F.struct((t["n0"] + c["n0"]).alias("n0"), (t["n"] + c["n"]).alias("n"), (t["right"] + right).alias("right"), (t["wrong"] + wrong).alias("wrong"), (t["miss"] + c["n"] * e).alias("miss"))

    return F.aggregate(F.filter(cells, lambda c: c["allele"] == base), begin, step)


def _alleles(pop_vaf: float) -> Column:
    """Of each base: count (negative first, so that sorting puts the most frequent first), prior, and the sums that likelihoods need."""
    def one(i: int, b: str) -> Column:
        prior = F.when(F.coalesce(F.col(f"f{b}"), F.lit(0.0)) == 0, pop_vaf).otherwise(F.col(f"f{b}"))
        return bind(F.struct(prior.alias("prior"), allele_sums("sampled", F.lit(b)).alias("s")), lambda x: F.struct((-x["s"]["n"]).alias("minus"), F.lit(i).alias("i"), F.lit(b).alias("base"), x["prior"].alias("prior"), x["s"].alias("s")))

    return F.array(*[one(i, b) for i, b in enumerate(BASES)])


def _posteriors(ref: Column, alt: Column, mu: float) -> Column:
    """log10 of prior times likelihood by the order of GENOTYPES."""

    def joint(x: Column) -> Column:
        r, a = x["r"]["s"], x["a"]["s"]
        sums = F.struct(r["n"].alias("rn"), a["n"].alias("an"), r["right"].alias("rr"), r["wrong"].alias("rw"), a["right"].alias("ar"), a["wrong"].alias("aw"), (r["miss"] + a["n"] - a["miss"]).alias("x"), x["r"]["prior"].alias("rp"), x["a"]["prior"].alias("ap"))
        return bind(sums, weighed)

    def weighed(y: Column) -> Column:
        like = genotype_likelihood(*[y[k] for k in ("rn", "an", "rr", "rw", "ar", "aw", "x")])
        prior = {"refhom": F.log10(y["rp"]) * 2, "althom": F.log10(y["ap"]) * 2, "het": F.log10(2 * y["rp"] * y["ap"]), "mosaic": F.log10(F.lit(mu))}
        return F.array(*[prior[g] + like[g] for g in GENOTYPES])

    return bind(F.struct(ref.alias("r"), alt.alias("a")), joint)


def germline_alleles(individuals: DataFrame, least_quality: int = 20, mu: float = 1e-7, most_depth: int = 1000, pop_vaf: float = 1e-5, keep_single: bool = False) -> DataFrame:
    """Rows of individual_histograms and priors fA, fT, fC, fG, with germline_geno and the structs refs, alts, germline of bases.

    Sites without a known reference or without a base of quality are left out, and those of a single base too unless
    keep_single; then the first other base, without a count, stands for the missing one. A prior of 0 counts as pop_vaf.
    Of two bases with the reference, any second one of the germline makes it het; otherwise the genotype is that of
    the reference and the most frequent other base (ties by A, T, C, G), where a mosaic leaves the germline at the reference.
    """
    good = F.filter("cells", lambda c: c["phred"] >= least_quality)
    known = once(individuals.where(F.col("ref").isin(*BASES)), sampled=downsampled(good, most_depth))
    known = once(known, alleles=_alleles(pop_vaf))
    depth = F.aggregate("alleles", F.lit(0).cast("long"), lambda t, x: t + x["s"]["n"])
    known = once(known, present=F.filter("alleles", lambda x: x["minus"] < 0), own=F.get("alleles", base_rank(F.col("ref"))), depth=depth)
    known = once(known.where(F.size("present") > (0 if keep_single else 1)), others=F.array_sort(F.filter("present", lambda x: x["base"] != F.col("ref"))))

    single, of_ref = F.size("present") == 1, F.col("own.minus") < 0
    only = F.get("present", F.lit(0))
    spare = F.get(F.filter("alleles", lambda x: x["base"] != only["base"]), F.lit(0))
    pair = (F.size("present") == 2) & of_ref
    top = F.get("others", F.lit(0))
    genotype = bind(_posteriors(F.col("own"), F.coalesce(top, F.col("own")), mu), lambda p: F.get(F.array(F.lit("refhom"), F.lit("althom"), F.lit("het"), F.lit("refhom")), (F.array_position(p, F.array_max(p)) - 1).cast("int")))
    known = once(known, likeliest=genotype)
    hom = F.col("likeliest") == "refhom"
    geno = F.when(single, F.when(of_ref, "refhom").otherwise("althom")).when(pair & ~hom, "het").otherwise(F.col("likeliest"))
    second = F.when(single, ~of_ref).otherwise(~hom)  # the germline has two bases
    refs = F.when(single, F.when(of_ref, F.array("own")).otherwise(F.array(spare))).when(pair | hom, F.array("own")).otherwise(F.array(F.col("own"), top))
    alts = F.when(single, F.when(of_ref, F.array(spare)).otherwise(F.array(only))).when(pair | hom, F.col("others")).otherwise(F.slice("others", 2, 3))
    germline = F.when(second, F.array(F.col("own"), top)).otherwise(F.array("own"))
    named = F.when(single | pair, F.array("own")).otherwise(refs)
    return once(known, germline_geno=geno, refs=refs, alts=alts, germline=germline, named=F.transform(named, lambda x: x["base"])).drop("sampled", "alleles", "present", "own", "others", "likeliest")


def germline_report(germlines: DataFrame) -> DataFrame:
    """(chrom, pos, germline_geno, germline_allele, germ_count before downsampling, germ_prior) of sites with a candidate mutant."""
    of = lambda f: F.array_join(F.transform("germline", f), ",")
    return germlines.where(F.size("alts") > 0).select("chrom", "pos", "germline_geno", of(lambda x: x["base"]).alias("germline_allele"), of(lambda x: x["s"]["n0"].cast("string")).alias("germ_count"), F.transform("germline", lambda x: x["prior"]).alias("germ_prior"))


def individual_genotypes(germlines: DataFrame, mu: float = 1e-7) -> DataFrame:
    """A row for each candidate mutant: genotype (germline or mosaic), p_mosaic, Gi (0/0, 0/1, 1/1), vaf_hat.

    Posteriors are sums over the germline bases; with two of them the germline stands for "no mutant", else for the site's germline genotype.
    """
    each = germlines.withColumn("a", F.explode("alts"))
    two = F.size("refs") > 1
    place = F.when(two | (F.col("germline_geno") == "refhom"), 0).when(F.col("germline_geno") == "althom", 1).otherwise(2)
    each = once(each, posts=F.transform("refs", lambda r: _posteriors(r, F.col("a"), mu)))
    first, last = F.get("posts", F.lit(0)), F.coalesce(F.get("posts", F.lit(1)), F.array(*[F.lit(float("-inf"))] * 4))
    over = lambda i: log10_sum([F.get(first, i), F.get(last, i)])
    each = once(each, germ=over(place), mosaic=over(F.lit(3)))
    is_mosaic = F.col("mosaic") > F.col("germ")
    gi = F.when(is_mosaic | (F.col("germline_geno") == "het"), "0/1").when(F.col("germline_geno") == "althom", "1/1").otherwise("0/0")
    return each.select(
        "chrom", "pos", "strand", F.array_join("named", ",").alias("germline"), F.col("a.base").alias("mutant"), "cluster", "spot_number", F.concat_ws(",", *[F.col(f"n{b}").cast("string") for b in BASES]).alias("consensus_read_count"),
        F.when(is_mosaic, "mosaic").otherwise("germline").alias("genotype"), (1 / (1 + F.pow(F.lit(10.0), F.col("germ") - F.col("mosaic")))).alias("p_mosaic"), gi.alias("Gi"), (F.col("a.s.n") / F.col("depth")).alias("vaf_hat"),
    )
