"""Priors, genotype likelihoods and posteriors of individuals and spots, in log space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.genome import BASES
from spotweave.functions.prob import ln_beta, ln_choose

GENOTYPES = ("refhom", "althom", "het", "mosaic")
_LN10 = 2.302585092994046


def prior_normalise(priors: DataFrame) -> DataFrame:
    """Allele frequencies that sum to one: others above one in all are scaled to .99, the reference has the rest."""
    other = sum(F.when(F.col("ref") == b, 0.0).otherwise(F.coalesce(F.col(f"f{b}"), F.lit(0.0))) for b in BASES)
    scale = F.when(other > 1, 0.99 / other).otherwise(1.0)
    scaled = {b: F.coalesce(F.col(f"f{b}"), F.lit(0.0)) * scale for b in BASES}
    return priors.select(*[c for c in priors.columns if c not in {f"f{b}" for b in BASES}], *[F.when(F.col("ref") == b, 1 - other * scale).otherwise(scaled[b]).alias(f"f{b}") for b in BASES])


def join_prior_left(sites: DataFrame, priors: DataFrame) -> DataFrame:
    """Sites with their priors, 0 where there are none."""
    columns = [f"f{b}" for b in BASES]
    joined = sites.join(priors.select("chrom", "pos", *columns), ["chrom", "pos"], "left")
    return joined.fillna(0.0, columns)


def genotype_likelihood(r: Column, a: Column, ref_right: Column, ref_wrong: Column, alt_right: Column, alt_wrong: Column, expected_alt: Column) -> dict[str, Column]:
    """log10 likelihoods of r reference and a alternative molecules.

    *_right and *_wrong are sums of ln(1 - e) and ln(e) over the molecules of an allele; expected_alt is the sum of e
    over reference and of 1 - e over alternative molecules.
    """
    n = (r + a).cast("double")
    choose = ln_choose(n, a.cast("double"))
    return {
        "refhom": (choose + ref_right + alt_wrong) / _LN10,
        "althom": (choose + ref_wrong + alt_right) / _LN10,
        "het": (choose - n * F.log(F.lit(2.0))) / _LN10,
        "mosaic": (choose + ln_beta(expected_alt + 1, n - expected_alt + 1)) / _LN10,
    }


def error_sums(histogram: DataFrame, alt: Column) -> DataFrame:
    """Sums that genotype_likelihood needs, of rows (chrom, pos, ref, allele, phred, n) and the alternative allele."""
    e = F.pow(F.lit(10.0), -F.col("phred") / 10)
    right, wrong = F.log(F.greatest(1 - e, F.lit(1e-12))), F.log(e)
    is_ref, is_alt = F.col("allele") == F.col("ref"), F.col("allele") == alt
    pick = lambda here, x: F.sum(F.when(here, F.col("n") * x).otherwise(0.0))
    return histogram.groupBy("chrom", "pos", "ref", alt.alias("alt")).agg(
        F.sum(F.when(is_ref, F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(is_alt, F.col("n")).otherwise(0)).alias("a"),
        pick(is_ref, right).alias("ref_right"), pick(is_ref, wrong).alias("ref_wrong"), pick(is_alt, right).alias("alt_right"), pick(is_alt, wrong).alias("alt_wrong"),
        F.sum(F.when(is_ref, F.col("n") * e).when(is_alt, F.col("n") * (1 - e)).otherwise(0.0)).alias("expected_alt"),
    )


def with_likelihoods(sums: DataFrame) -> DataFrame:
    like = genotype_likelihood(*[F.col(c) for c in ("r", "a", "ref_right", "ref_wrong", "alt_right", "alt_wrong", "expected_alt")])
    return sums.select("*", *[like[g].alias(f"l_{g}") for g in GENOTYPES])


def individual_posterior(likelihoods: DataFrame, mu: float = 1e-5, pop_vaf: float = 1e-5) -> DataFrame:
    """Genotype, probability of a mosaic and its share, for sites with two alleles; columns fref and falt are priors.

    A frequency of 0 counts as pop_vaf. The germline genotype is the likeliest but for mosaic; both heterozygous and
    homozygous alternative sites are reported as het. p_mosaic compares it with the mosaic.
    """
    f_ref, f_alt = (F.when(F.coalesce(F.col(c), F.lit(0.0)) <= 0, pop_vaf).otherwise(F.col(c)) for c in ("fref", "falt"))
    prior = {"refhom": f_ref * f_ref, "althom": f_alt * f_alt, "het": 2 * f_ref * f_alt, "mosaic": F.lit(mu)}
    post = {g: F.log10(prior[g]) + F.col(f"l_{g}") for g in GENOTYPES}
    out = likelihoods.select("*", *[post[g].alias(f"g_{g}") for g in GENOTYPES])
    best = F.greatest(*[F.col(f"g_{g}") for g in GENOTYPES])
    germ = F.greatest("g_refhom", "g_althom", "g_het")
    genotype = F.when(F.col("g_mosaic") == best, "mosaic").when(F.col("g_refhom") == best, "refhom").otherwise("het")
    return out.select("chrom", "pos", "ref", "alt", "r", "a", genotype.alias("genotype"), (1 / (1 + F.pow(F.lit(10.0), germ - F.col("g_mosaic")))).alias("p_mosaic"), (F.col("a") / (F.col("r") + F.col("a"))).alias("vaf"))


def spot_posterior(spots: DataFrame, pop_vaf: float = 1e-5) -> DataFrame:
    """Probability that a spot holds the mutant; spots has r, a, ref_right, alt_wrong, expected_alt, cluster_vaf and cells.

    Under the mutant, molecules follow the cluster's share; its prior is that one of the spot's cells has it.
    Without alternative molecules the posterior is at most one half.
    """
    v = F.greatest(F.lit(pop_vaf), F.least(F.lit(1 - pop_vaf), F.coalesce(F.col("cluster_vaf"), F.lit(pop_vaf))))
    n = (F.col("r") + F.col("a")).cast("double")
    germ = F.col("ref_right") + F.col("alt_wrong")
    mosaic = F.col("expected_alt") * F.log(v) + (n - F.col("expected_alt")) * F.log(1 - v)
    none = F.when(v < 0.5, F.pow(1 - 2 * v, F.coalesce(F.col("cells"), F.lit(1)))).otherwise(F.lit(pop_vaf))
    none = F.greatest(none, F.lit(1e-300))
    some = F.greatest(1 - none, F.lit(1e-300))
    p = 1 / (1 + F.exp(germ + F.log(none) - mosaic - F.log(some)))
    return spots.withColumn("p_mosaic", F.when(F.col("a") == 0, F.least(p, F.lit(0.5))).otherwise(p)).withColumn("g_spot", F.when((F.col("a") > 0) & (F.col("p_mosaic") > 0.5), "mosaic").otherwise("germline"))
