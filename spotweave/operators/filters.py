"""Filters and clean-up of single rows: germline sites, genes, priors, missing values, barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions import prob
from spotweave.functions.genome import BASES
from spotweave.operators.events import rebin_coord

#: What text tables write for a missing value.
MISSING = ("no", "NA", "NaN", "", "('no',)")


def filter_informative_het(germline: DataFrame, min_dp: int, min_prior: float, min_total: int, human: bool = True) -> DataFrame:
    """Heterozygous sites with both alleles' counts, priors and their total above the limits; other species need priors only."""
    het = F.col("genotype") == "het"
    if not human:
        return germline.where(het & (F.col("prior1") > 0) & (F.col("prior2") > 0))
    return germline.where(het & (F.least("count1", "count2") > min_dp) & (F.least("prior1", "prior2") > min_prior) & (F.col("count1") + F.col("count2") > min_total))


def filter_ase_germline(germline: DataFrame, min_total: int = 50, min_prior: float = 1e-4, alpha: float = 0.05) -> DataFrame:
    """Heterozygous sites whose allele counts differ from one half, with the two-sided p."""
    deep = germline.where((F.col("genotype") == "het") & (F.col("count1") + F.col("count2") > min_total) & (F.col("prior1") > min_prior) & (F.col("prior2") > min_prior))
    return deep.withColumn("p", prob.binom_two_sided(F.col("count1"), F.col("count1") + F.col("count2"))).where(F.col("p") <= alpha)


def filter_gene_bed(genes: DataFrame, chroms: list[str]) -> DataFrame:
    """Genes of the chromosomes named, without mitochondrial ones."""
    return genes.where(F.col("chrom").isin(chroms) & ~F.col("gene").contains("MT-"))


def mask_placeholder_priors(df: DataFrame, names: list[str]) -> DataFrame:
    """Null in all the named priors where all are one or all are zero."""
    same = lambda v: F.forall(F.array(*names), lambda x: F.coalesce(x == v, F.lit(False)))
    return df.withColumns({c: F.when(~same(1) & ~same(0), F.col(c)) for c in names})


def null_normalise(c: Column) -> Column:
    """Null for the ways in which text tables write a missing value."""
    return F.when(~c.isin(*MISSING), c)


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def extract_barcode_umi(reads: DataFrame, platform: str, size: int = 1) -> DataFrame:
    """reads with `barcode` and `umi` from the platform's tags; both null where one is missing."""
    if platform in ("visium", "visium-HD"):
        barcode, umi = F.trim("CB"), F.trim("UB")
    elif platform == "stereo":
        x, y = (F.col(c) if size == 1 else rebin_coord(F.col(c), size) for c in ("Cx", "Cy"))
        barcode, umi = F.concat(x.cast("string"), F.lit("_"), y.cast("string")), F.trim("UR")
    elif platform == "ST":
        barcode, umi = F.col("B0"), F.col("B3")
    else:
        raise ValueError(f"unknown platform {platform}")
    whole = barcode.isNotNull() & umi.isNotNull()
    return reads.withColumns({"barcode": F.when(whole, barcode), "umi": F.when(whole, umi)})


def barcode_to_cell(reads: DataFrame, cells: DataFrame) -> DataFrame:
    """reads whose barcode `cells` (barcode, cell) maps, with the cell as barcode and in front of the UMI."""
    mapped = reads.where("umi is not null").join(cells, "barcode")
    return mapped.withColumn("umi", F.concat_ws("_", "cell", "umi")).withColumn("barcode", F.col("cell")).drop("cell")


def join_prior_lookup(sites: DataFrame, population: DataFrame) -> DataFrame:
    """(chrom, pos, ref, fA, fT, fC, fG): greatest frequency of each alternative in `population` (chrom, pos, ref, alt, af), of the sites only."""
    known = population.join(sites.select("chrom", "pos", "ref").distinct(), ["chrom", "pos", "ref"], "left_semi")
    return known.groupBy("chrom", "pos", "ref").agg(*[F.max(F.when(F.col("alt") == b, F.col("af"))).alias(f"f{b}") for b in BASES])


def agg_cluster_spatial(spots: DataFrame, high: float = 0.5) -> DataFrame:
    """Counts, mean VAF and shares of mutated spots for each site and cluster, of (chrom, pos, cluster, depth, alt, vaf, mut_prob)."""
    out = spots.groupBy("chrom", "pos", "cluster").agg(
        F.count("*").alias("spot_count"), F.sum("depth").alias("depth"), F.sum("alt").alias("mutant_allele_num"), F.count_if(F.col("alt") > 0).alias("has_mutant_allele"),
        F.count_if(F.col("mut_prob") > high).alias("high_prob"), F.avg("vaf").alias("vaf"),
    )
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return out.withColumns({"vaf_unnom": share("mutant_allele_num", "depth"), "mutant_prop_vaf": share("has_mutant_allele", "spot_count"), "mutant_prop_prob": share("high_prob", "spot_count")})
