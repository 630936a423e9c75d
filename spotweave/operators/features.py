"""Site flags, spectra, false discovery, phasing, the wide join, rules and read statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.functions.prob import beta_binomial_sf, binom_sf

KEY = ["chrom", "pos", "ref", "alt"]


def membership_flag(sites: DataFrame, known: DataFrame, keys: list[str], name: str) -> DataFrame:
    """sites with a boolean column: whether `known` has their keys."""
    return sites.join(known.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def lookup_dbsnp(sites: DataFrame, database: DataFrame) -> DataFrame:
    """The first identifier whose (chrom, pos, ref) is the site's and whose comma list of alternatives has the site's."""
    one = database.select("chrom", "pos", "ref", F.explode(F.split("alts", ",")).alias("alt"), "id").groupBy(*KEY).agg(F.min("id").alias("dbsnp"))
    return sites.join(one, KEY, "left")


def mutation_spectrum(sites: DataFrame, context: str = "context") -> DataFrame:
    return sites.groupBy(context).agg(F.count("*").alias("n"))


def all_contexts(spark) -> DataFrame:
    """The 192 contexts up[ref>alt]down, in a fixed order."""
    bases = "ACGT"
    rows = [(f"{u}[{r}>{a}]{d}",) for r in bases for a in bases if a != r for u in bases for d in bases]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, context string")


def fill_spectrum(spectrum: DataFrame, contexts: DataFrame) -> DataFrame:
    return contexts.join(spectrum, "context", "left").select("place", "context", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reverse_context(context: Column) -> Column:
    part = lambda i: F.translate(F.substring(context, i, 1), "ACGT", "TGCA")
    return F.concat(part(7), F.lit("["), part(3), F.lit(">"), part(5), F.lit("]"), part(1))


def refine_spectrum(spectrum: DataFrame) -> DataFrame:
    """Counts less those of the reverse complement, at least 0."""
    other = spectrum.select(reverse_context(F.col("context")).alias("context"), F.col("n").alias("m"))
    return spectrum.join(other, "context", "left").select("context", F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0)).cast("long").alias("n"))


def bh_fdr(rows: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg adjusted values within each group; null p stay null."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))
    raw = F.col(p) * F.count(p).over(w) / F.col("_rank")
    ranked = rows.withColumn("_rank", rank).withColumn("_raw", F.when(F.col(p).isNotNull(), raw))
    up = F.min("_raw").over(w.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(f"{p}_adj", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), up))).drop("_rank", "_raw")


def hfdr(sites: DataFrame) -> DataFrame:
    """hfdr of sites with alt, depth and context weight rweigh: alpha / (alpha + beta * rweigh / 49)."""
    alpha = beta_binomial_sf(F.col("alt_count").cast("double"), F.col("depth").cast("double"))
    beta = (F.col("depth") - F.col("alt_count") + 1) / (F.col("depth") + 1)
    return sites.withColumn("alpha", alpha).withColumn("hfdr", F.col("alpha") / (F.col("alpha") + beta * F.col("rweigh") / 49))


def binom_cdf_ase(hits: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """ase: whether the least depleted of a site's haplotype SNPs stays insignificant, after BH; hits has alt_count, depth, share."""
    share = F.greatest(F.lit(1e-9), F.least(F.col("share"), 1 - F.col("share")))
    p = 1 - binom_sf((F.col("alt_count") + 1).cast("double"), F.col("depth").cast("double"), share)
    adjusted = bh_fdr(hits.withColumn("p", F.greatest(p, F.lit(0.0))), keys)
    return adjusted.groupBy(*keys).agg((F.max("p_adj") >= alpha).alias("ase"), F.max("p_adj").alias("p_adj"))


def agg_phase_summary(pairs: DataFrame) -> DataFrame:
    """Per variant: support over its SNPs, and haplo at the nearest (least signed distance) and best supported one."""
    return pairs.groupBy(*KEY).agg(
        F.max("mut_allele").alias("max_support"), F.sum("mut_allele").alias("sum_support"),
        F.min_by("haplo", F.struct("distance", "snp_pos")).alias("nearest_haplo"), F.max_by("haplo", F.struct(F.col("mut_allele"), -F.col("snp_pos"))).alias("most_haplo"),
    )


def win_merge_haplotype(most: Column, nearest: Column) -> Column:
    """One haplotype of two: what they share, 3 if either is, else the smaller; null without any."""
    return F.when(most == nearest, most).when((most == 3) | (nearest == 3), 3).otherwise(F.least(most, nearest))


def first_of_key(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row a key: the first by `order`, ties and rows without one by the other columns; partially aggregated."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min(F.struct(*([F.col(order).alias("_order")] if order else []), *rest))
    return rows.groupBy(*keys).agg(first.alias("_first")).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def join_wide_features(driving: DataFrame, *features: DataFrame, order: str | None = None) -> DataFrame:
    """Left joins by variant key with the first row of each key on every side. Same keys, so the sides are shuffled once each."""
    for f in features:
        driving = driving.join(first_of_key(f, KEY, order), KEY, "left")
    return driving


def rule_filtration(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """filter: the names of the rules that fire, in order, or PASS; a rule that is null doesn't fire."""
    fired = F.concat_ws(";", *[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.withColumn("filter", F.when(fired == "", "PASS").otherwise(fired))


def filter_pipeline(rows: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """(filter, passed, total, pass_rate) of each named condition, in one pass."""
    sums = rows.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in filters.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(n).alias("passed")) for n in filters]))
    return sums.select(each.alias("x"), "total").select("x.filter", "x.passed", "total", (F.col("x.passed") / F.col("total")).alias("pass_rate"))


def linreg_r2(x: str, y: str) -> Column:
    """The squared correlation of a group's y and x: 1 where x is constant, else 0 where y is."""
    return F.when(F.min(x) == F.max(x), 1.0).when(F.min(y) == F.max(y), 0.0).otherwise(F.regr_r2(y, x))


def agg_site_spatial(spots: DataFrame, vaf: float = 0.0, probability: float = 0.5, likelihood: float = 0.5) -> DataFrame:
    """Shares and averages over a site's spots; spots without any of the values (depth, vaf, mut_prob, l_mosaic) are left out.

    mut_rate needs a share of the mutant and a probability above their thresholds; mut_rate_vaf, mut_rate_prob and mut_rate_likelihood ask
    for one each. num_mut_spots counts spots with any mutant. r2 is of mutant molecules against depth.
    """
    known = spots.where("depth is not null and vaf is not null and mut_prob is not null and l_mosaic is not null").withColumn("mutants", F.ceil(F.round(F.col("depth") * F.col("vaf"), 9)))
    share = lambda c: F.avg(c.cast("double"))
    has, sure, likely = F.col("vaf") > vaf, F.col("mut_prob") > probability, F.col("l_mosaic") > likelihood
    return known.groupBy("chrom", "pos").agg(
        F.count("*").alias("num_spots"), F.count_if(F.col("vaf") > 0).alias("num_mut_spots"), share(has & sure).alias("mut_rate"), share(sure).alias("mut_rate_prob"), share(likely).alias("mut_rate_likelihood"), share(has).alias("mut_rate_vaf"),
        F.max("vaf").alias("vaf_max"), F.avg("vaf").alias("vaf_mean"), F.avg(F.when(F.col("vaf") > 0, F.col("vaf"))).alias("vaf_mean_mut"), F.expr("percentile(case when vaf > 0 then vaf end, 0.5)").alias("vaf_median_mut"), linreg_r2("depth", "mutants").alias("r2"),
    )


def agg_bam_qc(reads: DataFrame) -> DataFrame:
    """(mapq, nm, n, share): the joint distribution of mapping quality and mismatches."""
    joint = reads.groupBy("mapq", "nm").agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("total"))
    return joint.join(F.broadcast(total)).select("mapq", "nm", "n", (F.col("n") / F.col("total")).alias("share"))  # total is one row


def phylo_matrix(sites: DataFrame, barcodes: DataFrame, support: DataFrame, least_spots: int = 0) -> DataFrame:
    """Every site by every barcode with alt, total and state (1, 0, or null where uncovered); sites with enough spots only.

    The matrix is the result, so sites meet a short, fixed list of barcodes.
    """
    covered = support.groupBy("chrom", "pos").agg(F.count("*").alias("spots")).where(F.col("spots") > least_spots).drop("spots")
    grid = sites.join(covered, ["chrom", "pos"], "left_semi").select("chrom", "pos").withColumn("barcode", F.explode(F.array(*[F.lit(b.barcode) for b in barcodes.orderBy("barcode").collect()])))
    out = grid.join(support, ["chrom", "pos", "barcode"], "left")
    return out.select("chrom", "pos", "barcode", F.coalesce("alt", F.lit(0)).alias("alt"), F.coalesce("total", F.lit(0)).alias("total"), F.when(F.col("alt") > 0, 1).when(F.col("total") > 0, 0).alias("state"))


def ml_prepare(rows: DataFrame, p_columns: list[str], s_columns: list[str]) -> DataFrame:
    """p-values: null to 1, then log10(1 + p); scores: null to 0, infinities to +-1e10; repeated rows go."""
    clip = lambda c: F.when(c == float("inf"), 1e10).when(c == float("-inf"), -1e10).otherwise(c)
    out = rows.select(*[c for c in rows.columns if c not in {*p_columns, *s_columns}], *[F.log10(1 + F.coalesce(F.col(c), F.lit(1.0))).alias(c) for c in p_columns], *[clip(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in s_columns])
    return out.dropDuplicates()
