"""Genotypes of spots: every spot of an individual's mosaic site, with its cluster's share of the mutant and its number of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.expressions import bind, once
from spotweave.functions.prob import ln_choose
from spotweave.operators.events import count_of
from spotweave.operators.histograms import COUNTS
from spotweave.operators.individual import allele_sums, downsampled

CANDIDATE = ["chrom", "pos", "strand", "germline", "mutant"]


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that are unique in `right`; an error where they are not, as rows of `left` would repeat."""
    held = right.groupBy(*keys).agg(F.any_value(F.struct(*[c for c in right.columns if c not in keys])).alias("_r"), F.count("*").alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated key in a many-to-one join on {', '.join(keys)}"))).otherwise(F.col("_r"))
    return left.join(held.select(*keys, checked.alias("_r")), keys, "left").select(*left.columns, "_r.*")


def cluster_shares(clusters: DataFrame, candidates: DataFrame) -> DataFrame:
    """The mutant's share of each cluster's molecules, null without any, by candidate and cluster."""
    depth = sum((F.col(c) for c in COUNTS), F.lit(0))
    joined = clusters.join(candidates.select(*CANDIDATE), ["chrom", "pos", "strand"])
    return joined.select(*CANDIDATE, "cluster", F.when(depth > 0, count_of(F.col("mutant")) / depth).alias("cluster_vaf"))


def join_spots(spots: DataFrame, genotypes: DataFrame, clusters: DataFrame, shares: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Spots of mosaic candidates with cluster, cluster_vaf and refined_cell_num, each null where it is unknown."""
    mosaic = genotypes.where("genotype = 'mosaic'").select(*CANDIDATE, F.col("vaf_hat").alias("ind_vaf"))
    joined = join_many_to_one(spots, clusters.select("barcode", "cluster"), ["barcode"]).join(mosaic, ["chrom", "pos", "strand"])
    joined = join_many_to_one(joined, shares, [*CANDIDATE, "cluster"])
    return joined.withColumn("refined_cell_num", F.lit(None).cast("long")) if cells is None else join_many_to_one(joined, cells.select("barcode", "refined_cell_num"), ["barcode"])


def _ln(x: Column) -> Column:
    """ln x, minus infinity at 0."""
    return F.when(x > 0, F.log(x)).otherwise(float("-inf"))


def _ln_sum(xs: Column) -> Column:
    most = F.array_max(xs)
    return bind(F.struct(xs.alias("xs"), most.alias("most")), lambda s: F.when(s["most"] == float("-inf"), float("-inf")).otherwise(s["most"] + F.log(F.aggregate(s["xs"], F.lit(0.0), lambda t, x: t + F.exp(x - s["most"])))))


def spot_genotypes(joined: DataFrame, cells: int = 20, least_quality: int = 20, most_depth: int = 1000, pop_vaf: float = 1e-5) -> DataFrame:
    """l_germline, l_mosaic, genotype, Gi, depth, vaf and p_mosaic of join_spots' rows.

    Likelihoods are sums over the germline's bases that the spot shows (the first one, if none), and are shares of their sum. Under the
    mutant, molecules follow the cluster's share v, held off 0 and 1 by pop_vaf. The prior of no mutant is (1 - 2v)^cells,
    pop_vaf from v = 1/2 on. An unknown v is 0; an unknown number of cells is `cells`. Without a mutant molecule, p_mosaic is at most 1/2
    and the genotype germline; likelihoods that contradict the molecules become halves. Nulls, where a spot shows none of the candidate's bases.
    """
    good = F.filter("cells", lambda c: c["phred"] >= least_quality)
    x = once(joined, sampled=downsampled(good, most_depth), v=F.coalesce("cluster_vaf", F.lit(0.0)), number=F.coalesce("refined_cell_num", F.lit(cells)))
    own = F.transform(F.split("germline", ","), lambda b: allele_sums("sampled", b))
    x = once(x, own=own, mut=allele_sums("sampled", F.col("mutant")), depth=F.aggregate("sampled", F.lit(0).cast("long"), lambda t, c: t + c["n"]))
    shown = F.filter("own", lambda s: s["n"] > 0)
    x = once(x, refs=F.when(F.size(shown) > 0, shown).otherwise(F.slice("own", 1, 1)), known=(F.size(shown) > 0) | (F.col("mut.n") > 0))
    held = F.when(F.col("v") == 0, pop_vaf).when(F.col("v") == 1, 1 - pop_vaf).otherwise(F.col("v"))

    def both(r: Column) -> Column:
        n, r_mut = (r["n"] + F.col("mut.n")).cast("double"), r["miss"] + F.col("mut.n") - F.col("mut.miss")
        choose = ln_choose(n, F.col("mut.n").cast("double"))
        return F.struct((choose + r["right"] + F.col("mut.wrong")).alias("g"), (choose + r_mut * F.log(F.col("held")) + (n - r_mut) * F.log(1 - F.col("held"))).alias("m"))

    x = once(once(x, held=held), both=F.transform("refs", both))
    x = once(x, lg=_ln_sum(F.transform("both", lambda s: s["g"])), lm=_ln_sum(F.transform("both", lambda s: s["m"])), none=F.when(F.col("v") < 0.5, F.pow(1 - 2 * F.col("v"), F.col("number"))).otherwise(pop_vaf))
    x = once(x, share=1 / (1 + F.exp(F.col("lg") - F.col("lm"))), pg=F.col("lg") + _ln(F.col("none")), pm=F.col("lm") + _ln(1 - F.col("none")))
    has = F.col("mut.n") > 0
    p = 1 / (1 + F.exp(F.col("pg") - F.col("pm")))
    mosaic = has & (F.col("pm") > F.col("pg"))
    halves = (has & (F.col("share") < 0.5)) | (~has & (F.col("share") > 0.5))
    where_known = lambda c: F.when(F.col("known"), c)
    return x.select(
        *CANDIDATE, "cluster", "barcode", where_known(F.when(halves, 0.5).otherwise(1 - F.col("share"))).alias("l_germline"), where_known(F.when(halves, 0.5).otherwise(F.col("share"))).alias("l_mosaic"),
        where_known(F.when(mosaic, "mosaic").otherwise("germline")).alias("genotype"), where_known(F.when(mosaic, "0/1").otherwise("0/0")).alias("Gi"), "depth",
        where_known(F.col("mut.n") / F.col("depth")).alias("vaf"), where_known(F.when(has, p).otherwise(F.least(p, F.lit(0.5)))).alias("p_mosaic"),
    )
