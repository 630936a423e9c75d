"""From base events to candidates, molecules, spots, clusters and individuals.

Events have (chrom, pos, barcode, umi, base, qual, is_reverse, ref). Everything is grouped by keys that begin with
(chrom, pos), with partial aggregation before each shuffle, so a site of great depth is many partial rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.functions.genome import BASES, base_rank
from spotweave.functions.expressions import bind
from spotweave.functions.prob import binom_sf, miss_to_phred, phred_to_q

SITE = ["chrom", "pos"]


def usable_events(events: DataFrame) -> DataFrame:
    """Events of a plain base with a quality from 0 to 40."""
    return events.where(F.col("base").isin(*BASES) & F.col("qual").between(0, 40))


def site_counts(events: DataFrame) -> DataFrame:
    """(chrom, pos, ref, nA, nT, nC, nG, depth) of each site."""
    counts = [F.count_if(F.col("base") == b).alias(f"n{b}") for b in BASES]
    return events.groupBy("chrom", "pos", "ref").agg(*counts, F.count("*").alias("depth"))


def order_alleles_by_count(sites: DataFrame) -> DataFrame:
    """The reference first, then the others by count, ties in the order A, T, C, G: columns allele1..4 and count1..4."""
    alleles = F.array(*[F.struct((F.col("ref") != b).alias("other"), (-F.col(f"n{b}")).alias("minus"), F.lit(i).alias("rank"), F.lit(b).alias("base"), F.col(f"n{b}").alias("n")) for i, b in enumerate(BASES)])
    ordered = sites.withColumn("_a", F.array_sort(alleles))
    picked = [c for i in range(4) for c in (F.col("_a")[i]["base"].alias(f"allele{i + 1}"), F.col("_a")[i]["n"].alias(f"count{i + 1}"))]
    return ordered.select("chrom", "pos", "ref", "depth", *picked)


def filter_min_info_depth(sites: DataFrame, least: int = 30) -> DataFrame:
    return sites.where(F.col("depth") >= least)


def classify_candidates(sites: DataFrame) -> DataFrame:
    """Sites that may be errors (nearly all reference) or somatic (a few to 60 % alternative)."""
    known = order_alleles_by_count(sites).where(F.col("ref") != "N")
    vaf = F.col("count2") / F.col("depth")
    error = (F.col("depth") >= 100) & (F.col("count1") / F.col("depth") >= 0.95) & (F.col("count2") >= 5)
    somatic = (F.col("count2") >= 5) & (F.col("depth") >= 30) & (vaf >= 0.001) & (vaf <= 0.6)
    out = known.select("chrom", "pos", "ref", F.col("allele2").alias("alt1"), somatic.alias("is_somatic"), error.alias("is_error"), F.col("depth").alias("total_depth"), F.col("count1").alias("ref_depth"), F.col("count2").alias("alt1_depth"), vaf.alias("vaf"))
    return out.where("is_somatic or is_error")


MOLECULE = ["chrom", "pos", "ref", "barcode", "umi"]


def agg_umi(events: DataFrame, also: Sequence[str] = (), *more: Column) -> DataFrame:
    """Each molecule's counts, log-likelihood sums and strand ('-' on a tie).

    also: further key columns, as where a site has several variants; more: further aggregates.
    """
    q = phred_to_q(F.col("qual"))
    per = []
    for b in BASES:
        here = F.col("base") == b
        # Quality 0 means certain error: its logarithm is bounded, so that sums stay finite.
        per += [F.count_if(here).alias(f"n{b}"), F.sum(F.when(here, F.log(F.greatest(q, F.lit(1e-12)))).otherwise(0.0)).alias(f"r{b}"), F.sum(F.when(here, -F.col("qual") / 10 * F.log(F.lit(10.0))).otherwise(0.0)).alias(f"e{b}")]
    out = usable_events(events).groupBy(*MOLECULE, *also).agg(*per, F.count("*").alias("reads"), F.count_if("is_reverse").alias("reverse"), *more)
    return out.withColumn("strand", F.when(F.col("reads") - F.col("reverse") > F.col("reverse"), "+").otherwise("-"))


def umi_consensus(umis: DataFrame, weight: float = 0.5) -> DataFrame:
    """The molecule's allele and its phred: the likeliest base under sequencing and PCR errors, the reference on a tie, then A, T, C, G.

    Likelihoods are bound as one array, so a condition on allele or phred repeats them once and not for every use.
    """
    no_pcr = (1 - 1e-6) ** 100
    pcr = F.array(*[F.pow(F.lit(10.0), -6.0 * (F.col(f"n{b}") + 0.5) / (F.col("reads") + 2)) for b in BASES])
    right = F.exp(sum((F.when(F.col(f"n{b}") > 0, F.col(f"r{b}")).otherwise(0.0) for b in BASES), F.lit(0.0)))

    def likelihoods(x: Column) -> Column:
        like = []
        for i, b in enumerate(BASES):
            others = [j for j in range(4) if j != i]
            errors = [F.get(x["pcr"], F.lit(j)) for j in others]
            pro = F.exp(F.col(f"r{b}") + sum((F.col(f"e{BASES[j]}") for j in others), F.lit(0.0)))
            like.append(F.when(F.col(f"n{b}") > 0, weight * no_pcr * pro + (1 - weight) * x["right"] * F.least(*errors)).otherwise(x["right"] * (errors[0] * errors[1] * errors[2])))
        return F.array(*like)

    def phreds(l: Column) -> Column:
        at = [F.get(l, F.lit(i)) for i in range(4)]
        total = at[0] + at[1] + at[2] + at[3]
        miss = lambda i: sum((at[j] for j in range(4) if j != i), F.lit(0.0)) / total
        return F.array(*[F.when(total <= 0, F.lit(0)).otherwise(miss_to_phred(miss(i))) for i in range(4)])

    def best(p: Column) -> Column:
        most = F.array_max(p)
        own = F.get(p, base_rank(F.col("ref")))
        return F.struct(F.when(own >= most, F.col("ref")).otherwise(F.get(F.array(*map(F.lit, BASES)), (F.array_position(p, most) - 1).cast("int"))).alias("allele"), most.alias("phred"))

    call = bind(bind(bind(F.struct(pcr.alias("pcr"), right.alias("right")), likelihoods), phreds), best)
    kept = [c for c in umis.columns if c not in {"reverse", *[f"{k}{b}" for k in "re" for b in BASES]}]
    return umis.select(*kept, call.alias("_call")).select(*kept, "_call.allele", "_call.phred")


def check_errors(umis: DataFrame, threshold: int = 3) -> DataFrame:
    """pcr: a non-reference base of at least `threshold` besides another; lysis_alt: more than `threshold` of one non-reference base alone."""
    filled = sum((F.col(f"n{b}") > 0).cast("int") for b in BASES)
    pcr = F.greatest(*[F.when(F.col("ref") != b, F.col(f"n{b}")).otherwise(0) for b in BASES]) >= threshold
    lysis = F.coalesce(*[F.when((F.col("ref") != b) & (F.col(f"n{b}") > threshold) & (filled == 1), b) for b in BASES])
    return umis.withColumn("pcr", pcr & (filled >= 2)).withColumn("lysis_alt", lysis)


def site_error_allele(umis: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt): sites where exactly one molecule shows a lysis error."""
    found = check_errors(umis).groupBy("chrom", "pos", "ref").agg(F.count("lysis_alt").alias("n"), F.max("lysis_alt").alias("alt"))
    return found.where("n = 1").select("chrom", "pos", "ref", "alt")


def site_strand(umis: DataFrame) -> DataFrame:
    """The majority strand of a site's molecules, '-' on a tie."""
    out = umis.groupBy("chrom", "pos").agg(F.count_if(F.col("strand") == "+").alias("plus"), F.count_if(F.col("strand") == "-").alias("minus"))
    return out.select("chrom", "pos", F.when(F.col("plus") > F.col("minus"), "+").otherwise("-").alias("strand"))


def _histogram_sum(base: str) -> list[Column]:
    here = F.col("allele") == base
    return [F.count_if(here).alias(f"n{base}"), F.sum(F.when(here, F.col("phred")).otherwise(0)).alias(f"q{base}")]


def agg_spot(consensus: DataFrame) -> DataFrame:
    """Molecules and phred sums of each base for every (site, barcode)."""
    return consensus.groupBy("chrom", "pos", "ref", "barcode").agg(*[c for b in BASES for c in _histogram_sum(b)])


def spot_histogram(consensus: DataFrame) -> DataFrame:
    """(site, barcode, allele, phred, n): the histograms, one row a cell; cells of clusters and sites are sums of these."""
    return consensus.groupBy("chrom", "pos", "ref", "barcode", "allele", "phred").agg(F.count("*").alias("n"))


def join_cluster_inner(spots: DataFrame, clusters: DataFrame) -> DataFrame:
    """Spots with their cluster; unclustered ones go. The optimiser broadcasts the map only while it is small."""
    return spots.join(clusters, "barcode")


def agg_cluster(histogram: DataFrame, clusters: DataFrame, least_quality: int = 20) -> DataFrame:
    """Molecules of sufficient quality for each (site, cluster), and the number of its spots there."""
    joined = join_cluster_inner(histogram, clusters)
    good = F.when(F.col("phred") >= least_quality, F.col("n")).otherwise(0)
    return joined.groupBy("chrom", "pos", "ref", "cluster").agg(F.count_distinct("barcode").alias("spot_number"), *[F.sum(F.when(F.col("allele") == b, good).otherwise(0)).alias(f"n{b}") for b in BASES])


def agg_individual(clusters: DataFrame) -> DataFrame:
    """Clusters summed to the individual."""
    return clusters.groupBy("chrom", "pos", "ref").agg(F.sum("spot_number").alias("spot_number"), *[F.sum(f"n{b}").alias(f"n{b}") for b in BASES])


def allele_filter_binom(clusters: DataFrame, error: float = 0.003, alpha: float = 0.05) -> DataFrame:
    """A base survives at a site if in any cluster its count is above what errors explain; others' counts become 0."""
    depth = sum(F.col(f"n{b}") for b in BASES).cast("double")
    keep = {b: (F.col(f"n{b}") > 0) & (binom_sf(F.col(f"n{b}").cast("double"), depth, F.lit(error)) < alpha) for b in BASES}
    site = Window.partitionBy(*SITE)
    flagged = clusters.select("*", *[F.coalesce(F.bool_or(keep[b]).over(site), F.lit(False)).alias(f"k{b}") for b in BASES])
    return flagged.select(*[F.when(F.col(f"k{c[1]}"), F.col(c)).otherwise(0).alias(c) if c in {f"n{b}" for b in BASES} else F.col(c) for c in clusters.columns])


def top_alternative(counts: DataFrame) -> DataFrame:
    """alt: the non-reference base of the greatest count, ties in the order A, T, C, G; null if none."""
    found = F.array(*[F.when((F.col("ref") != b) & (F.col(f"n{b}") > 0), F.struct((-F.col(f"n{b}")).alias("m"), F.lit(i).alias("i"), F.lit(b).alias("b"))) for i, b in enumerate(BASES)])
    return counts.withColumn("alt", F.array_min(found)["b"])


def count_of(base: Column) -> Column:
    """The count column n<base> of a row."""
    return F.element_at(F.array(*[F.col(f"n{b}") for b in BASES]), base_rank(base) + 1)


def join_cluster_vaf_calc(clusters: DataFrame, mutants: DataFrame) -> DataFrame:
    """The mutant's share in every cluster of its site; mutants has (chrom, pos, mutant)."""
    depth = sum(F.col(f"n{b}") for b in BASES)
    return clusters.join(mutants, SITE).select("chrom", "pos", "ref", "mutant", "cluster", "spot_number", depth.alias("depth"), F.when(depth > 0, count_of(F.col("mutant")) / depth).alias("cluster_vaf"))


def agg_barcode_totals(events: DataFrame) -> DataFrame:
    """Distinct molecules and reads of each barcode."""
    return events.groupBy("barcode").agg(F.count_distinct("umi").alias("n_umi"), F.count("*").alias("reads"))


def cell_number(totals: DataFrame, clusters: DataFrame, scale: int = 20, most: int = 25) -> DataFrame:
    """Cells of each barcode: its molecules over the median of the cluster with the most molecules."""
    joined = totals.join(clusters, "barcode")
    sums = joined.groupBy("cluster").agg(F.sum("n_umi").alias("s"), F.expr("percentile(n_umi, 0.5)").alias("median"))
    middle = sums.agg(F.max_by("median", F.struct(F.col("s"), F.col("cluster"))).alias("median"))
    cells = F.when(F.col("median") > 0, F.least(F.lit(most), F.ceil(F.round(scale * F.col("n_umi") / F.col("median"), 9)))).otherwise(1)
    return joined.crossJoin(F.broadcast(middle)).select("barcode", "cluster", "n_umi", cells.cast("long").alias("refined_cell_num"))  # middle is one row


def downsample_histogram(histogram: DataFrame, depth: int) -> DataFrame:
    """Counts of a site scaled to at most `depth` in all, rounded half to even."""
    total = F.sum("n").over(Window.partitionBy(*SITE))
    return histogram.withColumn("n", F.when(total > depth, F.bround(F.col("n") * (F.lit(float(depth)) / total))).otherwise(F.col("n")).cast("long"))


def sample_fixed_n(rows: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group by the order of a hash of their id: the same whenever it runs."""
    order = Window.partitionBy(*keys).orderBy((F.col(id_col) * 7919 + seed) % 104_729, id_col)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def rebin_coord(x: Column, bins: int) -> Column:
    return (F.ceil(x / bins) * bins).cast("long")
