"""One query for each operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions import genome as G
from spotweave.functions import prob
from spotweave.operators import events as E
from spotweave.operators import features as X
from spotweave.operators import genotype as T
from spotweave.operators import filters, grouped, histograms, individual, intervals, ml, phasing, signatures, spot_genotype as spot_level
from spotweave.operators import read_features as read_level
from spotweave.operators import reads as R
from spotweave.plans import demo
from spotweave.session import ship
from spotweave.sources.text import parse_pileup_bases, vcf_lines
from spotweave.tables import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, folder: f(ship(spark), folder)
    return f


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _sites(s: SparkSession, d: str) -> DataFrame:
    return E.site_counts(demo.events(s, d))


def _consensus(s: SparkSession, d: str) -> DataFrame:
    return E.umi_consensus(E.agg_umi(demo.events(s, d)))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    return E.agg_cluster(E.spot_histogram(_consensus(s, d)), demo.clusters(s).select("barcode", "cluster"))


def _individuals(s: SparkSession, d: str) -> DataFrame:
    return E.agg_individual(_clusters(s, d))


def _mutants(s: SparkSession, d: str) -> DataFrame:
    return E.top_alternative(_individuals(s, d)).where("alt is not null").select("chrom", "pos", F.col("alt").alias("mutant"))


@query
def classify_candidates(s, d):
    return E.classify_candidates(E.filter_min_info_depth(_sites(s, d))).withColumn("vaf", r6("vaf"))


@query
def order_alleles_by_count(s, d):
    return E.order_alleles_by_count(_sites(s, d))


@query
def agg_umi(s, d):
    return E.agg_umi(demo.events(s, d)).select("chrom", "pos", "barcode", "umi", "nA", "nT", "nC", "nG", "reads", "reverse", "strand")


@query
def umi_consensus(s, d):
    return _consensus(s, d).select("chrom", "pos", "barcode", "umi", "allele", "phred", "strand")


@query
def check_errors(s, d):
    return E.check_errors(E.agg_umi(demo.events(s, d))).groupBy("chrom", "pos").agg(F.count_if("pcr").alias("pcr"), F.count("lysis_alt").alias("lysis"))


@query
def site_error_allele(s, d):
    return E.site_error_allele(E.agg_umi(demo.events(s, d)))


@query
def site_strand(s, d):
    return E.site_strand(E.agg_umi(demo.events(s, d)))


@query
def agg_spot(s, d):
    return E.agg_spot(_consensus(s, d))


@query
def agg_cluster(s, d):
    return _clusters(s, d)


@query
def agg_individual(s, d):
    return _individuals(s, d)


@query
def allele_filter_binom(s, d):
    return E.allele_filter_binom(_clusters(s, d))


@query
def join_cluster_vaf_calc(s, d):
    return E.join_cluster_vaf_calc(_clusters(s, d), _mutants(s, d)).withColumn("cluster_vaf", r6("cluster_vaf"))


@query
def agg_barcode_totals(s, d):
    return E.agg_barcode_totals(demo.events(s, d))


@query
def cell_number(s, d):
    totals = demo.events(s, d).select("barcode", F.concat_ws("_", "chrom", F.col("pos").cast("string"), "umi").alias("umi"))
    return E.cell_number(E.agg_barcode_totals(totals), demo.clusters(s).select("barcode", "cluster"))


def _likelihoods(s: SparkSession, d: str) -> DataFrame:
    hist = E.spot_histogram(_consensus(s, d)).groupBy("chrom", "pos", "ref", "allele", "phred").agg(F.sum("n").alias("n")).where("phred >= 20")
    alt = _mutants(s, d).withColumnRenamed("mutant", "alt")
    return T.with_likelihoods(T.error_sums(hist.join(alt, ["chrom", "pos"]), F.col("alt")))


@query
def genotype_likelihood(s, d):
    return _likelihoods(s, d).select("chrom", "pos", "alt", "r", "a", *[F.round(f"l_{g}", 4).alias(f"l_{g}") for g in T.GENOTYPES])


@query
def individual_posterior(s, d):
    known = T.join_prior_left(_likelihoods(s, d), _priors(s, d))
    of = lambda base: F.element_at(F.array(*[F.col(f"f{b}") for b in G.BASES]), G.base_rank(F.col(base)) + 1)
    out = T.individual_posterior(known.withColumn("fref", of("ref")).withColumn("falt", of("alt")))
    return out.select("chrom", "pos", "alt", "genotype", F.round("p_mosaic", 4).alias("p_mosaic"), r6("vaf").alias("vaf"))


@query
def spot_posterior(s, d):
    alt = _mutants(s, d).withColumnRenamed("mutant", "alt")
    hist = E.spot_histogram(_consensus(s, d)).where("phred >= 20").join(alt, ["chrom", "pos"])
    e = F.pow(F.lit(10.0), -F.col("phred") / 10)
    is_ref, is_alt = F.col("allele") == F.col("ref"), F.col("allele") == F.col("alt")
    spots = hist.groupBy("chrom", "pos", "barcode").agg(
        F.sum(F.when(is_ref, F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(is_alt, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(is_ref, F.col("n") * F.log(1 - e)).otherwise(0.0)).alias("ref_right"),
        F.sum(F.when(is_alt, F.col("n") * F.log(e)).otherwise(0.0)).alias("alt_wrong"), F.sum(F.when(is_ref, F.col("n") * e).when(is_alt, F.col("n") * (1 - e)).otherwise(0.0)).alias("expected_alt"),
    )
    vaf = E.join_cluster_vaf_calc(_clusters(s, d), _mutants(s, d)).select("chrom", "pos", "cluster", "cluster_vaf")
    joined = spots.join(demo.clusters(s).select("barcode", "cluster"), "barcode", "left").join(vaf, ["chrom", "pos", "cluster"], "left").join(cell_number(s, d).select("barcode", F.col("refined_cell_num").alias("cells")), "barcode", "left")
    return T.spot_posterior(joined).select("chrom", "pos", "barcode", "r", "a", "g_spot", F.round("p_mosaic", 4).alias("p_mosaic"))


_TEXTS = [*histograms.COUNTS, *[f"q{b}" for b in G.BASES]]


def _spot_rows(s: SparkSession, d: str) -> DataFrame:
    return histograms.spot_histograms(written(histograms.spot_cells(_consensus(s, d))))


def _cluster_rows(s: SparkSession, d: str) -> DataFrame:
    return histograms.cluster_histograms(_spot_rows(s, d), demo.clusters(s).select("barcode", "cluster"))


def _individual_rows(s: SparkSession, d: str) -> DataFrame:
    return histograms.individual_histograms(histograms.filter_alleles(_cluster_rows(s, d)))


@query
def umi_histogram(s, d):
    out = histograms.with_texts(histograms.umi_histograms(demo.events(s, d)), "rank")
    return out.select("chrom", "pos", "barcode", "umi", "strand", *_TEXTS)


@query
def spot_histogram(s, d):
    return histograms.with_texts(_spot_rows(s, d), "rank").select("chrom", "pos", "strand", "ref", "alt", "barcode", "error_allele", *_TEXTS)


@query
def cluster_histogram(s, d):
    return histograms.with_texts(_cluster_rows(s, d), "name", 20).select("chrom", "pos", "strand", "ref", "alt", "cluster", "spot_number", *_TEXTS)


@query
def allele_filter_histogram(s, d):
    out = histograms.with_texts(histograms.filter_alleles(_cluster_rows(s, d)), "count", 20)
    return out.select("chrom", "pos", "strand", "ref", "alt", "cluster", "spot_number", *_TEXTS)


@query
def individual_histogram(s, d):
    return histograms.with_texts(_individual_rows(s, d), "name", 20).select("chrom", "pos", "strand", "ref", "alt", "spot_number", *_TEXTS)


def _germlines(s: SparkSession, d: str) -> DataFrame:
    return individual.germline_alleles(T.join_prior_left(_individual_rows(s, d), _priors(s, d)), most_depth=250)


@query
def individual_genotype(s, d):
    return individual.individual_genotypes(_germlines(s, d)).drop("cluster").withColumns({"p_mosaic": F.round("p_mosaic", 4), "vaf_hat": r6("vaf_hat")})


@query
def individual_germline(s, d):
    out = individual.germline_report(_germlines(s, d))
    return out.withColumns({"prior1": r6(F.get("germ_prior", F.lit(0))), "prior2": r6(F.get("germ_prior", F.lit(1)))}).drop("germ_prior")


@query
def spot_genotype(s, d):
    spots = written(_spot_rows(s, d))
    clusters = demo.clusters(s).select("barcode", "cluster")
    kept = written(histograms.filter_alleles(histograms.cluster_histograms(spots, clusters)))
    known = T.join_prior_left(histograms.individual_histograms(kept), _priors(s, d))
    genotypes = written(individual.individual_genotypes(individual.germline_alleles(known, most_depth=250)))
    out = spot_level.spot_genotypes(spot_level.join_spots(spots, genotypes, clusters, spot_level.cluster_shares(kept, genotypes), cell_number(s, d)))
    return out.withColumns({c: F.round(c, 4) for c in ("l_germline", "l_mosaic", "p_mosaic")} | {"vaf": r6("vaf")})


@query
def downsample_hist(s, d):
    hist = E.spot_histogram(_consensus(s, d)).groupBy("chrom", "pos", "allele", "phred").agg(F.sum("n").alias("n"))
    return E.downsample_histogram(hist, 200)


@query
def prior_normalise(s, d):
    p = demo.table(s, d, "part").select(F.col("p_partkey").alias("pos"), _letter(F.col("p_partkey") % 4).alias("ref"), *[((F.col("p_partkey") * k) % 100 / 120).alias(f"f{b}") for k, b in ((7, "A"), (11, "T"), (13, "C"), (17, "G"))])
    return T.prior_normalise(p).select("pos", "ref", *[r6(f"f{b}").alias(f"f{b}") for b in G.BASES])


def _letter(i: Column) -> Column:
    return F.substr(F.lit("ATCG"), (i + 1).cast("int"), F.lit(1))


def _population(s: SparkSession, d: str) -> DataFrame:
    """(chrom, pos, ref, alt, af): known alternatives out of the parts."""
    k, site = F.col("p_partkey"), F.col("p_partkey") % 60
    return demo.table(s, d, "part").select(
        F.concat(F.lit("chr"), (1 + site % 3).cast("string")).alias("chrom"), (1000 + 4 * site).alias("pos"), _letter(k % 4).alias("ref"), _letter((k + 1 + F.col("p_size") % 3) % 4).alias("alt"), (F.col("p_size") / 100).alias("af")
    )


def _priors(s: SparkSession, d: str) -> DataFrame:
    return T.prior_normalise(filters.join_prior_lookup(_sites(s, d), _population(s, d)))


@query
def join_prior_left(s, d):
    sites = demo.table(s, d, "part").select(F.concat(F.lit("chr"), (1 + F.col("p_partkey") % 60 % 3).cast("string")).alias("chrom"), (1000 + 2 * (F.col("p_partkey") % 180)).alias("pos"), F.col("p_partkey").alias("depth"))
    return T.join_prior_left(sites, _priors(s, d)).select("chrom", "pos", "depth", *[r6(f"f{b}").alias(f"f{b}") for b in G.BASES])


@query
def rebin_coord(s, d):
    return demo.table(s, d, "events").select("event_id", E.rebin_coord(F.col("user_id"), 50).alias("x"))


@query
def win_gap_sessionize(s, d):
    return intervals.win_gap_sessionize(demo.dense_sites(s, d))


@query
def win_merge_intervals(s, d):
    return intervals.merge_intervals(demo.genes(s, d), ["chrom"], 5)


@query
def interval_join_gene_het(s, d):
    sites = _sites(s, d).select("chrom", "pos")
    return intervals.range_join(sites, demo.genes(s, d)).select("chrom", "pos", "gene", "start", "end")


@query
def interval_join_cluster_region(s, d):
    spans = intervals.win_gap_sessionize(demo.dense_sites(s, d)).select("chrom", "session", "start", (F.col("end") + 1).alias("end"))
    return intervals.interval_join(spans, demo.genes(s, d)).select("chrom", "session", "gene", F.least("start", "start2").alias("start"), F.greatest("end", "end2").alias("end"))


@query
def interval_left_gene(s, d):
    return intervals.interval_left_gene(_sites(s, d).select("chrom", "pos"), demo.genes(s, d))


@query
def interval_subtract_bed(s, d):
    return intervals.interval_flag(_sites(s, d).select("chrom", "pos"), demo.genes(s, d), "imprinted")


@query
def asof_mappability(s, d):
    tracks = demo.genes(s, d).groupBy("chrom", "start").agg(F.max("end").alias("end"), F.max(F.col("end") - F.col("start")).alias("score"))
    return intervals.asof_join(_sites(s, d).select("chrom", "pos"), tracks)


@query
def self_join_cluster_pairs(s, d):
    return intervals.near_pairs(demo.dense_sites(s, d), 10)


@query
def win_clustered_noise(s, d):
    kinds = E.top_alternative(_individuals(s, d)).where("alt is not null").select("chrom", "pos", F.concat("ref", F.lit(">"), "alt").alias("kind"))
    return intervals.clustered_noise(kinds, 60, 3, 0.3)


@query
def semi_pon(s, d):
    o = demo.table(s, d, "orders")
    return X.membership_flag(o.select("o_orderkey", "o_custkey"), demo.table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"], "pon")


@query
def semi_editing_db(s, d):
    return X.membership_flag(_sites(s, d).select("chrom", "pos"), demo.genes(s, d).select("chrom", F.col("start").alias("pos")), ["chrom", "pos"], "editing_database")


@query
def lookup_dbsnp(s, d):
    db = _sites(s, d).select("chrom", "pos", "ref", F.lit("A,G").alias("alts"), F.concat(F.lit("rs"), F.col("pos").cast("string")).alias("id"))
    return X.lookup_dbsnp(E.top_alternative(_individuals(s, d)).where("alt is not null").select("chrom", "pos", "ref", "alt"), db)


def _variants(s: SparkSession, d: str) -> DataFrame:
    x = E.top_alternative(_individuals(s, d)).where("alt is not null")
    up, down = _letter((F.col("pos") + 1) % 4), _letter((F.col("pos") + 2) % 4)
    return x.select("chrom", "pos", "ref", "alt", "spot_number", E.count_of(F.col("alt")).alias("alt_count"), (F.col("nA") + F.col("nT") + F.col("nC") + F.col("nG")).alias("depth"), up.alias("up"), down.alias("down"))


@query
def context_dna96(s, d):
    return _variants(s, d).select("chrom", "pos", G.context_dna96(F.col("up"), F.col("ref"), F.col("alt"), F.col("down")).alias("context"))


@query
def context_rna192(s, d):
    strand = F.when(F.col("pos") % 8 == 0, "-").otherwise("+")
    return _variants(s, d).select("chrom", "pos", G.context_rna192(F.col("up"), F.col("ref"), F.col("alt"), F.col("down"), strand).alias("context"))


def _spectrum(s: SparkSession, d: str) -> DataFrame:
    return X.fill_spectrum(X.mutation_spectrum(context_rna192(s, d)), X.all_contexts(s))


@query
def agg_mutation_spectrum(s, d):
    return _spectrum(s, d)


@query
def refine_spectrum(s, d):
    return X.refine_spectrum(_spectrum(s, d).select("context", "n"))


@query
def homopolymer(s, d):
    t = demo.table(s, d, "pages").select("page_id", F.translate(F.upper("html"), "OE", "AA").alias("seq"))
    return t.select("page_id", G.homopolymer(F.concat("seq", F.when(F.col("page_id") % 3 == 0, F.lit("TTTTTT")).otherwise(F.lit("C")))).alias("base"))


@query
def gc_content(s, d):
    return demo.table(s, d, "documents").select("doc_id", F.round(G.gc_content(F.col("text")), 9).alias("gc"))


@query
def cause_poly_alt(s, d):
    v = _variants(s, d)
    left = F.repeat("alt", (F.col("pos") % 7).cast("int"))
    return v.select("chrom", "pos", G.cause_poly_alt(F.substr(left, F.lit(1), F.lit(5)), F.col("alt"), F.col("down")).alias("poly"))


@query
def beta_binomial_sf(s, d):
    return _variants(s, d).select("chrom", "pos", "alt_count", "depth", r6(prob.beta_binomial_sf(F.col("alt_count").cast("double"), F.col("depth").cast("double"))).alias("p"))


def _errors(s: SparkSession, d: str) -> DataFrame:
    """(context, n): the spectrum of sites that look like errors."""
    sites = E.classify_candidates(E.filter_min_info_depth(_sites(s, d))).where("is_error")
    strand = F.when(F.col("pos") % 8 == 0, "-").otherwise("+")
    known = sites.select(G.context_rna192(_letter((F.col("pos") + 1) % 4), F.col("ref"), F.col("alt1"), _letter((F.col("pos") + 2) % 4), strand).alias("context"))
    return X.fill_spectrum(X.mutation_spectrum(known), X.all_contexts(s)).select("context", "n")


def _signatures(s: SparkSession, d: str) -> DataFrame:
    """(context, signature, value): three signatures out of the parts; the first leans to A>, the second to C>."""
    part = demo.table(s, d, "part").select((F.col("p_partkey") % 192).cast("int").alias("place"), "p_size").join(X.all_contexts(s), "place")
    first = lambda x: F.substring("context", 3, 1) == x
    values = {"Signature1": F.col("p_size") * F.when(first("A"), 9).otherwise(1), "Signature2": (F.col("p_size") % 11) * F.when(first("C"), 9).otherwise(1), "Signature3": (F.col("p_size") * 7) % 13}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("signature"), v.cast("double").alias("value")) for n, v in values.items()]))
    return part.select("context", each.alias("x")).groupBy("context", "x.signature").agg(F.sum("x.value").alias("value"))


@query
def signature_fit(s, d):
    weights = signatures.signature_weights(_errors(s, d), _signatures(s, d))
    return signatures.context_weights(_signatures(s, d), weights).select("context", r6("rweigh").alias("rweigh"))


@query
def hFDR(s, d):
    known = _signatures(s, d)
    weights = signatures.context_weights(known, signatures.signature_weights(_errors(s, d), known))
    sites = _variants(s, d).join(context_rna192(s, d), ["chrom", "pos"]).join(weights, "context")
    return X.hfdr(sites).select("chrom", "pos", r6("hfdr").alias("hfdr"))


@query
def binom_cdf_ase(s, d):
    hits = _clusters(s, d).join(_mutants(s, d), ["chrom", "pos"]).select("chrom", "pos", E.count_of(F.col("mutant")).alias("alt_count"), (F.col("nA") + F.col("nT") + F.col("nC") + F.col("nG")).alias("depth"), F.lit(0.1).alias("share")).where("depth > 0")
    return X.binom_cdf_ase(hits, ["chrom", "pos"]).withColumn("p_adj", r6("p_adj"))


@query
def bh_fdr(s, d):
    p = demo.table(s, d, "part").select(F.col("p_size").alias("g"), "p_partkey", F.when(F.col("p_partkey") % 11 == 0, None).otherwise((F.col("p_partkey") * 7919 % 1009 + 1) / 1010).alias("p"))
    return X.bh_fdr(p, ["g"]).select("p_partkey", r6("p_adj").alias("p_adj"))


def _ordered(s: SparkSession, d: str) -> DataFrame:
    """All sites with their alleles by count, region and het: whether the second allele is frequent."""
    x = E.order_alleles_by_count(_sites(s, d))
    return x.withColumns({"het": F.col("count2") / F.col("depth") >= 0.3, "region": F.floor((F.col("pos") - 1000) / 80)})


def _mosaics(s: SparkSession, d: str) -> DataFrame:
    """(chrom, pos, ref, region, germline, mutant, het): a site with a frequent second allele is heterozygous, and its third one is the mutant."""
    x = _ordered(s, d).where(F.when(F.col("het"), F.col("count3")).otherwise(F.col("count2")) > 0)
    germline = F.when(F.col("het"), F.array("ref", "allele2")).otherwise(F.array("ref"))
    return x.select("chrom", "pos", "ref", "region", germline.alias("germline"), F.when(F.col("het"), F.col("allele3")).otherwise(F.col("allele2")).alias("mutant"), "het")


def _phased(s: SparkSession, d: str) -> DataFrame:
    haplotypes = written(_haplotypes(s, d))
    return phasing.mutation_origin(phasing.phase_classify(phasing.phase_counts(haplotypes, phasing.haplotype_balance_gate(haplotypes), _mosaics(s, d))))


@query
def phase_classify(s, d):
    return _phased(s, d).select("chrom", "pos", "snp_pos", "mutant", "g1h1", "g1h2", "g2h1", "g2h2", "mh1", "mh2", "dp", "mut_allele", "haplo", "annotated_type")


@query
def mutation_origin(s, d):
    return _phased(s, d).select("chrom", "pos", "snp_pos", F.array_join("germline", ",").alias("germline"), "mut_origin")


@query
def cluster_events(s, d):
    sites = _mosaics(s, d).where("not het").select("chrom", "pos", F.get("germline", F.lit(0)).alias("germline"), "mutant")
    return phasing.cluster_events(intervals.near_pairs(sites.select("chrom", "pos"), 24), _calls(s, d), sites).withColumn("p", r6("p"))


@query
def agg_phase_summary(s, d):
    p = _phased(s, d).join(_sites(s, d).select("chrom", "pos", "ref"), ["chrom", "pos"]).select("chrom", "pos", "ref", F.col("mutant").alias("alt"), "snp_pos", (F.col("snp_pos") - F.col("pos")).alias("distance"), "mut_allele", "haplo")
    out = X.agg_phase_summary(p)
    return out.select("chrom", "pos", "max_support", "sum_support", "nearest_haplo", "most_haplo", X.win_merge_haplotype(F.col("most_haplo"), F.col("nearest_haplo")).alias("haplo"))


@query
def rule_filtration(s, d):
    v = _variants(s, d).withColumn("af", F.col("alt_count") / F.col("depth"))
    rules = {"ALT_ALLELE_COUNT": F.col("alt_count") < 3, "LOW_VAF": F.col("af") < 0.01, "HIGH_VAF": F.col("af") > 0.3, "LOW_SPOT_NUM": F.col("spot_number") < 30, "CLUSTER_EVENTS": F.col("pos") % 20 == 0}
    return X.rule_filtration(v, rules).select("chrom", "pos", "ref", "alt", "filter")


@query
def filter_pipeline(s, d):
    return X.filter_pipeline(demo.table(s, d, "orders"), {"dear": F.col("o_totalprice") > 100_000, "open": F.col("o_orderstatus") == "O"}).withColumn("pass_rate", r6("pass_rate"))


@query
def join_wide_features(s, d):
    v = _variants(s, d)
    known = _population(s, d).withColumnRenamed("af", "known_af")
    held = intervals.range_join(v.select(*X.KEY), demo.genes(s, d)).groupBy(*X.KEY).agg(F.count("*").alias("genes"))
    return X.join_wide_features(v.select(*X.KEY, "spot_number"), known, held)


def _spots(s: SparkSession, d: str) -> DataFrame:
    x = E.agg_spot(_consensus(s, d)).join(_mutants(s, d), ["chrom", "pos"]).join(demo.clusters(s), "barcode")
    depth = F.col("nA") + F.col("nT") + F.col("nC") + F.col("nG")
    alt = E.count_of(F.col("mutant"))
    return x.select("chrom", "pos", "barcode", "cluster", "x", "y", depth.alias("depth"), alt.alias("alt"), (alt / depth).alias("vaf"), F.when(alt > 0, 0.9).otherwise(0.1).alias("mut_prob"))


@query
def agg_site_spatial(s, d):
    spot = F.substring("barcode", 3, 9).cast("long")
    spots = _spots(s, d).withColumns({"mut_prob": (F.col("pos") * 7 + spot * 3) % 10 / 10, "l_mosaic": F.when(spot % 9 > 0, (F.col("pos") + spot * 5) % 8 / 10)})
    out = X.agg_site_spatial(spots.withColumn("depth", F.when(F.col("pos") % 5 == 0, 4).otherwise(F.col("depth"))))
    return out.select("chrom", "pos", "num_spots", "num_mut_spots", *[r6(c).alias(c) for c in ("mut_rate", "mut_rate_prob", "mut_rate_likelihood", "mut_rate_vaf", "vaf_max", "vaf_mean", "vaf_mean_mut", "vaf_median_mut", "r2")])


@query
def spatial_tests(s, d):
    return grouped.spatial_tests(_spots(s, d))


@query
def ranksum_rbc(s, d):
    reads = E.sample_fixed_n(demo.events(s, d), ["chrom", "pos"], "read_id", 2000).select("chrom", "pos", "qual", (F.col("base") != F.col("ref")).alias("is_alt"))
    return grouped.read_tests(reads, "qual")


@query
def sample_fixed_n(s, d):
    return E.sample_fixed_n(demo.events(s, d).select("chrom", "pos", "read_id"), ["chrom", "pos"], "read_id", 20)


@query
def agg_bam_qc(s, d):
    reads = demo.table(s, d, "lineitem").select((F.col("l_suppkey") % 4 * 85).alias("mapq"), (F.col("l_linenumber") % 6).alias("nm"))
    return X.agg_bam_qc(reads).withColumn("share", r6("share"))


@query
def phylo_matrix(s, d):
    support = _spots(s, d).select("chrom", "pos", "barcode", "alt", F.col("depth").alias("total"))
    return X.phylo_matrix(_mutants(s, d), demo.clusters(s), support, 3)


@query
def parse_pileup(s, d):
    text = F.concat(F.lit("^I."), F.repeat(F.lit(".,"), (F.col("p_size") % 5).cast("int")), F.lit("+2AG"), F.repeat(F.lit("t"), (F.col("p_partkey") % 3).cast("int")), F.lit("-1c$*"))
    return parse_pileup_bases(demo.table(s, d, "part").select(F.lit("chr1").alias("chrom"), F.col("p_partkey").alias("pos"), F.lit("a").alias("ref"), text.alias("bases")))


@query
def sink_vcf(s, d):
    v = rule_filtration(s, d).join(_variants(s, d).select("chrom", "pos", "alt_count", "depth"), ["chrom", "pos"])
    return vcf_lines(v, {"DP": ("depth", "Integer"), "ALT_DP": ("alt_count", "Integer")}).select("line")


@query
def ml_prepare(s, d):
    p = demo.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_size") / 50).alias("x_p"), F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_retailprice")).alias("y_rbc"))
    return X.ml_prepare(p, ["x_p"], ["y_rbc"]).select("p_partkey", r6("x_p").alias("x_p"), r6("y_rbc").alias("y_rbc"))


_FEATURES = [f"f{i}" for i in range(64)]


def _vectors(s: SparkSession, d: str) -> DataFrame:
    """Every embedding's components as columns; a fifth is held out by a hash of the id."""
    x = demo.table(s, d, "embeddings")
    held = F.crc32(F.col("vec_id").cast("string").cast("binary")) % 5 == 1
    return x.select("vec_id", (F.col("label") % 2).alias("label"), held.alias("held_out"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(_FEATURES)])


@query
def ml_random_forest(s, d):
    v = _vectors(s, d)
    return ml.random_forest(v.where("not held_out"), v.select("vec_id", "held_out", "label", *_FEATURES), _FEATURES, "label").select("vec_id", "held_out", "label", "predicted", "p1")


@query
def ml_logistic(s, d):
    v = _vectors(s, d)
    return ml.logistic(v.where("not held_out"), v.select("vec_id", "held_out", "label", *_FEATURES), _FEATURES, "label").select("vec_id", "held_out", "label", "predicted")


@query
def ml_pca(s, d):
    return ml.principal_components(_vectors(s, d).select("vec_id", *_FEATURES), _FEATURES).select("vec_id", "pc1", "pc2", "outlier")


@query
def dbscan_subdomain(s, d):
    return grouped.dbscan_subdomain(demo.clusters(s))


@query
def union_distinct(s, d):
    v = _variants(s, d).select("chrom", "pos", "ref", "alt")
    return v.where("pos < 1120").union(v.where("pos > 1080")).distinct()


@query
def set_except(s, d):
    v = _variants(s, d).select("chrom", "pos", "alt")
    starts = demo.genes(s, d).select("chrom", F.col("start").alias("pos"))
    return v.join(starts, ["chrom", "pos"], "left_anti").join(_population(s, d), ["chrom", "pos", "alt"], "left_semi").select("chrom", "pos").distinct()


@query
def sort_chrom_aware(s, d):
    n, name = G.chromosome_order(F.col("chrom"))
    return _sites(s, d).select("chrom", "pos", n.alias("o"), name.alias("name")).orderBy("o", "name", "pos").select("chrom", "pos", "o")


@query
def umi_event_explode(s, d):
    return R.explode_reads(demo.reads(s, d), demo.read_sites(s, d))


@query
def filter_reads_quality(s, d):
    return R.filter_reads_quality(demo.reads(s, d)).select("read_id", "mapq", "nm")


@query
def filter_reads_by_barcode(s, d):
    return R.filter_reads_by_barcode(demo.reads(s, d), demo.clusters(s).where("cluster = '1'")).select("read_id", F.col("cb").alias("barcode"))


@query
def sample_reservoir(s, d):
    k = F.col("p_partkey")
    start = k % 12 * 25
    regions = demo.table(s, d, "part").select(F.concat(F.lit("chr"), (1 + k % 3).cast("string")).alias("chrom"), start.alias("start"), (start + 25 + k % 4 * 10).alias("end")).distinct()
    key = F.conv(F.substring(F.md5(F.col("read_id").cast("string")), 1, 15), 16, 10).cast("long")
    return R.sample_reservoir(demo.reads(s, d), regions, 150, key=key)


@query
def read_features(s, d):
    out = read_level.read_features(read_level.observations(demo.reads(s, d), demo.read_variants(s, d)))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _germline(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return demo.table(s, d, "part").select(
        F.concat(F.lit("chr"), (1 + k % 4).cast("string")).alias("chrom"), k.alias("pos"), F.when(F.col("p_size") % 5 == 0, "hom").otherwise("het").alias("genotype"),
        (k * 7 % 60).alias("count1"), (k * 13 % 60).alias("count2"), (k % 9 / 10).alias("prior1"), (k % 7 / 10).alias("prior2"),
    )


@query
def filter_informative_het(s, d):
    return filters.filter_informative_het(_germline(s, d), 5, 0.05, 30).select("chrom", "pos", "count1", "count2")


@query
def filter_ase_germline(s, d):
    return filters.filter_ase_germline(_germline(s, d)).select("chrom", "pos", "count1", "count2", r6("p").alias("p"))


@query
def filter_gene_bed(s, d):
    named = demo.genes(s, d).withColumn("gene", F.when(F.col("start") % 7 == 0, F.concat(F.lit("MT-"), "gene")).otherwise(F.col("gene")))
    return filters.filter_gene_bed(named, ["chr1", "chr2", "chr3"]).select("chrom", "start", "end", "gene")


@query
def mask_placeholder_priors(s, d):
    k = F.col("p_partkey")
    p = demo.table(s, d, "part").select("p_partkey", *[F.when(k % 5 == 0, 1.0).when(k % 5 == 1, 0.0).otherwise(k * m % 10 / 10).alias(f"f{b}") for b, m in zip(G.BASES, (1, 2, 3, 4), strict=True)])
    return filters.mask_placeholder_priors(p, [f"f{b}" for b in G.BASES])


@query
def null_normalise(s, d):
    text = F.element_at(F.array(*[F.lit(x) for x in (*filters.MISSING, "yes", "0")]), (F.col("p_size") % 7 + 1).cast("int"))
    return demo.table(s, d, "part").select("p_partkey", filters.null_normalise(text).alias("x"))


@query
def zero_to_null(s, d):
    return demo.table(s, d, "part").select("p_partkey", filters.zero_to_null(F.col("p_size") % 4).cast("long").alias("x"))


@query
def extract_barcode_umi(s, d):
    tags = demo.table(s, d, "events").select("event_id", F.col("user_id").alias("Cx"), F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 777).alias("Cy"), F.concat(F.lit(" "), "event_type").alias("UR"))
    return filters.extract_barcode_umi(tags, "stereo", 50).select("event_id", "barcode", "umi")


@query
def barcode_to_cell(s, d):
    cells = demo.clusters(s).select("barcode", F.concat(F.lit("cell"), "cluster").alias("cell")).where("cell <> 'cell3'")
    return filters.barcode_to_cell(demo.events(s, d).select("read_id", "barcode", "umi"), cells).select("read_id", "barcode", "umi")


@query
def join_prior_lookup(s, d):
    return filters.join_prior_lookup(_sites(s, d), _population(s, d))


@query
def RNA_editing(s, d):
    known = demo.genes(s, d).select("chrom", F.col("start").alias("pos")).distinct()
    flagged = X.membership_flag(context_rna192(s, d), known, ["chrom", "pos"], "editing_database").withColumn("editing_AtoG", F.contains("context", F.lit("A>G")))
    return flagged.select("chrom", "pos", "editing_database", "editing_AtoG", (F.col("editing_database") | F.col("editing_AtoG")).alias("RNA_editing"))


@query
def agg_cluster_spatial(s, d):
    out = filters.agg_cluster_spatial(_spots(s, d))
    return out.select("chrom", "pos", "cluster", "spot_count", "depth", "mutant_allele_num", "has_mutant_allele", "high_prob", *[r6(c).alias(c) for c in ("vaf", "vaf_unnom", "mutant_prop_vaf", "mutant_prop_prob")])


@query
def cross_mosaic_hsnp(s, d):
    snps = _ordered(s, d).where("het")  # with or without a third allele
    return phasing.cross_mosaic_hsnp(_mosaics(s, d).select("chrom", "pos", "region"), snps.select("chrom", "pos", "region"))


def _mosaic_pairs(s: SparkSession, d: str) -> DataFrame:
    """The pairs whose germline site has a mutant too, as the SQL of the haplotype queries takes them."""
    sites = _mosaics(s, d)
    return phasing.cross_mosaic_hsnp(sites.select("chrom", "pos", "region"), sites.where("het").select("chrom", "pos", "region"))


def _calls(s: SparkSession, d: str) -> DataFrame:
    """(chrom, pos, molecule, base) of molecules of sufficient quality."""
    return _consensus(s, d).select("chrom", "pos", F.concat_ws("_", "barcode", "umi").alias("molecule"), F.when(F.col("phred") >= 20, F.col("allele")).alias("base"))


def _haplotypes(s: SparkSession, d: str) -> DataFrame:
    return phasing.agg_phase_haplotypes(_mosaic_pairs(s, d), written(_calls(s, d)))


@query
def agg_phase_haplotypes(s, d):
    return _haplotypes(s, d)


@query
def haplotype_balance_gate(s, d):
    return phasing.haplotype_balance_gate(_haplotypes(s, d))


@query
def discordant_prop(s, d):
    k = F.col("p_partkey")
    item = lambda name, n: F.concat(F.lit(f"{name}:"), n.cast("string"))
    details = F.when(k % 8 == 0, item("AG", k)).otherwise(F.concat_ws(";", item("AG", k % 50), item("AT", k * 3 % 17), item("CG", k * 5 % 11), F.when(k % 2 == 0, item("CT", k * 7 % 13))))
    return demo.table(s, d, "part").select("p_partkey", r6(phasing.discordant_prop(details)).alias("prop"))


@query
def fisher_2x2(s, d):
    dear, back = F.col("l_quantity") > 25, F.col("l_returnflag") == "A"
    cells = {"a": dear & back, "b": dear & ~back, "c": ~dear & back, "d": ~dear & ~back}
    x = demo.table(s, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(*[F.count_if(c).cast("double").alias(n) for n, c in cells.items()])
    return x.select("l_suppkey", "l_linenumber", r6(prob.fisher_two_sided(*map(F.col, "abcd"))).alias("p"))


@query
def union_all(s, d):
    c = demo.table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(demo.table(s, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")))
