"""What the reads of a variant look like: rank sums of ten measures, four exact tests, shares and averages, one row a site.

Reads meet the sites by small bins of positions; the distinct sites are written first, so that Spark knows their size when it
plans the join and reads needn't be shuffled for a short list. All rank sums come from one table of counts, (site, measure,
value) with the numbers of the two samples: it is aggregated partially before its shuffle, so a deep site is many partial rows,
and a window over a site's measure has a row for each distinct value, of which there are as many as qualities, places in a
read or lengths. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.functions.expressions import once
from spotweave.functions.genome import BASES, base_rank
from spotweave.functions.prob import bh_adjusted, fisher_two_sided, normal_sf
from spotweave.operators.events import agg_umi, umi_consensus
from spotweave.operators.reads import USE_REFERENCE, aligned_blocks
from spotweave.tables import written

SITE = ["chrom", "pos", "ref", "alt"]

#: Positions in a bin of the join, about as many as a short run of bases has: a run meets few sites that it doesn't cover.
NEAR = 32

#: CIGAR operations (fixed values): insertion, deletion, soft and hard clip.
INSERTION, DELETION, SOFT, HARD = 1, 2, 4, 5

#: Soft-clipped bases above which a read counts as clipped; the quality that stands for a unique place.
CLIPPED, UNIQUE = 10, 255

#: Rank sums by name, and whether the first sample is expected to be greater (else two-sided). The reference's reads come first,
#: except for alt_baseq1b: the base behind the alternative against the alternative.
RANKED = {"baseq": True, "alt_baseq1b": True, "querypos": False, "leftpos": False, "seqpos": False, "per_UMI_end_remove_clip": False, "mismatches": False, "mapq": True, "read_number": False, "softclip_length": False}

#: All tests, in the order in which they are adjusted.
TESTS = ("baseq", "alt_baseq1b", "querypos", "leftpos", "seqpos", "per_UMI_end_remove_clip", "mismatches", "mapq", "read_number", "softclip_length", "softclip_prop", "reads_with_indel", "multi_mapper", "strand_bias")


def _clip(cigar: Column, op: int, last: bool) -> Column:
    """The length of a clip at one end of the read; a soft one may stand inside a hard one."""
    n = F.size(cigar)
    at = lambda i: F.get(cigar, n - 1 - i if last else F.lit(i))
    here = F.when(at(0)["op"] == op, at(0)["len"])
    return F.coalesce(here if op == HARD else F.coalesce(here, F.when((at(0)["op"] == HARD) & (at(1)["op"] == SOFT), at(1)["len"])), F.lit(0)).cast("int")


def indel_blocks(cigar: Column, ref_start: Column) -> Column:
    """(op, start, len) of each insertion and deletion: the reference positions, from 0, behind the base that it follows."""
    block = "struct<op:int,start:bigint,len:int>"
    begin = F.struct(ref_start.cast("long").alias("start"), F.array().cast(f"array<{block}>").alias("blocks"))

    def step(s: Column, c: Column) -> Column:
        here = F.array(F.struct(c["op"].cast("int").alias("op"), s["start"].alias("start"), c["len"].cast("int").alias("len")))
        return F.struct(
            (s["start"] + F.when(c["op"].isin(*USE_REFERENCE), c["len"].cast("long")).otherwise(F.lit(0).cast("long"))).alias("start"),
            F.when(c["op"].isin(INSERTION, DELETION), F.concat(s["blocks"], here)).otherwise(s["blocks"]).alias("blocks"),
        )

    return F.aggregate(cigar, begin, step, lambda s: s["blocks"])


def observations(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """A row for each read with both tags and each variant (chrom, pos, ref, alt; pos from 1) on which it has a base or a gap.

    reads: as in `reads`, with nm (mismatches) and nh (places that it maps to). `deleted`: the position is deleted in the
    read, or among as many behind an insertion as that has bases; such a row has no base. Bases need a quality from 0 to 40.
    """
    c = F.col("cigar")
    soft = _clip(c, SOFT, False) + _clip(c, SOFT, True)
    tagged = reads.where("cb is not null and ub is not null").select(
        "read_id", "chrom", "seq", "quals", "is_reverse", "mapq", F.col("nm").alias("mismatches"), F.col("nh").alias("mappers"), F.col("ref_start").cast("long").alias("left"), F.col("cb").alias("barcode"), F.col("ub").alias("umi"),
        _clip(c, SOFT, False).alias("left_soft"), _clip(c, SOFT, True).alias("right_soft"), _clip(c, HARD, False).alias("left_hard"), _clip(c, HARD, True).alias("right_hard"), (F.length("seq") - soft).alias("cut"),
        aligned_blocks(c, F.col("ref_start")).alias("blocks"), indel_blocks(c, F.col("ref_start")).alias("indels"),
    )
    gap = F.transform(F.filter("indels", lambda d: d["op"] == DELETION), lambda d: F.struct(F.lit(None).cast("int").alias("at"), d["start"].alias("start"), d["len"].alias("len")))
    runs = tagged.withColumn("b", F.explode(F.concat("blocks", gap))).withColumn("bin", F.explode(F.sequence(F.floor((F.col("b.start") + 1) / NEAR), F.floor((F.col("b.start") + F.col("b.len")) / NEAR))))
    wanted = written(variants.select("chrom", F.col("pos").cast("long").alias("pos"), "ref", "alt").distinct()).withColumn("bin", F.floor(F.col("pos") / NEAR))
    met = runs.join(wanted, ["chrom", "bin"]).where((F.col("pos") > F.col("b.start")) & (F.col("pos") <= F.col("b.start") + F.col("b.len")))
    at = (F.col("b.at") + F.col("pos") - F.col("b.start") - 1).cast("int")
    covers = lambda blocks: F.exists(blocks, lambda d: (F.col("pos") > d["start"]) & (F.col("pos") <= d["start"] + d["len"]))
    follows = F.exists("blocks", lambda d: (F.col("pos") + 1 > d["start"]) & (F.col("pos") + 1 <= d["start"] + d["len"]))
    place = F.col("at") - F.col("left_soft")
    out = once(met.withColumn("at", at), deleted=F.col("at").isNull() | covers("indels")).withColumn("base", F.when(~F.col("deleted"), F.substr("seq", F.col("at") + 1, F.lit(1)))).withColumn("qual", F.when(~F.col("deleted"), F.get("quals", F.col("at"))))
    return out.where("deleted or qual between 0 and 40").select(
        *SITE, "read_id", "barcode", "umi", "deleted", "base", "qual", F.when(~F.col("deleted") & follows, F.get("quals", F.col("at") + 1)).alias("next_qual"), "mismatches", "mapq", "mappers", "is_reverse", "left",
        (F.col("left_soft") + F.col("right_soft")).alias("softclip"), F.size("indels").alias("n_indels"), (place + F.col("left_soft") + F.col("left_hard")).alias("query"), (F.col("cut") - place + F.col("right_soft") + F.col("right_hard")).alias("sequenced"),
        (F.when(F.col("is_reverse"), F.col("cut") - place).otherwise(place) / F.col("cut")).alias("end_share"),
    )


def molecules(observed: DataFrame) -> DataFrame:
    """(site, barcode, umi, nA, nT, nC, nG, reads, end_share, allele): counts, the median place and the likeliest base of each molecule."""
    return umi_consensus(agg_umi(observed.where(F.col("base").isin(*BASES)), ["alt"], F.expr("percentile(end_share, 0.5)").alias("end_share")))


def rank_sums(counts: DataFrame, keys: list[str], greater: Column) -> DataFrame:
    """(keys, p, rbc) of two samples given as counts: Wilcoxon's rank sum with average ranks by the normal approximation, and 2 U / (x y) - 1.

    counts: (keys, value, x, y), one row a value: how often it is in either sample. greater: whether the alternative is that the
    first sample is greater, else it is two-sided. Null where a sample is empty.
    """
    order = Window.partitionBy(*keys).orderBy("value")
    both = F.col("x") + F.col("y")
    ranked = counts.withColumn("rank", F.sum(both).over(order.rowsBetween(Window.unboundedPreceding, 0)) - (both - 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("x").cast("double").alias("n"), F.sum("y").cast("double").alias("m"), F.sum(F.col("x") * F.col("rank")).alias("r"))
    n, m, r = F.col("n"), F.col("m"), F.col("r")
    z = (r - n * (n + m + 1) / 2) / F.sqrt(n * m * (n + m + 1) / 12)
    known = (n > 0) & (m > 0)
    tested = sums.where(known).withColumn("z", z)
    p = F.when(greater, normal_sf(F.col("z"))).otherwise(F.least(F.lit(1.0), 2 * normal_sf(F.abs("z"))))
    return tested.select(*keys, p.alias("p"), (2 * (r - n * (n + 1) / 2) / (n * m) - 1).alias("rbc"))


def _measured(observed: DataFrame, molecule: DataFrame) -> DataFrame:
    """(site, measure, value, x, y): how often each value is in the two samples of each rank sum."""
    is_ref, is_alt = F.col("base") == F.col("ref"), F.col("base") == F.col("alt")
    of = lambda name, value, x: F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"), x.cast("long").alias("x"), (~x).cast("long").alias("y"))
    lessened = F.when(is_alt, F.greatest(F.col("mismatches") - 1, F.lit(0))).otherwise(F.col("mismatches"))  # the mutation is one itself
    plain = {"baseq": F.col("qual"), "querypos": F.col("query"), "leftpos": F.col("left"), "seqpos": F.col("sequenced"), "mismatches": lessened, "mapq": F.col("mapq"), "softclip_length": F.col("softclip")}
    behind = [F.when(is_alt, of("alt_baseq1b", F.col("next_qual"), F.lit(True))), F.when(is_alt, of("alt_baseq1b", F.col("qual"), F.lit(False)))]
    reads = observed.where(is_ref | is_alt).select(*SITE, F.explode(F.array(*[of(n, v, is_ref) for n, v in plain.items()], *behind)).alias("o"))
    called_ref, called_alt = F.col("allele") == F.col("ref"), F.col("allele") == F.col("alt")
    count = lambda base: F.element_at(F.array(*[F.col(f"n{b}") for b in BASES]), base_rank(base) + 1)
    each = [
        F.when(called_ref | called_alt, of("per_UMI_end_remove_clip", F.col("end_share"), called_ref)), F.when(count(F.col("ref")) > 0, of("read_number", count(F.col("ref")), F.lit(True))),
        F.when(count(F.col("alt")) > 0, of("read_number", count(F.col("alt")), F.lit(False))),
    ]
    both = reads.unionByName(molecule.select(*SITE, F.explode(F.array(*each)).alias("o"))).select(*SITE, "o.*")
    return both.where("value is not null").groupBy(*SITE, "measure", "value").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def _shares(observed: DataFrame) -> DataFrame:
    """Of each site's reads: the tables of the exact tests, means and shares."""
    is_ref, is_alt = F.col("base") == F.col("ref"), F.col("base") == F.col("alt")
    own = is_ref | is_alt
    n = lambda c: F.count_if(c).cast("double")
    out = [F.count("*").alias("dp"), F.count_if("deleted").alias("gaps"), n(is_ref).alias("n_ref"), n(is_alt).alias("n_alt"), *[F.count_if(F.col("base") == b).alias(f"d{b}") for b in BASES]]
    for name, c in (("clipped", F.col("softclip") > CLIPPED), ("gapped", F.col("n_indels") > 0), ("multi", F.col("mappers") != 1), ("reverse", F.col("is_reverse")), ("sure", F.col("mapq") == UNIQUE)):
        out += [n(is_ref & c).alias(f"ref_{name}"), n(is_alt & c).alias(f"alt_{name}")]
    avg = lambda where, c: F.avg(F.when(where, c))
    out += [avg(is_ref, F.col("qual")).alias("ref_baseq_mean"), avg(is_alt, F.col("qual")).alias("alt_baseq_mean"), avg(own, F.col("qual")).alias("baseq_mean"), avg(is_ref, F.col("mismatches")).alias("ref_mismatches_mean")]
    out += [avg(is_alt, F.greatest(F.col("mismatches") - 1, F.lit(0))).alias("alt_mismatches_mean"), F.size(F.collect_set(F.when(is_alt, F.col("query")))).cast("long").alias("alt_querypos_num")]
    return observed.groupBy(*SITE).agg(*out)


def _consistence(molecule: DataFrame) -> DataFrame:
    """Of each site's molecules: how far those with the alternative agree in it, their places, and the share of each base."""
    alt = F.element_at(F.array(*[F.col(f"n{b}") for b in BASES]), base_rank(F.col("alt")) + 1)
    share = alt / F.col("reads")
    out = [F.max(alt).alias("alt_read_number_perUMI_max")]
    for suffix, has in (("", alt > 0), ("_remove_single_read", (alt > 0) & (F.col("reads") >= 2))):
        part = lambda c, has=has: F.avg(F.when(has, c.cast("double")))
        out += [part(share).alias(f"alt_UMI_avg_consistence{suffix}"), part(share == 1).alias(f"alt_consistent_UMI_prop_strict{suffix}"), part(share >= 0.75).alias(f"alt_consistent_UMI_prop_relaxed{suffix}")]
    called = F.when(F.col("allele") == F.col("alt"), F.col("end_share"))
    out += [F.avg(called).alias("per_alt_UMI_end_remove_clip_mean"), F.percentile(called, F.lit(0.5)).alias("per_alt_UMI_end_remove_clip_median")]
    out += [F.avg(F.when(F.col(f"n{b}") > 0, F.col(f"n{b}") / F.col("reads"))).alias(f"share{b}") for b in BASES]
    return molecule.groupBy(*SITE).agg(*out)


def read_features(observed: DataFrame) -> DataFrame:
    """One row for each variant that any row of `observations` covers.

    For each of TESTS, `<test>_p` and `<test>_p_adj`, adjusted over the row's tests by Benjamini and Hochberg, and `<test>_rbc` for rank sums;
    means, shares and counts of the reference's (ref_), the alternative's (alt_) or both reads; consistence of molecules that
    have the alternative, with and without those of one read. Observations and molecules are written once. A value that has no reads to come from is null; zeros stay zero.
    """
    observed = written(observed)
    molecule = written(molecules(observed))
    greater = F.col("measure").isin(*[n for n, g in RANKED.items() if g])
    ranks = rank_sums(_measured(observed, molecule), [*SITE, "measure"], greater)
    pick = [F.max(F.when(F.col("measure") == n, F.col(c))).alias(f"{n}_{c}") for n in RANKED for c in ("p", "rbc")]
    wide = ranks.groupBy(*SITE).agg(*pick)
    joined = _shares(observed).join(_consistence(molecule), SITE, "left").join(wide, SITE, "left")

    table = lambda name: fisher_two_sided(F.col(f"alt_{name}"), F.col("n_alt") - F.col(f"alt_{name}"), F.col(f"ref_{name}"), F.col("n_ref") - F.col(f"ref_{name}"))
    both = (F.col("n_ref") > 0) & (F.col("n_alt") > 0)
    exact = {"softclip_prop": F.when(both, table("clipped")), "reads_with_indel": table("gapped"), "multi_mapper": table("multi"), "strand_bias": table("reverse")}
    tested = once(joined, **{f"{n}_p": p for n, p in exact.items()})
    every = F.array(*[F.col(f"{n}_p") for n in TESTS])
    adjusted = once(tested, _every=every).withColumns({f"{n}_p_adj": bh_adjusted(F.col(f"{n}_p"), F.col("_every")) for n in TESTS})

    ratio = lambda a, b: F.when(b > 0, a / b)
    others = F.array(*[F.when((F.col("ref") != b) & (F.col("alt") != b), F.struct((-F.col(f"d{b}")).alias("m"), F.lit(i).alias("i"), F.col(f"share{b}").alias("share"))) for i, b in enumerate(BASES)])
    total = F.col("n_ref") + F.col("n_alt")
    shares = {
        "ref_multi_map_prop": ratio(F.col("ref_multi"), F.col("n_ref")), "alt_multi_map_prop": ratio(F.col("alt_multi"), F.col("n_alt")), "multi_map_prop": ratio(F.col("ref_multi") + F.col("alt_multi"), total),
        "ref_mapq255_prop": F.coalesce(ratio(F.col("ref_sure"), F.col("n_ref")), F.lit(0.0)), "alt_mapq255_prop": F.coalesce(ratio(F.col("alt_sure"), F.col("n_alt")), F.lit(0.0)),
        "mapq255_prop": F.coalesce(ratio(F.col("ref_sure") + F.col("alt_sure"), total), F.lit(0.0)), "indel_proportion_for_site": F.col("gaps") / F.col("dp"), "alt2_proportion_per_UMI": F.array_min(others)["share"],
        "ref_softclip_prop": ratio(F.col("ref_clipped"), F.col("n_ref")), "alt_softclip_prop": F.when(both, F.col("alt_clipped") / F.col("n_alt")), "softclip_prop": F.when(both, (F.col("ref_clipped") + F.col("alt_clipped")) / total),
    }
    means = ["ref_baseq_mean", "alt_baseq_mean", "baseq_mean", "ref_mismatches_mean", "alt_mismatches_mean", "alt_querypos_num", "per_alt_UMI_end_remove_clip_mean", "per_alt_UMI_end_remove_clip_median", "alt_read_number_perUMI_max"]
    means += [f"alt_{c}{s}" for c in ("UMI_avg_consistence", "consistent_UMI_prop_strict", "consistent_UMI_prop_relaxed") for s in ("", "_remove_single_read")]
    tests = [F.col(f"{n}_{c}") for n in TESTS for c in ("p", "p_adj", *(["rbc"] if n in RANKED else []))]
    return adjusted.select(*SITE, F.col("dp").cast("long").alias("dp"), *tests, *[v.alias(n) for n, v in shares.items()], *means)
