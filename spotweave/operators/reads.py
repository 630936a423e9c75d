"""From aligned reads to base events: barcodes, read filters, and the walk along the CIGAR.

Reads have (read_id, chrom, ref_start, mapq, is_reverse, seq, quals, cigar, cb, ub); ref_start counts from 0, quals are in
the direction of the alignment, as seq is, and cigar is an array of (op, len). A base's quality is that at its place in seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.functions.genome import BASES

#: CIGAR operations (fixed values): M, I, D, N, S, H, P, =, X are 0 to 8.
MATCHES = (0, 7, 8)
USE_READ = (0, 1, 4, 7, 8)
USE_REFERENCE = (0, 2, 3, 7, 8)
#: Positions in a bin of the range join.
BIN = 256


def aligned_blocks(cigar: Column, ref_start: Column) -> Column:
    """(at, start, len) of each run of aligned bases: its place in the read and on the reference, both from 0; null without a CIGAR."""
    block = "struct<at:int,start:bigint,len:int>"
    begin = F.struct(F.lit(0).alias("at"), ref_start.cast("long").alias("start"), F.array().cast(f"array<{block}>").alias("blocks"))

    def step(s: Column, c: Column) -> Column:
        here = F.array(F.struct(s["at"].alias("at"), s["start"].alias("start"), c["len"].cast("int").alias("len")))
        return F.struct(
            (s["at"] + F.when(c["op"].isin(*USE_READ), c["len"].cast("int")).otherwise(0)).alias("at"),
            (s["start"] + F.when(c["op"].isin(*USE_REFERENCE), c["len"].cast("long")).otherwise(F.lit(0).cast("long"))).alias("start"),
            F.when(c["op"].isin(*MATCHES) & (c["len"] > 0), F.concat(s["blocks"], here)).otherwise(s["blocks"]).alias("blocks"),
        )

    return F.aggregate(cigar, begin, step, lambda s: s["blocks"])


def filter_reads_quality(reads: DataFrame, least_mapq: int = 255, most_mismatches: int = 5) -> DataFrame:
    return reads.where((F.col("mapq") >= least_mapq) & (F.col("nm") <= most_mismatches))


def filter_reads_by_barcode(reads: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Reads of the spots in `barcodes`; the join's strategy is Spark's, by the size of that table."""
    return reads.join(barcodes.select(F.col("barcode").alias("cb")), "cb", "left_semi")


def explode_reads(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """A base event for each read with both tags and each of the sites (chrom, pos, ref; pos from 1) that it covers with a base.

    Runs of aligned bases are dealt to bins of positions and meet the sites by equality of bins, so what is shuffled
    are runs and sites, and bases elsewhere are never rows. Inserted and clipped bases have no position; deleted and skipped
    positions have no base. Events keep A, T, C and G with a quality from 0 to 40; a base without a quality is left out.
    """
    tagged = reads.where("cb is not null and ub is not null").select("read_id", "chrom", "seq", "quals", "is_reverse", F.col("cb").alias("barcode"), F.col("ub").alias("umi"), F.explode(aligned_blocks(F.col("cigar"), F.col("ref_start"))).alias("b"))
    runs = tagged.withColumn("bin", F.explode(F.sequence(F.floor((F.col("b.start") + 1) / BIN), F.floor((F.col("b.start") + F.col("b.len")) / BIN))))
    wanted = sites.select("chrom", F.col("pos").cast("long").alias("pos"), "ref").dropDuplicates(["chrom", "pos"]).withColumn("bin", F.floor(F.col("pos") / BIN))
    met = runs.join(wanted, ["chrom", "bin"]).where((F.col("pos") > F.col("b.start")) & (F.col("pos") <= F.col("b.start") + F.col("b.len")))
    at = (F.col("b.at") + F.col("pos") - F.col("b.start") - 1).cast("int")
    out = met.select("read_id", "chrom", "pos", "ref", "barcode", "umi", F.substr("seq", at + 1, F.lit(1)).alias("base"), F.get("quals", at).alias("qual"), "is_reverse")
    return out.where(F.col("base").isin(*BASES) & F.col("qual").between(0, 40))


def reference_end(cigar: Column, ref_start: Column) -> Column:
    """Where a read ends on the reference, from 0 and exclusive."""
    return F.aggregate(cigar, ref_start.cast("long"), lambda t, c: t + F.when(c["op"].isin(*USE_REFERENCE), c["len"].cast("long")).otherwise(F.lit(0).cast("long")))


def reservoir_cap(span: Column, most: int) -> Column:
    """Reads that a region keeps: at most `most`, of long regions fewer."""
    return F.when(span > 50_000, min(most, 5_000)).when(span > 20_000, min(most, 10_000)).when(span > 10_000, min(most, 20_000)).otherwise(most).cast("long")


def sample_reservoir(reads: DataFrame, regions: DataFrame, most: int = 50_000, seed: int = 42, key: Column | None = None) -> DataFrame:
    """(chrom, start, end, read_id, total_seen, adjusted): a uniform sample of the reads that overlap each region.

    reads: (read_id, chrom, ref_start, cigar); regions: (chrom, start, end), half-open, from 0. A region keeps the reads with the
    least keys, `reservoir_cap` of them, the same ones whenever it runs; `adjusted` says whether it has more. key: a uniform long from
    0 below 2^60 for each read, by default of the hash of read_id and seed.

    No region's reads are sorted: counts of 4,096 ranges of keys, aggregated partially, say in which range the sample ends, and
    only reads of that one are ranked.
    """
    key = F.xxhash64("read_id", F.lit(seed)).bitwiseAND((1 << 60) - 1) if key is None else key
    site = ["chrom", "start", "end"]
    spans = reads.select("read_id", "chrom", F.col("ref_start").cast("long").alias("start2"), reference_end(F.col("cigar"), F.col("ref_start")).alias("end2"), key.alias("key"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor((F.col(b) - 1) / BIN)))
    dealt = spans.where("start2 < end2").withColumn("bin", bins("start2", "end2"))
    wanted = regions.select(*site).distinct().where("start < end").withColumn("bin", bins("start", "end"))
    met = dealt.join(wanted, ["chrom", "bin"]).where((F.col("start2") < F.col("end")) & (F.col("end2") > F.col("start")) & (F.col("bin") == F.floor(F.greatest("start", "start2") / BIN)))
    hit = met.select(*site, "read_id", "key", F.shiftright("key", 48).alias("range"))
    counts = hit.groupBy(*site, "range").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*site).orderBy("range")
    sums = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total_seen", F.sum("n").over(Window.partitionBy(*site))).withColumn("cap", reservoir_cap(F.col("end") - F.col("start"), most))
    kept = sums.where(F.col("upto") - F.col("n") < F.col("cap")).select(*site, "range", (F.col("cap") - F.col("upto") + F.col("n")).alias("room"), (F.col("n") > F.col("cap") - F.col("upto") + F.col("n")).alias("last"), "total_seen", (F.col("total_seen") > F.col("cap")).alias("adjusted"))
    rows = hit.join(kept, [*site, "range"])
    columns = [*site, "read_id", "total_seen", "adjusted"]
    ranked = rows.where("last").withColumn("rank", F.row_number().over(Window.partitionBy(*site, "range").orderBy("key", "read_id"))).where("rank <= room")
    return rows.where("not last").select(columns).unionByName(ranked.select(columns))
