"""Projections of the driver's tables onto the data model: virtual reads out of order lines, intervals out of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A base event for each order line."""
    site = F.col("l_partkey") % 60
    alt = (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_suppkey") * 7) % 97 < F.when(F.col("site") % 12 == 11, 48).otherwise(F.col("site") % 12)
    letter = lambda i: F.substr(F.lit("ATCG"), (i + 1).cast("int"), F.lit(1))
    turn = F.floor((F.col("l_orderkey") % 97) / 90)
    x = table(spark, folder, "lineitem").withColumn("site", site)
    return x.select(
        "site", F.concat(F.lit("chr"), (1 + F.col("site") % 3).cast("string")).alias("chrom"), (1000 + 4 * F.col("site")).alias("pos"), F.concat(F.lit("BC"), (F.col("l_orderkey") % 50).cast("string")).alias("barcode"),
        (F.col("l_suppkey") % 10).cast("string").alias("umi"), letter(F.col("site") % 4).alias("ref"), F.when(alt, letter((F.col("site") + 1 + turn) % 4)).otherwise(letter(F.col("site") % 4)).alias("base"),
        (20 + F.col("l_quantity").cast("int") % 21).alias("qual"), (F.col("l_linestatus") == "O").alias("is_reverse"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"),
    )


def clusters(spark: SparkSession) -> DataFrame:
    """50 barcodes in 4 clusters, on a 10 x 5 grid."""
    return spark.range(50).select(F.concat(F.lit("BC"), F.col("id").cast("string")).alias("barcode"), (F.col("id") % 4).cast("string").alias("cluster"), (F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"))


def dense_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct sites with gaps of 6 and 21 within a chromosome."""
    site = events(spark, folder).select("site", "chrom").distinct()
    return site.select("chrom", (1000 + 2 * F.col("site") + 15 * F.floor(F.col("site") / 10)).alias("pos"))


def genes(spark: SparkSession, folder: str) -> DataFrame:
    """An interval for each part, 120 of them over the sites and as many over each further stretch: chrom, start, end, gene."""
    p = table(spark, folder, "part")
    start = 990 + 260 * F.floor(F.col("p_partkey") / 120) + (F.col("p_partkey") * 37) % 260
    return p.select(F.concat(F.lit("chr"), (1 + F.col("p_partkey") % 4).cast("string")).alias("chrom"), start.alias("start"), (start + 3 + F.col("p_size") % 17).alias("end"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"))


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """A read of 40 bases for each order, with one of four CIGARs."""
    cigars = ("0:40", "4:3 0:20 1:2 0:15", "0:10 2:4 0:20 3:50 0:10", "5:7 4:5 7:15 8:1 0:17 4:2")
    kinds = F.array(*[F.array(*[F.struct(*[F.lit(int(x)).alias(n) for n, x in zip(("op", "len"), c.split(":"), strict=True)]) for c in w.split()]) for w in cigars])
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("read_id"), F.concat(F.lit("chr"), (1 + key % 3).cast("string")).alias("chrom"), (key % 300).alias("ref_start"), (key % 4 * 85).cast("int").alias("mapq"), (key % 2 == 1).alias("is_reverse"),
        F.substr(F.lit("ACGTTGCAN" * 6), (1 + F.col("o_custkey") % 9).cast("int"), F.lit(40)).alias("seq"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: ((i * 7 + key) % 45).cast("int")).alias("quals"),
        F.get(kinds, (key % 4).cast("int")).alias("cigar"), F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("BC"), (F.col("o_custkey") % 50).cast("string"))).alias("cb"), (key % 10).cast("string").alias("ub"), (key % 7).cast("int").alias("nm"), F.when(F.col("o_custkey") % 13 == 0, 3).otherwise(1).alias("nh"),
    )


def read_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The sites of read_sites with an alternative each: chrom, pos, ref, alt."""
    return read_sites(spark, folder).distinct().withColumn("alt", F.substr(F.lit("TCG"), (1 + F.col("pos") % 3).cast("int"), F.lit(1)))


def read_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Sites out of the parts, the same for several of them: chrom, pos, ref."""
    p = table(spark, folder, "part")
    return p.select(F.concat(F.lit("chr"), (1 + F.col("p_partkey") % 4).cast("string")).alias("chrom"), (1 + F.col("p_partkey") % 400).alias("pos"), F.lit("A").alias("ref"))
