"""Readers and writers of the text formats of sites, intervals, genomes and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.functions.genome import BASES, chromosome_order

BED = "chrom string, start long, end long, gene string"
BEDGRAPH = "chrom string, start long, end long, score double"
TILE = 10_000


def scan_tsv(spark: SparkSession, path: str, schema: str, comment: str = "#") -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", comment).option("nullValue", "NA").csv(path)


def scan_bed(spark: SparkSession, path: str) -> DataFrame:
    return scan_tsv(spark, path, BED)


def scan_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Score intervals; track and browser lines have no numbers and go."""
    return scan_tsv(spark, path, BEDGRAPH).where("start is not null and score is not null")


def scan_barcode_positions(spark: SparkSession, path: str, all_spots: bool = False) -> DataFrame:
    out = spark.read.schema("barcode string, in_tissue int, row int, col int, px double, py double").csv(path)
    return out if all_spots else out.where("in_tissue = 1")


def scan_cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, cluster), with or without a header; 3.0 is cluster 3."""
    out = spark.read.schema("barcode string, cluster string").csv(path).where("lower(barcode) <> 'barcode'")
    return out.select("barcode", F.regexp_replace("cluster", r"\.0+$", "").alias("cluster"))


def scan_gnomad(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, af) of white-space text, the chromosome being in the file's name."""
    x = F.split(F.trim("value"), r"\s+")
    chrom = F.regexp_extract(F.input_file_name(), r"(chr[0-9XYM]+)", 1)
    return spark.read.text(path).select(chrom.alias("chrom"), x[2].cast("long").alias("pos"), x[3].alias("ref"), x[4].alias("alt"), x[5].try_cast("double").alias("af")).where("pos is not null")


def scan_vcf(spark: SparkSession, path: str) -> DataFrame:
    return scan_tsv(spark, path, "chrom string, pos long, id string, ref string, alts string")


def scan_pileup(spark: SparkSession, path: str) -> DataFrame:
    return parse_pileup_bases(scan_tsv(spark, path, "chrom string, pos long, ref string, depth long, bases string, quals string"))


def parse_pileup_bases(rows: DataFrame) -> DataFrame:
    """nA, nT, nC, nG, insertions and deletions of a pileup's base string.

    `^x` and `$` mark read ends; +n and -n announce n letters, which are no bases; `.` and `,` are the reference.
    """
    plain = F.regexp_replace(F.regexp_replace("bases", r"\^.", ""), r"\$", "")
    # Splitting at the announcements leaves, but for the first part, number and letters at each part's start.
    parts = F.split(F.regexp_replace(plain, r"([+-])(\d+)", "\u0001$1$2:"), "\u0001")
    left = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.substr(p, F.instr(p, ":") + 1 + F.regexp_extract(p, r"^[+-](\d+)", 1).try_cast("int"))))
    kept = F.upper(F.regexp_replace(F.array_join(left, ""), r"[.,]", "="))
    counts = [(F.regexp_count(kept, F.lit(b)) + F.when(F.upper("ref") == b, F.regexp_count(kept, F.lit("="))).otherwise(0)).cast("long").alias(f"n{b}") for b in BASES]
    return rows.select("chrom", "pos", F.upper("ref").alias("ref"), *counts, F.regexp_count(plain, F.lit(r"\+\d+")).cast("long").alias("insertions"), F.regexp_count(plain, F.lit(r"-\d+")).cast("long").alias("deletions"))


def scan_fasta(spark: SparkSession, path: str, tile: int = TILE, overlap: int = 20) -> DataFrame:
    """(chrom, tile, seq): each tile with `overlap` more characters; files are read as wholes, one contig or more each."""
    files = spark.read.text(path, wholetext=True)
    contig = files.select(F.explode(F.split("value", "(?m)^>")).alias("c")).where("trim(c) <> ''")
    seq = F.regexp_replace(F.regexp_replace("c", r"^[^\n]*\n", ""), r"\s", "")
    named = contig.select(F.regexp_extract("c", r"^(\S+)", 1).alias("chrom"), seq.alias("s"))
    return named.select("chrom", "s", F.explode(F.sequence(F.lit(0), F.floor((F.length("s") - 1) / tile).cast("int"))).alias("tile")).select("chrom", "tile", F.substr("s", F.col("tile") * tile + 1, F.lit(tile + overlap)).alias("seq"))


def sink_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def _info(name: str, value: Column, kind: str) -> Column:
    text = F.format_string("%.6g", value.cast("double")) if kind == "Float" else F.regexp_replace(F.regexp_replace(value.cast("string"), " ", "_"), ";", ",")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), text))


def vcf_lines(variants: DataFrame, info: dict[str, tuple[str, str]]) -> DataFrame:
    """(line, and sort keys) of passed variants; info gives for each key its column and kind (Integer, Float, String)."""
    fields = F.concat_ws(";", *[_info(k, F.col(c), kind) for k, (c, kind) in info.items()])
    line = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), fields)
    number, name = chromosome_order(F.col("chrom"))
    return variants.where("filter = 'PASS'").select(number.alias("o1"), name.alias("o2"), "pos", line.alias("line")).orderBy("o1", "o2", "pos", "line")


def sink_vcf(variants: DataFrame, path: str, info: dict[str, tuple[str, str]], source: str = "spotweave") -> None:
    """Text parts in chromosome order, the header in a part of its own before them."""
    spark = variants.sparkSession
    head = ["##fileformat=VCFv4.2", f"##source={source}", *[f'##INFO=<ID={k},Number=1,Type={kind},Description="{c}">' for k, (c, kind) in info.items()], "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/00-header")
    vcf_lines(variants, info).select(F.col("line").alias("value")).write.text(f"{path}/01-records")


def sink_mutation_list(variants: DataFrame, path: str) -> None:
    variants.select(F.concat_ws("_", "chrom", "pos", "ref", "alt").alias("value")).distinct().write.text(path)
