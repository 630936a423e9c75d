"""Quality histograms of molecules, spots, clusters and individuals.

A histogram is a set of cells (allele, phred, n), of which a row has at most 164. Levels are sums of cells with partial
aggregation before each shuffle, so a deep site or a large cluster is never gathered before its cells are counted. A cell of
MARK counts the spots of a row, so that one aggregation sums both. Qualities of every phred stay in the cells; the
texts qA, qT, qC, qG ("phred:n,phred:n", NA if empty) and the likelihoods take those of least_quality and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.genome import BASES
from spotweave.operators.events import MOLECULE, SITE, allele_filter_binom, check_errors, join_cluster_inner, usable_events

MARK = "*"
COUNTS = [f"n{b}" for b in BASES]


def alternatives(by: str) -> Column:
    """Bases other than the reference with a count, by "rank" (A, T, C, G), "name" or "count" (most first, then rank); '.' if none."""
    key = {"rank": lambda b, i: F.lit(i), "name": lambda b, i: F.lit(b), "count": lambda b, i: -F.col(f"n{b}")}[by]
    found = F.array(*[F.when((F.col("ref") != b) & (F.col(f"n{b}") > 0), F.struct(key(b, i).alias("k"), F.lit(i).alias("i"), F.lit(b).alias("b"))) for i, b in enumerate(BASES)])
    text = F.array_join(F.transform(F.array_sort(F.array_compact(found)), lambda x: x["b"]), ",")
    return F.when(text == "", ".").otherwise(text)


def histogram_text(base: str, least_quality: int) -> Column:
    """The cells of a base as text, by quality."""
    own = F.filter("cells", lambda c: (c["allele"] == base) & (c["phred"] >= least_quality))
    text = F.array_join(F.transform(own, lambda c: F.concat_ws(":", c["phred"].cast("string"), c["n"].cast("string"))), ",")
    return F.when(text == "", "NA").otherwise(text)


def _folded(cells: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One row of each group of distinct cells: counts of bases, spots, and the cells in order."""
    at = lambda a: F.sum(F.when(F.col("allele") == a, F.col("n")).otherwise(0))
    held = F.collect_list(F.when(F.col("allele") != MARK, F.struct("allele", "phred", "n")))
    return cells.groupBy(*keys).agg(*[at(b).alias(f"n{b}") for b in BASES], at(MARK).alias("spot_number"), F.array_sort(held).alias("cells"), *more)


def with_texts(rows: DataFrame, by: str, least_quality: int = 0) -> DataFrame:
    return rows.withColumns({"alt": alternatives(by)} | {f"q{b}": histogram_text(b, least_quality) for b in BASES})


def umi_histograms(events: DataFrame) -> DataFrame:
    """Each molecule's counts, cells of read qualities and strand ('-' on a tie)."""
    cells = usable_events(events).groupBy(*MOLECULE, F.col("base").alias("allele"), F.col("qual").cast("int").alias("phred")).agg(F.count("*").alias("n"), F.count_if("is_reverse").alias("reverse"))
    strand = F.when(F.sum(F.col("n") - F.col("reverse")) > F.sum("reverse"), "+").otherwise("-")
    return _folded(cells, MOLECULE, strand.alias("strand")).drop("spot_number")


def spot_cells(calls: DataFrame) -> DataFrame:
    """(site, barcode, allele, phred, n) of called molecules, with the plus strand's share and lysis errors of each cell."""
    keys = ["chrom", "pos", "ref", "barcode", "allele", "phred"]
    return check_errors(calls).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("strand") == "+").alias("plus"), F.count("lysis_alt").alias("lysis"), F.max("lysis_alt").alias("lysis_alt"))


def spot_histograms(cells: DataFrame) -> DataFrame:
    """Rows of spots: the site's majority strand ('-' on a tie), counts, cells, and error_allele where exactly one molecule shows a lysis error.

    `cells` is read twice: write it, if it is costly.
    """
    strands = cells.groupBy(*SITE).agg(F.when(F.sum("plus") > F.sum(F.col("n") - F.col("plus")), "+").otherwise("-").alias("strand"))
    error = F.when(F.sum("lysis") == 1, F.max("lysis_alt"))
    return _folded(cells, ["chrom", "pos", "ref", "barcode"], error.alias("error_allele")).drop("spot_number").join(strands, SITE)


def _summed(rows: DataFrame, keys: list[str], spots: Column) -> DataFrame:
    mark = F.struct(F.lit(MARK).alias("allele"), F.lit(None).cast("int").alias("phred"), spots.cast("long").alias("n"))
    each = rows.select(*keys, F.explode(F.array_append("cells", mark)).alias("c")).select(*keys, "c.*")
    return _folded(each.groupBy(*keys, "allele", "phred").agg(F.sum("n").alias("n")), keys)


def cluster_histograms(spots: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """Spots summed by (site, strand, cluster); without clusters, all are "bulk"."""
    known = spots.withColumn("cluster", F.lit("bulk")) if clusters is None else join_cluster_inner(spots, clusters)
    return _summed(known, ["chrom", "pos", "strand", "ref", "cluster"], F.lit(1))


def filter_alleles(rows: DataFrame, error: float = 0.003, alpha: float = 0.05) -> DataFrame:
    """Bases that errors explain in every cluster of a site lose their counts and cells."""
    kept = allele_filter_binom(rows, error, alpha)
    count = lambda a: sum((F.when(a == b, F.col(f"n{b}")).otherwise(0) for b in BASES), F.lit(0))
    return kept.withColumn("cells", F.filter("cells", lambda c: count(c["allele"]) > 0))


def individual_histograms(clusters: DataFrame) -> DataFrame:
    """Clusters summed to the individual by (site, strand)."""
    return _summed(clusters, ["chrom", "pos", "strand", "ref"], F.col("spot_number")).withColumn("cluster", F.lit("bulk"))
