"""Range joins by bins, as-of joins, interval merging and gap sessions.

Spark plans pure inequality joins as nested loops; here an interval is dealt to the bins that it touches and a
point to its one, so the join is by (chrom, bin) with a re-check. What needs a chromosome in order is scanned by ranges of
positions (see `scans`). Intervals are half-open: start <= x < end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.operators.scans import range_sorted, running

BIN = 1024


def _bin(x: Column, size: int) -> Column:
    return F.floor(x / size).cast("long")


def range_join(points: DataFrame, intervals: DataFrame, point: str = "pos", size: int = BIN, how: str = "inner") -> DataFrame:
    """Points joined with the intervals (chrom, start, end, ...) that hold them; how: inner, left, left_semi or left_anti."""
    dealt = intervals.where("start < end").withColumn("_bin", F.explode(F.sequence(_bin(F.col("start"), size), _bin(F.col("end") - 1, size)))).withColumnRenamed("chrom", "_chrom")
    keyed = points.withColumn("_pbin", _bin(F.col(point), size))
    hit = (keyed["chrom"] == dealt["_chrom"]) & (keyed["_pbin"] == dealt["_bin"]) & (keyed[point] >= dealt["start"]) & (keyed[point] < dealt["end"])
    return keyed.join(dealt, hit, how).drop("_pbin", "_bin", "_chrom")


def interval_join(left: DataFrame, right: DataFrame, size: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals; the other's bounds are start2 and end2. A pair is given by the first bin it shares."""
    deal = lambda d: d.withColumn("_bin", F.explode(F.sequence(_bin(F.col("start"), size), _bin(F.col("end") - 1, size))))
    other = deal(right).withColumnRenamed("start", "start2").withColumnRenamed("end", "end2")
    joined = deal(left).join(other, ["chrom", "_bin"]).where("start < end2 and start2 < end")
    return joined.where(F.col("_bin") == _bin(F.greatest("start", "start2"), size)).drop("_bin")


def interval_left_gene(sites: DataFrame, genes: DataFrame, flank: int = 150) -> DataFrame:
    """Each site's genes (names by comma) and their span; the site's surroundings if it has none."""
    found = range_join(sites, genes, how="left").groupBy("chrom", "pos").agg(F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes"), F.min("start").alias("start"), F.max("end").alias("end"))
    return found.select("chrom", "pos", F.when(F.col("start").isNotNull(), F.col("genes")).alias("genes"), F.coalesce("start", F.col("pos") - flank).alias("start"), F.coalesce("end", F.col("pos") + flank).alias("end"))


def interval_flag(sites: DataFrame, intervals: DataFrame, name: str) -> DataFrame:
    """Sites with a boolean column: whether any interval holds them."""
    inside = range_join(sites.select("chrom", "pos").distinct(), intervals, how="left_semi").withColumn(name, F.lit(True))
    return sites.join(inside, ["chrom", "pos"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def asof_join(points: DataFrame, intervals: DataFrame, point: str = "pos", value: str = "score", missing: float = 0.0) -> DataFrame:
    """The value of the last interval that starts at or before a point, if it holds it, else `missing`; null on unknown chromosomes.

    One sort for both sides, by ranges of (chrom, position); no pairs are made, and no task holds a chromosome.
    """
    left = points.select("chrom", F.col(point).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("long").alias("_end"), F.lit(None).cast("double").alias("_value"))
    right = intervals.select("chrom", F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col("end").cast("long").alias("_end"), F.col(value).cast("double").alias("_value"))
    laid = range_sorted(left.union(right), ["chrom"], ["_at", "_kind", "_end", "_value"])
    both = running(laid, ["chrom"], {"_last": ("last", F.when(F.col("_kind") == 0, F.struct("_end", "_value")))})
    known = intervals.select(F.col("chrom").alias("_known")).distinct()
    hit = F.when(F.col("_at") < F.col("_last._end"), F.col("_last._value")).otherwise(F.lit(missing))
    met = both.where("_kind = 1").join(known, F.col("chrom") == F.col("_known"), "left")
    return met.select("_row.*", F.when(F.col("_known").isNotNull(), hit).alias(value))


def gap_sessions(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Rows with `session`: a number that grows by one where the distance to the row before is more than `gap`."""
    laid = running(range_sorted(rows, keys, [at]), keys, {"_before": ("last", F.col(at))}, upto=-1)
    new = F.when(F.col("_before").isNull() | (F.col(at) - F.col("_before") > gap), 1).otherwise(0)
    return running(laid, keys, {"session": ("sum", new)}).select(*rows.columns, "session")


def win_gap_sessionize(sites: DataFrame, gap: int = 10) -> DataFrame:
    """Runs of sites at most `gap` apart: (chrom, session, start, end, sites)."""
    return gap_sessions(sites, ["chrom"], "pos", gap).groupBy("chrom", "session").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("sites"))


def merge_intervals(intervals: DataFrame, keys: list[str], gap: int = 200) -> DataFrame:
    """Intervals with at most `gap` between them become one: keys, start, end, merged."""
    laid = running(range_sorted(intervals, keys, ["start", "end"]), keys, {"_reach": ("max", F.col("end"))}, upto=-1)
    new = F.coalesce((F.col("start") - F.col("_reach") > gap).cast("int"), F.lit(1))
    block = running(laid, keys, {"_block": ("sum", new)})
    return block.groupBy(*keys, "_block").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("merged")).drop("_block")


def near_pairs(sites: DataFrame, distance: int = 10) -> DataFrame:
    """Pairs of positions of a chromosome that are 1 to `distance` apart: each is dealt to its bin, and the left one to the next."""
    bins = sites.withColumn("_bin", _bin(F.col("pos"), distance))
    left = bins.withColumn("_bin", F.explode(F.array("_bin", F.col("_bin") + 1))).withColumnRenamed("pos", "pos_i")
    right = bins.select("chrom", F.col("pos").alias("pos_j"), "_bin")
    gap = F.col("pos_j") - F.col("pos_i")
    return left.select("chrom", "pos_i", "_bin").join(right, ["chrom", "_bin"]).where((gap > 0) & (gap <= distance)).select("chrom", "pos_i", "pos_j")


def clustered_noise(sites: DataFrame, window: int = 100, least: int = 3, share: float = 0.8) -> DataFrame:
    """Sites (chrom, pos, kind) with `noise`: from a site on, sites within `window`, if at least `least` positions and
    `share` of one kind, are noise of that kind; the scan then goes on behind the window, else at the next site.

    The jumps depend on what came before, so a (chrom, kind) is scanned in order; it holds one row a position.
    """
    import pandas as pd

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "kind"]).reset_index(drop=True)
        pos, own = pdf["pos"].to_numpy(), (pdf["kind"] == pdf["target"]).to_numpy()
        flag = [False] * len(pdf)
        i = 0
        while i < len(pdf):
            if not own[i]:
                i += 1
                continue
            end = int(pos.searchsorted(pos[i] + window, "right"))
            mine = [k for k in range(i, end) if own[k]]
            if len(set(pos[mine])) >= least and len(mine) >= share * (end - i):
                for k in mine:
                    flag[k] = True
                i = end
            else:
                i += 1
        pdf["noise"] = flag
        return pdf[own][["chrom", "pos", "kind", "noise"]]

    kinds = sites.select("chrom", F.col("kind").alias("target")).distinct()
    return sites.join(kinds, "chrom").groupBy("chrom", "target").applyInPandas(scan, "chrom string, pos long, kind string, noise boolean")
