"""Scans over range partitions against windows over whole groups."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.operators import intervals, scans


@pytest.mark.parametrize("upto", [0, -1])
def test_running_values_equal_windows_with_one_hot_group(spark, upto):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", "c", None]), i, rng.choice([None, 1, 2, 3, -5])) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at long, v long").repartition(7)
    laid = scans.range_sorted(df, ["g"], ["at"], 6)
    values = {"total": ("sum", F.col("v")), "n": ("count", F.col("v")), "most": ("max", F.col("v")), "late": ("last", F.col("v"))}
    got = scans.running(laid, ["g"], values, upto)
    assert laid.select("_part").distinct().count() > 1
    w = Window.partitionBy("g").orderBy("at").rowsBetween(Window.unboundedPreceding, upto)
    want = df.select("g", "at", F.sum("v").over(w).alias("total"), F.count("v").over(w).alias("n"), F.max("v").over(w).alias("most"), F.last("v", True).over(w).alias("late"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_empty(spark):
    laid = scans.range_sorted(spark.createDataFrame([], "g string, at long"), ["g"], ["at"])
    assert scans.running(laid, ["g"], {"n": ("count", F.col("at"))}).count() == 0


def one_chromosome(spark, n=600):
    rng = random.Random(9)
    spans = [("chr1", s, s + rng.randint(1, 30), float(rng.randint(1, 9))) for s in rng.sample(range(5000), n)] + [("chr2", 10, 20, 1.0)]
    points = [("chr1", p, f"p{p}") for p in rng.sample(range(-50, 5100), n)] + [("chr2", 15, "x"), ("chr2", 20, "y"), ("chr3", 15, "z")]
    rng.shuffle(spans)
    return spark.createDataFrame(spans, "chrom string, start long, end long, score double").repartition(5), spark.createDataFrame(points, "chrom string, pos long, name string").repartition(3)


@pytest.fixture
def split(monkeypatch):
    """Scans with seven ranges, though the tables are small."""
    plainly = scans.range_sorted
    made = []

    def seven(rows, group, order, partitions=None):
        made.append(plainly(rows, group, order, 7))
        return made[-1]

    monkeypatch.setattr(intervals, "range_sorted", seven)
    return made


def test_asof_join_splits_a_chromosome(spark, split):
    spans, points = one_chromosome(spark)
    rows = [tuple(r) for r in spans.collect()]
    want = {}
    for p in points.collect():
        mine = [r for r in rows if r[0] == p.chrom]
        before = [r for r in mine if r[1] <= p.pos]
        last = max(before, key=lambda r: r[1]) if before else None
        want[p.name] = (last[3] if last and p.pos < last[2] else 0.0) if mine else None
    got = {r.name: r.score for r in intervals.asof_join(points, spans).collect()}
    assert got == want and split[0].where("chrom = 'chr1'").select("_part").distinct().count() > 3


def test_sessions_and_merging_split_a_chromosome(spark, split):
    spans, points = one_chromosome(spark)
    at, want, before = sorted(p.pos for p in points.collect() if p.chrom == "chr1"), {}, None
    for p in at:
        want[p] = want.get(before, 0) + (before is None or p - before > 12)
        before = p
    assert {r.pos: r.session for r in intervals.gap_sessions(points, ["chrom"], "pos", 12).collect() if r.chrom == "chr1"} == want
    merged = []
    for _, s, e, _ in sorted(tuple(r) for r in spans.where("chrom = 'chr1'").collect()):
        if merged and s - merged[-1][1] <= 6:
            merged[-1] = [merged[-1][0], max(merged[-1][1], e), merged[-1][2] + 1]
        else:
            merged.append([s, e, 1])
    got = sorted([r.start, r.end, r.merged] for r in intervals.merge_intervals(spans, ["chrom"], 6).collect() if r.chrom == "chr1")
    assert got == merged and split[-1].where("chrom = 'chr1'").select("_part").distinct().count() > 3
