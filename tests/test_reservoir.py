"""Bounded samples of regions' reads."""

from pyspark.sql import functions as F

from spotweave.operators import reads as R

SCHEMA = "read_id long, chrom string, ref_start long, cigar array<struct<op:int,len:int>>"


def test_least_keys_are_kept(spark):
    rows = [(i, "c", i % 50, [(4, 3), (0, 10), (2, 2), (0, 8)]) for i in range(400)] + [(1000, "d", 5, [(0, 10)]), (1001, "e", 5, [(4, 10)])]
    regions = spark.createDataFrame([("c", 0, 10), ("c", 0, 10), ("c", 30, 31), ("c", 68, 70), ("c", 100, 400), ("d", 0, 20_500), ("e", 0, 9), ("c", 9, 9)], "chrom string, start long, end long")
    key = lambda i: (i * 2654435761 * 97) % (1 << 60)
    keys = spark.createDataFrame([(r[0], key(r[0])) for r in rows], "read_id long, k long")
    reads = spark.createDataFrame(rows, SCHEMA).join(keys, "read_id")
    got = R.sample_reservoir(reads, regions, 25, key=F.col("k")).collect()
    for chrom, start, end in {("c", 0, 10), ("c", 30, 31), ("c", 68, 70), ("d", 0, 20_500)}:
        there = [r[0] for r in rows if r[1] == chrom and r[0] != 1001 and r[2] < end and r[2] + (10 if chrom == "d" else 20) > start]
        mine = [r for r in got if (r.chrom, r.start, r.end) == (chrom, start, end)]
        assert sorted(r.read_id for r in mine) == sorted(sorted(there, key=lambda i: (key(i), i))[:25])
        assert {(r.total_seen, r.adjusted) for r in mine} == {(len(there), len(there) > 25)}
    assert {(r.chrom, r.start) for r in got} == {("c", 0), ("c", 30), ("c", 68), ("d", 0)}


def test_caps_by_span(spark):
    got = spark.createDataFrame([(s,) for s in (10_000, 10_001, 20_001, 50_001)], "s long").select(R.reservoir_cap(F.col("s"), 50_000).alias("a"), R.reservoir_cap(F.col("s"), 7_000).alias("b")).collect()
    assert [r.a for r in got] == [50_000, 20_000, 10_000, 5_000] and [r.b for r in got] == [7_000, 7_000, 7_000, 5_000]


def test_samples_are_uniform_and_repeat(spark):
    reads = spark.range(4000).select(F.col("id").alias("read_id"), F.lit("c").alias("chrom"), F.lit(5).cast("long").alias("ref_start"), F.array(F.struct(F.lit(0).alias("op"), F.lit(10).alias("len"))).alias("cigar"))
    region = spark.createDataFrame([("c", 0, 20)], "chrom string, start long, end long")
    one = {r.read_id for r in R.sample_reservoir(reads, region, 400).collect()}
    assert len(one) == 400 and one == {r.read_id for r in R.sample_reservoir(reads.repartition(7), region, 400).collect()}
    assert one != {r.read_id for r in R.sample_reservoir(reads, region, 400, seed=1).collect()} and 150 < sum(i < 2000 for i in one) < 250
