"""Mixing sources to target weights.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+` (null text: 0). The sources, by code point with
null last, weigh 5, 2, 1, repeating, and share the total size of all by weight; a source's target stops at 3
times its size, and what it gives up goes to the others by weight until no target is above. A source's rate is
its target over its size. Each document is taken floor(rate) times, and once more with a probability of the
rate's fraction: a uniform number made from a seed and the document's id decides.

Each source uses that one of SEEDS seeds with which the words drawn come nearest to its target; every seed gives
each document the same probability, and a rerun chooses the same. Sources are aggregated before they are
compared; only a row for each source and seed is ever gathered. A source of empty documents has target 0 and
takes each of them 0 times. Documents with equal ids draw alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.llm.tables import written
from spotweave.llm.text import free_name

WEIGHTS = (5, 2, 1)
MOST = 3
#: Uniform numbers tried for each document: four from each MD5.
SEEDS = 64
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources are few rows by now: one for each. With sources in ascending order of most * size / weight, those
    before some place are at their limit and the others share the rest by weight; that place is the first
    where no source is above its limit.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    ratio = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").isNull(), "source")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = weighed.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))).alias("rest"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest_weight"),
        F.row_number().over(ratio).alias("place"),
    )
    free = F.col("source_size") * most * F.col("rest_weight") >= F.col("rest") * F.col("weight")
    first = F.min_by(F.struct("rest", "rest_weight", "place"), F.when(free, F.col("place"))).over(everything)
    level = after.withColumn("first", first)
    share = F.col("first.rest").cast("double") * F.col("weight") / F.col("first.rest_weight")
    target = F.when(F.col("place") < F.col("first.place"), (F.col("source_size") * most).cast("double")).otherwise(share)
    return level.select("source", "source_size", target.alias("target"))


def _draws(doc_id: Column) -> list[Column]:
    """SEEDS uniform numbers from 0 to 1."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    out = []
    for i in range(SEEDS // 4):
        digest = F.md5(F.concat(F.lit(f"{i}:"), name).cast("binary"))
        out += [F.conv(F.substring(digest, 1 + 8 * j, 8), 16, 10).cast("long") / float(1 << 32) for j in range(4)]
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every document."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(_WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")))
    target = written(targets(sizes))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = sizes.join(target, sizes["source"].eqNullSafe(target["source"])).select("doc_id", sizes["source"], "size", "source_size", "target", rate.alias("rate"))
    fraction = F.col("rate") - F.floor("rate")
    drawn = rated.groupBy("source").agg(*[F.sum(F.when(u < fraction, F.col("size")).otherwise(0)).alias(f"w{i}") for i, u in enumerate(_draws(F.col("doc_id")))], F.any_value("target").alias("target"), F.any_value("source_size").alias("source_size"), F.any_value("rate").alias("rate"))
    short = F.col("target") - F.floor("rate") * F.col("source_size")
    miss = F.array(*[F.struct(F.abs(F.col(f"w{i}") - short).alias("miss"), F.lit(i).alias("seed")) for i in range(SEEDS)])
    seeds = drawn.select("source", F.array_min(miss)["seed"].alias("seed"))
    chosen = rated.join(seeds, rated["source"].eqNullSafe(seeds["source"])).select(rated["*"], "seed")
    u = F.element_at(F.array(*_draws(F.col("doc_id"))), F.col("seed") + 1)
    copies = (F.floor("rate") + (u < fraction).cast("long")).cast("long")
    return chosen.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame) -> DataFrame:
    """Each row of documents as often as the mix takes it; columns stay as they are. Rows that repeat an id are one draw each."""
    i, of, n, copy = (free_name(docs.columns, c) for c in ("id", "of", "copies", "copy"))
    copies = mix(docs).groupBy(F.col("doc_id").alias(i), F.col("source").alias(of)).agg(F.max("copies").alias(n)).where(F.col(n) > 0)
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(copies[i]) & docs["source"].eqNullSafe(copies[of]))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(docs.columns)
