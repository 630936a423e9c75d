"""Sharding by a permutation-filled lookup table (Maglev hashing).

Every shard orders the slots of a table of prime size by its own permutation, (offset + j * skip) mod size, both
numbers hashed from its name. The shards take turns; at its turn a shard claims the first slot of its order that
is free, as often as its weight says. All slots are filled, in equal shares up to one turn, and taking a shard
away moves few keys that were not its own.

The table has `size` rows whatever the data, so it is broadcast, and a key's place is one hash and one lookup: no
shuffle and no count of keys, and a key that a third of the rows share costs no more than others. A null key is
the empty string, so all null keys have one shard; equal keys have equal shards. Empty inputs give empty results.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm.text import free_name

#: A prime, far above 100 times the number of shards.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, weights: tuple[int, ...] | None = None) -> list[int]:
    """The shard's number for each slot. Names must differ; weights are claims a turn, 1 by default."""
    if not shards or len(set(shards)) < len(shards) or not _is_prime(size) or size < len(shards):
        raise ValueError("shards need distinct names, and a prime table that is no smaller than their number")
    weights = weights or (1,) * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("one weight of at least 0 for each shard, not all 0")
    slot = [xxhash.xxh64_intdigest(s, seed=1) % size for s in shards]
    skip = [xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1 for s in shards]
    table, filled = [-1] * size, 0
    while True:
        for i, claims in enumerate(weights):
            for _ in range(claims):
                while table[slot[i]] >= 0:
                    slot[i] = (slot[i] + skip[i]) % size
                table[slot[i]] = i
                filled += 1
                if filled == size:
                    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key, by its text."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size))


def table_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, weights: tuple[int, ...] | None = None) -> DataFrame:
    """(slot, shard, shard_name): the lookup table."""
    rows = [(slot, i, shards[i]) for slot, i in enumerate(lookup_table(shards, size, weights))]
    return spark.createDataFrame(rows, "slot long, shard int, shard_name string")


def assign(df: DataFrame, key_col: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, weights: tuple[int, ...] | None = None) -> DataFrame:
    """df with the columns slot, shard and shard_name at its end; columns of these names, in any case, are replaced."""
    table = table_frame(df.sparkSession, shards, size, weights)
    names = [c for c in df.columns if c.lower() not in ("slot", "shard", "shard_name")]
    at = free_name(df.columns, "at")
    # TABLE_SIZE rows: broadcast is safe at every input size.
    keyed = df.withColumn(at, slot_of(F.col(key_col), size)).select(*names, at)
    placed = keyed.join(F.broadcast(table.withColumnRenamed("slot", at)), at)
    return placed.select(*names, F.col(at).alias("slot"), "shard", "shard_name")


def write_shards(df: DataFrame, key_col: str, path: str, shards: tuple[str, ...] = SHARDS, rows_per_file: int = 1_000_000, weights: tuple[int, ...] | None = None) -> None:
    """df as Parquet, a folder for each shard; a task writes to all of its rows' shards, so no shard is one task."""
    assign(df, key_col, shards, weights=weights).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard_name").parquet(path)


def shard_sizes(assigned: DataFrame) -> DataFrame:
    """(shard, rows), by partial counts."""
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"))
