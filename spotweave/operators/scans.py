"""Running values over long sorted groups, without a task that holds a group.

A window over a group sorts the group in one task. Here all rows are range-partitioned by (group, order) and written once;
each partition is scanned on its own, and what earlier partitions leave to a group that goes on is carried over by a small
pass: a group that spans partitions has one row in each of them, so there are fewer such rows than twice the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.tables import written

PART, PLACE = "_part", "_place"


def range_sorted(rows: DataFrame, group: list[str], order: list[Column | str], partitions: int | None = None) -> DataFrame:
    """rows with `_part` and `_place`: ranges of (group, order), and the place in that order within a range. Written once.

    Without `partitions`, there are as many as the session's setting for shuffles, small ones put together.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), *map(F.col, group), *order).sortWithinPartitions(*group, *order)
    return written(dealt.withColumn(PLACE, F.monotonically_increasing_id()).withColumn(PART, F.spark_partition_id()))


def running(laid: DataFrame, group: list[str], values: dict[str, tuple[str, Column]], upto: int = 0) -> DataFrame:
    """`laid`, the result of range_sorted, with running values of each group.

    values: by the name of the new column, a pair (how, of): the "sum", "count" (of what isn't null), "max" or "last" (that
    isn't null) of all rows of the group up to this one (upto=0) or before it (upto=-1); where there are none, null, or 0 for a count.
    """
    own = Window.partitionBy(PART, *group).orderBy(PLACE)
    scan = {"sum": F.sum, "count": F.count, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    before = {n: scan[how](c).over(own.rowsBetween(Window.unboundedPreceding, upto)) for n, (how, c) in values.items()}
    # what each partition leaves to a group: its first and last group only can go on
    whole = {"sum": F.sum, "count": F.count, "max": F.max, "last": lambda c: F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col(PLACE)))}
    left = laid.groupBy(PART, *group).agg(*[whole[how](c).alias(f"_of_{n}") for n, (how, c) in values.items()])
    ends = laid.groupBy(PART).agg(F.min_by(F.struct(*group), PLACE).alias("_first"), F.max_by(F.struct(*group), PLACE).alias("_final"))
    spanning = ends.select(PART, F.explode(F.array("_first", "_final")).alias("_g")).select(PART, "_g.*").distinct()
    carried = left.join(F.broadcast(spanning.withColumnsRenamed({c: f"_g_{c}" for c in (PART, *group)})), [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in (PART, *group)], "left_semi")  # two rows a partition
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    carry = carried.select(F.col(PART).alias("_cp"), *[F.col(c).alias(f"_c_{c}") for c in group], *[merge[how](F.col(f"_of_{n}")).over(earlier).alias(f"_carry_{n}") for n, (how, _) in values.items()])
    joined = laid.select("*", *[c.alias(n) for n, c in before.items()]).join(F.broadcast(carry), (F.col(PART) == F.col("_cp")) & _all([F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in group]), "left")

    def both(n: str, how: str) -> Column:
        if how == "last":
            return F.coalesce(n, f"_carry_{n}")
        if how == "max":
            return F.greatest(n, f"_carry_{n}")
        zero = F.lit(0)
        total = F.coalesce(n, zero) + F.coalesce(f"_carry_{n}", zero)
        return total if how == "count" else F.when(F.col(n).isNotNull() | F.col(f"_carry_{n}").isNotNull(), total)

    return joined.select(*laid.columns, *[both(n, how).alias(n) for n, (how, _) in values.items()])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
