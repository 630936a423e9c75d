"""Helpers that keep expressions short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with one copy of x in the plan, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that the optimiser neither copies into their uses nor into conditions pushed below."""
    return df.select("*", F.inline(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))))
