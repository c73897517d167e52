"""One row per key under stated tie rules.

Every function ranks in a window over the keys; order columns must end in one that is unique within a key, so that
results don't depend on the partitions. Spark keeps only the leading rows of a group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, keys: list, order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; `rank` names a column for their place."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def top_groups(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The rows of the n first groups, in the order of their keys."""
    firsts = df.select(*keys).distinct().orderBy(*keys).limit(n)
    return df.join(firsts, keys, "left_semi")


def not_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the other table lacks, null keys matching each other."""
    a, b = df.alias("a"), other.select(*on).distinct().alias("b")
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, cond, "left_anti")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """old and those rows of new whose key it lacks, the first of each key."""
    return old.unionByName(not_in(top(new, keys, order), old, keys))
