"""Keyed changes to tables that are rewritten, not updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updated(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with the columns of changes where their key is in it; null changes leave a value. Keys of changes are unique."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def set_where(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """df with new values in rows that satisfy a condition."""
    return df.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def removed(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def chained(df: DataFrame, steps: list[Column], into: str) -> DataFrame:
    """df with the first step's value that is there and not empty, and that step's number; null and 0 if none is."""
    there = [F.coalesce(s, F.lit("")) != "" for s in steps]
    nth, value = F.lit(0), F.lit(None).cast("string")
    for i in range(len(steps), 0, -1):
        nth, value = F.when(there[i - 1], i).otherwise(nth), F.when(there[i - 1], steps[i - 1]).otherwise(value)
    return df.withColumns({into: value, f"{into}_step": nth})


def one_hop(df: DataFrame, parents: DataFrame, *, key: str, parent: str, value: str) -> DataFrame:
    """The values of each row and, of rows that name a parent, the parent's; parents of parents aren't followed."""
    own = df.select(key, value, F.lit("own").alias("via"))
    theirs = parents.select(F.col(key).alias("__parent"), F.col(value).alias("__value")).distinct()
    got = df.select(key, parent).distinct().join(theirs, F.col(parent) == F.col("__parent")).select(key, F.col("__value").alias(value), F.lit("parent").alias("via"))
    return own.unionByName(got).groupBy(key, value).agg(F.min("via").alias("via"))
