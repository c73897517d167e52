"""Spreadsheet cells with many values, and tables reconciled with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import cell_items
from orrery.operators.dedup import not_in


def exploded(df: DataFrame, cell: str, into: str, between: str = "[\\r\\n,]+") -> DataFrame:
    """A row per item of a cell; rows without items go."""
    return df.withColumn(into, F.explode(cell_items(F.col(cell), between)))


def zipped(df: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """A row per item of the left cell, with the item at its place in the right cell if both have as many, else N/A."""
    a, b = cell_items(F.col(left), "\n"), cell_items(F.col(right), "\n")
    pairs = F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b"))).otherwise(F.transform(a, lambda x: F.struct(x.alias("a"), F.lit("N/A").alias("b"))))
    return df.select(*keys, F.posexplode(pairs).alias("pos", "p")).select(*keys, "pos", F.col("p.a").alias(left), F.col("p.b").alias(right))


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], into: str, keep: Column) -> DataFrame:
    """Distinct keys and values of several columns that satisfy a condition."""
    return df.unpivot(keys, columns, "__column", into).filter(keep).select(*keys, into).distinct()


def missing_pairs(left: DataFrame, right: DataFrame, existing: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Per key every pair of a left and a right value that isn't there yet; without right values, one blank each."""
    pairs = left.select(key, a).distinct().join(right.select(key, b).distinct(), key, "left").withColumn(b, F.coalesce(b, F.lit("")))
    return not_in(pairs, existing, [key, a, b])


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with the side that lacks them; keys of both are in no row."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def block_of(df: DataFrame, hits: DataFrame, on: list[str], block: list[str]) -> DataFrame:
    """All rows of the blocks of which some row is hit."""
    blocks = df.join(hits.select(*on).distinct(), on, "left_semi").select(*block).distinct()
    return df.join(blocks, block, "left_semi")
