"""Results held against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(df: DataFrame, keys: list[str], expected: str, found: str) -> DataFrame:
    """Per row the share of expected strings that some found url contains; rows that expect nothing go."""
    hit = lambda e: F.exists(F.col(found), lambda u: F.contains(u, e))
    hits = F.size(F.filter(F.col(expected), hit))
    return df.filter(F.size(expected) > 0).select(*keys, hits.cast("long").alias("hits"), F.size(expected).cast("long").alias("expected"), F.round(hits / F.size(expected), 4).alias("recall"))


def matches(agent: Column, truth: Column, agent_hosts: Column, truth_hosts: Column) -> Column:
    """Whether any url, or else any host, of the two lists is the same."""
    return F.arrays_overlap(agent, truth) | F.arrays_overlap(agent_hosts, truth_hosts)


def report(df: DataFrame, group: str, correct: Column) -> DataFrame:
    """Per group: rows, correct ones, accuracy in percent."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"))
    return out.withColumn("accuracy_pct", F.round(100.0 * F.col("correct") / F.col("n"), 1))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of both, of the first only, of the second only."""
    x, y = a.select(*keys).distinct().withColumn("a", F.lit(1)), b.select(*keys).distinct().withColumn("b", F.lit(1))
    return x.join(y, keys, "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


def transitions(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.filter(F.col(old) != F.col(new)).groupBy(old, new).agg(F.count("*").alias("n"))
