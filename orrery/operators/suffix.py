"""Hosts against rules that hold for a host and its subdomains.

A host has few parents, so each host is exploded to itself and its parents and met by an equi join; there is no
nested loop over rules, and the rules may be of any number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.urls import host_suffixes
from orrery.operators.dedup import top


def suffix_matches(df: DataFrame, rules: DataFrame, host: str, root: str) -> DataFrame:
    """Each row of df with each rule whose root is its host or a parent of it."""
    exploded = df.withColumn("__suffix", F.explode(host_suffixes(F.col(host))))
    return exploded.join(rules, exploded["__suffix"] == rules[root]).drop("__suffix")


def not_under(df: DataFrame, roots: DataFrame, host: str, root: str) -> DataFrame:
    """Rows whose host is under none of the roots. Works per distinct host, which a table has far fewer of than rows."""
    hosts = df.select(host).distinct()
    blocked = suffix_matches(hosts, roots.select(root), host, root).select(host).distinct()
    return df.join(blocked, host, "left_anti")


def first_match(df: DataFrame, rules: DataFrame, host: str, root: str, order: str, keys: list[str]) -> DataFrame:
    """Each row (by keys) with its first matching rule, if it has one."""
    return top(suffix_matches(df, rules, host, root), keys, [F.col(order)])


def tenant(df: DataFrame, host: str, root: str, into: str) -> DataFrame:
    """What stands before the root in the host; null for the bare root."""
    n = F.length(host) - F.length(root) - 1
    return df.withColumn(into, F.when(n > 0, F.substr(F.col(host), F.lit(1), n)))
