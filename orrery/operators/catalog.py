"""Browsing, searching and counting a catalogue of organisations and their portals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.dedup import not_in, top_groups


def like_any(text: str, *cols: Column) -> Column:
    """Case-insensitive LIKE over several columns; `%` and `_` in the text are wildcards."""
    out = F.lit(False)
    for c in cols:
        out = out | F.lower(c).like(f"%{text.lower()}%")
    return F.coalesce(out, F.lit(False))


def only(df: DataFrame, **equal: str | None) -> DataFrame:
    """Rows that equal every given value; None asks for nothing."""
    for name, value in equal.items():
        if value:
            df = df.filter(F.col(name) == value)
    return df


def page(df: DataFrame, order: list[Column], *, offset: int = 0, limit: int = 50, most: int = 500) -> DataFrame:
    """A page of rows: offset at least 0, limit from 1 to `most`. The order must end in a unique column."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def with_portal_counts(orgs: DataFrame, portals: DataFrame) -> DataFrame:
    """Organisations with n_portals; portals are counted first, so the join meets one row for each organisation."""
    counts = portals.groupBy("orgid").agg(F.count("*").alias("n_portals"))
    return orgs.join(counts, "orgid", "left").withColumn("n_portals", F.coalesce("n_portals", F.lit(0)).cast("long"))


def without_portals(orgs: DataFrame, portals: DataFrame) -> DataFrame:
    return not_in(orgs, portals, ["orgid"])


def portal_cells(portals: DataFrame, *keys: str, rows: int = 250_000) -> DataFrame:
    """Per key, which begins with orgid: the urls of the portals, by category and url, one under the other in a cell, and n_portals.

    Portals are counted, then dealt into parts of about `rows`, so that what a task sorts doesn't grow with the table.
    """
    parts = max(portals.sparkSession.sparkContext.defaultParallelism, -(-portals.count() // rows))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "portal_url"))), lambda p: p["portal_url"]), "\n")
    return portals.select(*keys, "category", "portal_url").repartition(parts, "orgid").groupBy(*keys).agg(cell.alias("portals"), F.count("*").alias("n_portals"))


def with_portal_list(orgs: DataFrame, portals: DataFrame) -> DataFrame:
    """Organisations with the urls of their portals, by category and url, one under the other in a cell."""
    return orgs.join(portal_cells(portals, "orgid").drop("n_portals"), "orgid", "left").withColumn("portals", F.coalesce("portals", F.lit("")))


def search(orgs: DataFrame, portals: DataFrame, text: str, *, groups: int = 20, country: str | None = None) -> DataFrame:
    """Portals whose organisation, url or category holds the text; the limit counts organisations, not portals."""
    found = only(portals.join(orgs.select("orgid", "name", "country"), "orgid"), country=country)
    found = found.filter(like_any(text, F.col("name"), F.col("portal_url"), F.col("category")))
    return top_groups(found, ["name", "orgid"], groups)


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count("*").alias(name))


def country_counts(orgs: DataFrame, portals: DataFrame) -> DataFrame:
    """Per country: organisations, portals, and organisations with portals; countries of any of the three."""
    named = lambda df: df.filter(F.coalesce(F.col("country"), F.lit("")) != "")
    a = named(orgs).groupBy("country").agg(F.count("*").alias("n_orgs"))
    b = named(portals).groupBy("country").agg(F.count("*").alias("n_portals"), F.countDistinct("orgid").alias("n_covered"))
    return a.join(b, "country", "full").na.fill(0, ["n_orgs", "n_portals", "n_covered"])


def insights(orgs: DataFrame, portals: DataFrame, verified: DataFrame) -> DataFrame:
    """One row of totals: coverage in percent, portals per covered organisation, and both for verified ones."""
    o = orgs.agg(F.count("*").alias("n_orgs"))
    p = portals.agg(F.count("*").alias("n_portals"), F.countDistinct("orgid").alias("n_covered"))
    v = verified.select("orgid").distinct().join(orgs.select("orgid"), "orgid", "left_semi").agg(F.count("*").alias("n_verified"))
    out = o.crossJoin(p).crossJoin(v)  # one row each
    percent = F.when(F.col("n_orgs") > 0, F.round(100.0 * F.col("n_covered") / F.col("n_orgs"), 1)).otherwise(0.0)
    each = F.when(F.col("n_covered") > 0, F.round(F.col("n_portals") / F.col("n_covered"), 1)).otherwise(0.0)
    return out.withColumns({"coverage_pct": percent, "per_covered": each})


def profile(orgs: DataFrame, portals: DataFrame) -> DataFrame:
    """Organisations by id, of those without a row what their portals say (the largest value of each column)."""
    said = portals.groupBy("orgid").agg(F.max("university").alias("p_name"), F.max("country").alias("p_country"), F.count("*").alias("n_portals"))
    both = orgs.join(said, "orgid", "full")
    return both.select("orgid", F.coalesce("name", "p_name", F.lit("")).alias("name"), F.coalesce("country", "p_country", F.lit("")).alias("country"), F.coalesce("n_portals", F.lit(0)).cast("long").alias("n_portals"))


def backfill(orgs: DataFrame, portals: DataFrame) -> DataFrame:
    """Organisations that only portals know, to be inserted."""
    known = portals.groupBy("orgid").agg(F.max("university").alias("name"), F.max("country").alias("country"))
    return not_in(known, orgs, ["orgid"])
