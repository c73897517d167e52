"""Insights of a catalogue in one pass, from a summary that adds up.

The summary has a row for each organisation and category, with its numbers of portals. Summaries of parts of a catalogue
are merged by adding, so a day's portals are folded into yesterday's summary, and all levels (totals, countries,
states, categories) come out of one scan of it by grouping sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["orgid", "country", "state", "category"]
LEVELS = [(), ("country",), ("country", "state"), ("category",)]


def summary(orgs: DataFrame, portals: DataFrame) -> DataFrame:
    """KEYS, n_portals and n_final. orgs: orgid (unique), country, state; one without portals has a row of null category.

    portals: orgid, category, status. Portals of unknown organisations count in rows of null country and state.
    """
    counted = portals.groupBy("orgid", F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n_portals"), F.count_if(F.col("status") == "F").alias("n_final"))
    known = orgs.select("orgid", "country", "state", F.lit(True).alias("__known"))
    both = known.join(counted, "orgid", "full")
    return both.select(*KEYS, F.coalesce("n_portals", F.lit(0)).cast("long").alias("n_portals"), F.coalesce("n_final", F.lit(0)).cast("long").alias("n_final"), F.coalesce("__known", F.lit(False)).alias("known"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The summary of both parts; a row of an organisation without portals goes once it has some."""
    both = a.unionByName(b).groupBy(*KEYS).agg(F.sum("n_portals").alias("n_portals"), F.sum("n_final").alias("n_final"), F.bool_or("known").alias("known"))
    covered = both.filter("category IS NOT NULL").select("orgid").distinct().withColumn("__covered", F.lit(True))
    return both.join(covered, "orgid", "left").filter("category IS NOT NULL OR __covered IS NULL").drop("__covered")


def insights(found: DataFrame) -> DataFrame:
    """Of a summary, a row for each group of each level: level, country, state, category, n_orgs, n_portals, n_covered, n_final, coverage_pct.

    n_orgs counts known organisations, n_covered those with portals. At the level of categories, n_orgs are those that
    have the category. Rows of null category stand for no category and form no group there. An empty summary has no group.
    """
    sets = [[F.col(c) for c in level] for level in LEVELS]
    known = F.count_distinct(F.when(F.col("known"), F.col("orgid")))
    covered = F.count_distinct(F.when(F.col("known") & (F.col("n_portals") > 0), F.col("orgid")))
    level = F.when(F.grouping("category") == 0, "category").when(F.grouping("state") == 0, "state").when(F.grouping("country") == 0, "country").otherwise("total")
    out = found.groupingSets(sets, "country", "state", "category").agg(level.alias("level"), known.alias("n_orgs"), F.coalesce(F.sum("n_portals"), F.lit(0)).alias("n_portals"), covered.alias("n_covered"), F.coalesce(F.sum("n_final"), F.lit(0)).alias("n_final"))
    out = out.filter((F.col("level") != "category") | F.col("category").isNotNull())
    percent = F.when(F.col("n_orgs") > 0, F.round(100.0 * F.col("n_covered") / F.col("n_orgs"), 1)).otherwise(0.0)
    return out.withColumn("coverage_pct", percent).select("level", "country", "state", "category", "n_orgs", "n_portals", "n_covered", "n_final", "coverage_pct")
