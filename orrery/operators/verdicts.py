"""Verdicts on documents combined for their owner, and ladders of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE_FOUND = "Yes (No T&C Found)"
# The stricter verdict wins a tie; parts of urls that name binding terms.
SEVERITY = {"No": 3, "Maybe": 2, "Yes": 1}
TERMS = ["terms-and-conditions", "terms_condition", "termsandcondition", "terms-of-use", "terms-of-service", "termsofuse", "termsofservice", "/terms", "/tos", "/tou", "/legal", "conditions-of-use"]


def severity(verdict: Column) -> Column:
    out = F.lit(0)
    for v, n in SEVERITY.items():
        out = F.when(verdict == v, n).otherwise(out)
    return out


def is_terms_url(url: Column) -> Column:
    return F.exists(F.lit(TERMS), lambda t: F.contains(F.lower(url), t))


def majority(df: DataFrame, key: str, verdict: str = "verdict") -> DataFrame:
    """Per key the most frequent verdict, of equals the strictest; if no document was found for any, that."""
    plain = F.when(F.col(verdict) == NONE_FOUND, "Yes").otherwise(F.col(verdict))
    votes = df.groupBy(key, plain.alias("v")).agg(F.count("*").alias("n"), F.bool_and(F.col(verdict) == NONE_FOUND).alias("none"))
    best = votes.groupBy(key).agg(F.max_by("v", F.struct("n", severity(F.col("v")))).alias("verdict"), F.bool_and("none").alias("none"))
    return best.select(key, F.when(F.col("none"), NONE_FOUND).otherwise(F.col("verdict")).alias("verdict"))


def terms_first(df: DataFrame, key: str, terms: Column, verdict: str = "verdict") -> DataFrame:
    """Per key the strictest verdict of its binding terms; without such, the majority of all."""
    bound = F.when(terms & (F.col(verdict) != NONE_FOUND), F.struct(severity(F.col(verdict)).alias("s"), F.col(verdict).alias("v")))
    strict = df.groupBy(key).agg(F.max(bound)["v"].alias("strict"))
    return majority(df, key, verdict).join(strict, key).select(key, F.coalesce("strict", "verdict").alias("verdict"))


def first_rung(hits: DataFrame, keys: list[str], rungs: list[str], rung: str = "level", value: str = "url") -> DataFrame:
    """Of each key, the hits of the first rung of a ladder that has any."""
    nth = F.array_position(F.lit(rungs), F.col(rung))
    best = hits.filter(nth > 0).groupBy(*keys).agg(F.min(nth).alias("nth"))
    return hits.withColumn("nth", nth).join(best, [*keys, "nth"], "left_semi").drop("nth").select(*keys, rung, value)


def waterfall(won: DataFrame, keys: list[str], rungs: list[str], rung: str = "level", value: str = "url") -> DataFrame:
    """A row per key and a column per rung: `n/a` before the rung that won, its values there, empty after it."""
    nth = F.array_position(F.lit(rungs), F.col(rung))
    cells = won.groupBy(*keys).agg(F.min(nth).alias("nth"), F.array_join(F.array_sort(F.collect_set(value)), "\n").alias("cell"))
    return cells.select(*keys, *[F.when(F.col("nth") > i, "n/a").when(F.col("nth") == i, F.col("cell")).otherwise("").alias(r) for i, r in enumerate(rungs, 1)])


def cascade(df: DataFrame, caches: list[tuple[str, DataFrame, list[str]]], *, scored: Column, verdict: str = "verdict") -> DataFrame:
    """df with the verdict of the first cache that has its keys, else a score, and `via`, the name of what gave it.

    caches: name, table of unique keys and verdict, keys. Tables meet by equi joins, so none needs to be small.
    """
    via, value = F.lit("scored"), scored
    for i, (_, table, keys) in enumerate(caches):
        df = df.join(table.select(*keys, F.col(verdict).alias(f"__{i}")), keys, "left")
    for i in range(len(caches), 0, -1):
        via, value = F.when(F.col(f"__{i - 1}").isNotNull(), caches[i - 1][0]).otherwise(via), F.coalesce(f"__{i - 1}", value)
    return df.withColumns({verdict: value, "via": via}).drop(*[f"__{i}" for i in range(len(caches))])


def through(df: DataFrame, tables: list[tuple[str, DataFrame]], keys: list[str], *, default: str, verdict: str = "verdict") -> DataFrame:
    """df with the verdict of the first table that has its keys and where it came from; the default and `none` if none has."""
    out = cascade(df, [(name, table, keys) for name, table in tables], scored=F.lit(default), verdict=verdict)
    return out.withColumn("via", F.when(F.col("via") == "scored", "none").otherwise(F.col("via")))


def escalated(df: DataFrame, second: DataFrame, keys: list[str], *, when: Column, verdict: str = "verdict") -> DataFrame:
    """df where rows that satisfy `when` take the verdict of `second` (keys, second), if it has one; via says which."""
    joined = df.withColumn("__up", F.coalesce(when, F.lit(False))).join(second, keys, "left")
    use = F.col("__up") & F.col("second").isNotNull()
    return joined.withColumns({verdict: F.when(use, F.col("second")).otherwise(F.col(verdict)), "via": F.when(use, "second").otherwise("keyword")}).drop("__up", "second")


def per_org(orgs: DataFrame, findings: DataFrame, judged: DataFrame, *, org: str, url: str) -> DataFrame:
    """A row for each organisation: its finding's level, verdict and confidence; a default row where nothing was found.

    A finding that nobody judged counts as unclear.
    """
    joined = orgs.join(findings, org, "left").join(judged, url, "left")
    verdict = F.when(F.col(url).isNull(), NONE_FOUND).otherwise(F.coalesce("verdict", F.lit("Maybe")))
    confidence = F.when(F.col(url).isNull(), 0.6).otherwise(F.coalesce("confidence", F.lit(0.0)))
    return joined.select(org, url, F.coalesce("level", F.lit("none")).alias("level"), verdict.alias("verdict"), confidence.alias("confidence"))
