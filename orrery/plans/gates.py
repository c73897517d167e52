"""The choice among candidates that pass their gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import urls
from orrery.operators import gates
from orrery.plans.roles import PAGE_PARTS, Registry, pages

R = Registry()

@R.query(
    f"""WITH {PAGE_PARTS}, c AS (SELECT *, CASE WHEN contains(path, '/en/') THEN 'en' ELSE 'other' END AS category, page_id % 3 AS score FROM hosts WHERE root <> 'example.org' AND split_part(host, '.', 1) <> 'm')
    SELECT host, category, page_id, score FROM (SELECT *, row_number() OVER (PARTITION BY host, category ORDER BY score DESC, len(rtrim(path, '/')), page_id DESC) AS n FROM c) WHERE n = 1"""
)
def consolidated_pages(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    df = pages(spark, d).select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), F.when(urls.path(u).contains("/en/"), "en").otherwise("other").alias("category"), (F.col("page_id") % 3).alias("score"))
    keep = (urls.registrable(F.col("host")) != "example.org") & (F.substring_index("host", ".", 1) != "m")
    return gates.consolidated(df, keep=keep, host="host", category="category", score="score", path="path", pos="page_id").select("host", "category", "page_id", "score")
