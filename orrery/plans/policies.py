"""Candidates as documents of terms, by three validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import sites, urls
from orrery.operators import ledger, policies, structure
from orrery.plans.roles import CANDIDATES, Registry, candidates, sql_any, sql_under
from orrery.plans.structure import _pieces

R = Registry()
ALLOWED = ["uni.ac.in", "college.edu", "usp.br", "x.edu.au", "talentlms.com"]
#: The url of a candidate as a document, and what was observed: a path that names one, a status and where it ended.
DOCUMENTS = ["/terms-of-use", "/privacy", "/x/app.js", "/gdpr/", "/legal/notice.pdf", "/prospectus.pdf", "/about", "/error.html", "/disclaimer"]
_PATH = "([" + ", ".join(f"'{p}'" for p in DOCUMENTS) + "])[(length(html) % 9) + 1]"


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates at the address of a document: which one, and the status, follow from the length of the page."""
    c, n = candidates(spark, d), F.length("html")
    path = F.element_at(F.lit(DOCUMENTS), (n % 9 + 1).cast("int"))
    base = F.concat(F.lit("https://"), urls.authority(F.col("url")))
    status = F.when(n % 11 == 3, 404).otherwise(200)
    final = F.when(n % 13 == 5, F.concat(base, F.lit("/"))).when(n % 13 == 7, F.concat(base, F.lit("/x?ReturnUrl=a"))).otherwise(F.concat(base, path))
    return structure.structured(c.select("page_id", F.concat(base, path).alias("url"), final.alias("final_url"), status.alias("status"), "html"), keep=("page_id", "url", "final_url", "status", "html"))


OBSERVED = rf"""{CANDIDATES}, seen AS (SELECT page_id, host, authority, html, low, lower({_PATH}) AS p, CASE WHEN length(html) % 11 = 3 THEN 404 ELSE 200 END AS status,
  CASE WHEN length(html) % 13 = 5 THEN '/' WHEN length(html) % 13 = 7 THEN '/x' ELSE {_PATH} END AS ends, CASE WHEN length(html) % 13 = 7 THEN 'returnurl=a' ELSE '' END AS q FROM candidates),
shown AS (SELECT *, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '<x>', 'g') AS bare FROM seen),
said AS (SELECT *, lower({_pieces('bare')}) AS body, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' | ' || array_to_string(list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)[1:5], lambda h: {_pieces('h')}), ' | ')) AS head FROM shown)"""


def _stage(q: DataFrame, stages: list) -> DataFrame:
    return ledger.ledger(q, stages).select("page_id", "stage", "reason")


@R.query(
    rf"""WITH {OBSERVED}, base AS (SELECT *, regexp_extract(host, '([^.]+\.(?:{'|'.join(s.replace('.', '[.]') for s in urls.SUFFIXES)})|[^.]+\.[^.]+)$', 1) AS root FROM said),
    v AS (SELECT page_id, CASE WHEN regexp_matches(p, '[.]js$') THEN 'asset|script or asset' WHEN p = '/gdpr/' THEN 'law|landing on a law' WHEN root NOT IN ('uni.ac.in', 'college.edu') AND NOT regexp_matches(p, 'term|privac|/legal|polic') THEN 'third party|unrelated third party' END AS verdict FROM base)
    SELECT page_id, nullif(split_part(verdict, '|', 1), '') AS stage, nullif(split_part(verdict, '|', 2), '') AS reason FROM v"""
)
def document_urls(spark: SparkSession, d: str) -> DataFrame:
    return _stage(observed(spark, d), policies.document_url(F.col("url"), [F.lit("uni.ac.in"), F.lit("college.edu")]))


def _first(words: list[str], c: str) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({c}, w))[1]"


@R.query(
    rf"""WITH {OBSERVED}, v AS (SELECT page_id, CASE WHEN NOT {sql_under('host', ALLOWED)} THEN 'host|host not allowed' WHEN p = '/error.html' THEN 'error url|error address' WHEN {_first(sites.OTHER_DOCUMENTS, 'p')} IS NOT NULL THEN 'other document|another document: ' || {_first(sites.OTHER_DOCUMENTS, 'p')}
      WHEN status <> 200 THEN 'status|status 404' WHEN trim(low) = '' THEN 'empty|empty body' WHEN {_first(policies.BODY_ERRORS, 'low')} IS NOT NULL THEN 'error body|error: ' || {_first(policies.BODY_ERRORS, 'low')}
      WHEN length(html) < 500 THEN 'size|too short' WHEN length(html) > 80000 THEN 'size|too long' WHEN NOT {sql_any('head', policies.TITLE_WORDS)} THEN 'title|title and headings name no terms' WHEN len(regexp_extract_all(low, '<a[ >]')) > 50 THEN 'links|too many links'
      WHEN {_first(policies.HOME_MARKS, 'low')} IS NOT NULL THEN 'home page|home page: ' || {_first(policies.HOME_MARKS, 'low')} END AS verdict FROM said)
    SELECT page_id, nullif(split_part(verdict, '|', 1), '') AS stage, nullif(split_part(verdict, '|', 2), '') AS reason FROM v"""
)
def strict_pages(spark: SparkSession, d: str) -> DataFrame:
    return _stage(observed(spark, d), policies.strict_page(F.lit(ALLOWED)))


@R.query(
    rf"""WITH {OBSERVED}, v AS (SELECT page_id, CASE WHEN p = '/prospectus.pdf' THEN 'file name|file without a legal name' WHEN ends_with(p, '.pdf') THEN NULL WHEN length(low) < 200 OR {sql_any('low', sites.CHALLENGES)} THEN 'blocked|empty or blocked'
      WHEN NOT {sql_under('host', ALLOWED)} THEN 'final host|redirected elsewhere' WHEN {sql_any('p', policies.SLUGS)} AND ends = '/' THEN 'home page|redirected to the home page' WHEN q <> '' THEN 'login|address to return to'
      WHEN {sql_any('p', policies.SLUGS)} AND contains(body, 'password') AND {sql_any('body', sites.LOGIN_MARKS)} AND length(body) < 2500 THEN 'login|login page' WHEN {sql_any('ends', policies.ERROR_PARTS)} THEN 'error|error page'
      WHEN length(body) < 500 THEN 'content|too short' WHEN {sql_any('body', policies.NOT_FOUND)} THEN 'content|says not found' WHEN p NOT IN ('/terms-of-use', '/privacy', '/disclaimer') THEN 'article|article or other page'
      WHEN NOT {sql_any('body', policies.BODY_WORDS)} THEN 'words|speaks of no terms' END AS verdict FROM said)
    SELECT page_id, nullif(split_part(verdict, '|', 1), '') AS stage, nullif(split_part(verdict, '|', 2), '') AS reason FROM v"""
)
def level_pages(spark: SparkSession, d: str) -> DataFrame:
    return _stage(observed(spark, d), policies.level_page(F.lit(ALLOWED)))
