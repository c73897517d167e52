"""Queries that go on in rounds over stored pages, and the ladder of levels on which a page's terms are found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import rules, sites, text, urls
from orrery.operators import frontier, links, resume, structure, verdicts
from orrery.plans.roles import CANDIDATES, Registry, candidates, pages, sql_any
from orrery.plans.structure import FOOTER_SQL
from orrery.sources.tables import scratch

R = Registry()
ROUNDS = [("words", 2, 2), ("host", 2, 1), ("domain", 2, 2)]  # strategy, rounds, budget
LEAST_PARTS = 14  # paragraphs of a page that is accepted


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[frontier.Strategy]]:
    """Hosts with their first page, pages of many paragraphs, and three ways from page to page."""
    u = F.col("url")
    p = pages(spark, d).select("page_id", "url", "html", urls.host(u).alias("host"), urls.registrable(urls.host(u)).alias("root"))
    starts = p.groupBy("host").agg(F.min("page_id").alias("key")).select(F.col("host").alias("org"), "key")
    accepted = p.filter(F.regexp_count("html", F.lit("<p>")) >= LEAST_PARTS).select(F.col("page_id").alias("key"))
    word = F.lower(F.regexp_extract("html", "<title>([^ <]+)", 1))
    titled = p.groupBy("root", word.alias("word")).agg(F.min("page_id").alias("target"))
    said = links.page_links(p).join(p.select("page_id", "root"), "page_id").select("root", F.lower("text").alias("word"), F.col("page_id").alias("source"), "pos")
    words = said.join(titled, ["root", "word"]).filter("source <> target").select("source", "target", F.length("word").alias("score"), "pos")
    by_host = Window.partitionBy("host").orderBy("page_id")
    host = p.select(F.col("page_id").alias("source"), F.lead("page_id").over(by_host).alias("target")).filter("target IS NOT NULL").select("source", "target", F.lit(1).alias("score"), F.lit(0).alias("pos"))
    firsts = p.groupBy("root", "host").agg(F.min("page_id").alias("first"))
    by_root = Window.partitionBy("root").orderBy("host")  # a row for each host of a domain
    after = firsts.select("host", F.lead("first").over(by_root).alias("target"))
    domain = p.join(after, "host").filter("target IS NOT NULL").select(F.col("page_id").alias("source"), "target", F.lit(1).alias("score"), F.lit(0).alias("pos"))
    edges = {"words": words, "host": host, "domain": domain}
    return starts, accepted, [frontier.Strategy(name, edges[name], rounds, budget) for name, rounds, budget in ROUNDS]


def _round_sql(nth: int, strategy: str, budget: int, before: str) -> str:
    """One round: `before` holds what the frontier is."""
    return f"""open_{nth} AS (SELECT DISTINCT org FROM visited_{nth - 1} WHERE org NOT IN (SELECT org FROM visited_{nth - 1} JOIN accepted USING (key))),
steps_{nth} AS (SELECT f.org, e.target AS key, e.source, e.score, e.pos FROM {before} f JOIN {strategy}_edges e ON e.source = f.key WHERE f.org IN (SELECT org FROM open_{nth}) AND NOT EXISTS (SELECT 1 FROM visited_{nth - 1} v WHERE v.org = f.org AND v.key = e.target)),
best_{nth} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org, key ORDER BY score DESC, pos, source) AS a FROM steps_{nth}) WHERE a = 1),
new_{nth} AS (SELECT org, key, '{strategy}' AS strategy, {nth} AS round FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY score DESC, pos, key) AS b FROM best_{nth}) WHERE b <= {budget}),
visited_{nth} AS (SELECT * FROM visited_{nth - 1} UNION ALL SELECT * FROM new_{nth})"""


def _rounds_sql() -> str:
    out, nth = [], 0
    for strategy, rounds, budget in ROUNDS:
        for r in range(rounds):
            nth += 1
            out.append(_round_sql(nth, strategy, budget, f"visited_{nth - 1}" if r == 0 else f"new_{nth - 1}"))
    return ",\n".join(out)


_LAST = sum(rounds for _, rounds, _ in ROUNDS)
EXPLORED = rf"""hosted AS (SELECT page_id, html, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') AS host FROM pages),
p AS (SELECT *, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS root FROM hosted),
accepted AS (SELECT page_id AS key FROM p WHERE len(regexp_extract_all(html, '<p>')) >= {LEAST_PARTS}),
titled AS (SELECT root, lower(regexp_extract(html, '<title>([^ <]+)', 1)) AS word, min(page_id) AS target FROM p GROUP BY ALL),
said AS (SELECT page_id AS source, root, lower(unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1))) AS word, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>')))) AS pos FROM p),
words_edges AS (SELECT source, target, length(word) AS score, pos FROM said JOIN titled USING (root, word) WHERE source <> target),
host_edges AS (SELECT source, target, 1 AS score, 0 AS pos FROM (SELECT page_id AS source, lead(page_id) OVER (PARTITION BY host ORDER BY page_id) AS target FROM p) WHERE target IS NOT NULL),
firsts AS (SELECT root, host, min(page_id) AS key FROM p GROUP BY ALL), after AS (SELECT host, lead(key) OVER (PARTITION BY root ORDER BY host) AS target FROM firsts),
domain_edges AS (SELECT page_id AS source, target, 1 AS score, 0 AS pos FROM p JOIN after USING (host) WHERE target IS NOT NULL),
visited_0 AS (SELECT host AS org, key, 'start' AS strategy, 0 AS round FROM firsts),
{_rounds_sql()}"""


@R.query(f"WITH {EXPLORED} SELECT org, key, strategy, round::INTEGER AS round, key IN (SELECT key FROM accepted) AS accepted FROM visited_{_LAST}")
def frontier_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Which pages each host visits, in which round and by which strategy, until one of many paragraphs is found."""
    starts, accepted, strategies = _graph(spark, d)
    return frontier.explored(starts, strategies, accepted)[0].select("org", "key", "strategy", "round", "accepted")


@R.query(
    f"""WITH {EXPLORED}, hits AS (SELECT org, arg_min(struct_pack(key := key, strategy := strategy, round := round), struct_pack(r := round, k := key)) AS f FROM visited_{_LAST} JOIN accepted USING (key) GROUP BY org)
    SELECT org, f.key AS key, f.strategy AS strategy, f.round::INTEGER AS round, n_visited FROM (SELECT org, count(*) AS n_visited FROM visited_{_LAST} GROUP BY org) LEFT JOIN hits USING (org)"""
)
def frontier_found(spark: SparkSession, d: str) -> DataFrame:
    """What each host's rounds end in."""
    starts, accepted, strategies = _graph(spark, d)
    return frontier.found(frontier.explored(starts, strategies, accepted)[0])


LEVELS = ["footer", "host", "domain", "platform"]
_TERMS = "regexp_matches(lower(path), '/(terms-of-use|privacy-policy)$')"


@R.query(
    rf"""WITH {FOOTER_SQL}, legal AS (SELECT page_id, url, host, regexp_extract(host, '([^.]+\.(?:{'|'.join(s.replace('.', '[.]') for s in urls.SUFFIXES)})|[^.]+\.[^.]+)$', 1) AS base, root FROM candidates WHERE {_TERMS}),
    own AS (SELECT page_id, host, regexp_extract(host, '([^.]+\.(?:{'|'.join(s.replace('.', '[.]') for s in urls.SUFFIXES)})|[^.]+\.[^.]+)$', 1) AS base, root FROM candidates),
    hits AS (SELECT page_id, 1 AS n, href AS found FROM linked WHERE {sql_any('lower(text)', sites.LEGAL_TEXTS)}
      UNION ALL SELECT o.page_id, 2, min(l.url) FROM own o JOIN legal l USING (host) GROUP BY o.page_id
      UNION ALL SELECT o.page_id, 3, min(l.url) FROM own o JOIN legal l USING (base) GROUP BY o.page_id
      UNION ALL SELECT o.page_id, 4, min(l.url) FROM own o JOIN legal l ON o.root = l.root GROUP BY o.page_id)
    SELECT page_id, (['footer', 'host', 'domain', 'platform'])[n] AS level, found FROM (SELECT *, min(n) OVER (PARTITION BY page_id) AS best FROM hits) WHERE n = best"""
)
def terms_levels(spark: SparkSession, d: str) -> DataFrame:
    """Where each candidate's terms are found: links of its footer, else the legal page of its host, of its domain, of its platform."""
    c = candidates(spark, d).select("page_id", "url", "root", "html", urls.host(F.col("url")).alias("host")).withColumn("base", urls.registrable(F.col("host")))
    foot = structure.links_in_context(structure.structured(c), within=structure.footer).filter(rules.contains_any(F.lower("text"), sites.LEGAL_TEXTS)).select("page_id", F.lit("footer").alias("level"), F.col("href").alias("found"))
    legal = c.filter(F.lower(urls.path(F.col("url"))).rlike("/(terms-of-use|privacy-policy)$"))
    hits = foot
    for level, key in (("host", "host"), ("domain", "base"), ("platform", "root")):
        best = legal.groupBy(key).agg(F.min("url").alias("found"))  # one page of each key, so a hot key joins once
        hits = hits.unionByName(c.select("page_id", key).join(best, key).select("page_id", F.lit(level).alias("level"), "found"))
    return verdicts.first_rung(hits, ["page_id"], LEVELS, value="found")


@R.query(
    rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') AS host, html FROM pages)
    SELECT host, count(*) AS n_pages, sum(len(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>')))::BIGINT AS n_links FROM p GROUP BY host"""
)
def resumed_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Links by host, host by host in parts: one run that stops early and a second one that goes on."""
    job = resume.Resumable(spark, scratch(spark, "resumed"))
    job.deal(pages(spark, d).select("page_id", "html", urls.host(F.col("url")).alias("host")), "host", parts=6)
    work = lambda items: items.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum(F.size(text.anchors(F.col("html")))).cast("long").alias("n_links"))
    job.run(work, most=2)
    job.run(work)
    return job.results()
