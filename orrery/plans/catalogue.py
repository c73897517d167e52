"""Queries over organisations, portals and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import urls
from orrery.operators import catalog, cells, dedup, feedback, insights, paging
from orrery.plans.roles import ALL_PORTALS, FEEDBACK, ORGS, Registry, all_portals, orgs
from orrery.plans.roles import feedback as log
from orrery.sources.tables import parquet, scratch

R = Registry()


@R.query(
    f"""WITH {ALL_PORTALS}, n AS (SELECT orgid, count(*) AS n_portals, string_agg(portal_url, chr(10) ORDER BY category, portal_url) AS portals FROM all_portals GROUP BY orgid)
    SELECT o.orgid, o.name, o.country, coalesce(n_portals, 0) AS n_portals, coalesce(n.portals, '') AS portals FROM orgs o LEFT JOIN n USING (orgid) ORDER BY n_portals DESC, name, orgid LIMIT 40"""
)
def browse_orgs(spark: SparkSession, d: str) -> DataFrame:
    """The first page of organisations, most portals first, with their portals in a cell."""
    o, p = orgs(spark, d), all_portals(spark, d)
    first = catalog.page(catalog.with_portal_counts(o, p), [F.col("n_portals").desc(), F.col("name"), F.col("orgid")], limit=40)
    return catalog.with_portal_list(first, p).select("orgid", "name", "country", "n_portals", "portals")


@R.query(f"WITH {ALL_PORTALS} SELECT orgid, name FROM orgs WHERE orgid NOT IN (SELECT orgid FROM all_portals WHERE status = 'P' AND category = '1-URGENT')")
def browse_missing(spark: SparkSession, d: str) -> DataFrame:
    """Organisations without a portal that is urgent and pending."""
    return catalog.without_portals(orgs(spark, d), all_portals(spark, d).filter("status = 'P' AND category = '1-URGENT'")).select("orgid", "name")


@R.query(
    f"""WITH {ALL_PORTALS}, hits AS (SELECT * FROM all_portals WHERE lower(university) LIKE '%customer#0000_1%' OR lower(portal_url) LIKE '%org77.%'),
    g AS (SELECT DISTINCT university, orgid FROM hits ORDER BY university, orgid LIMIT 20) SELECT h.orgid, h.university AS name, h.portal_url FROM hits h JOIN g USING (university, orgid)"""
)
def search_groups(spark: SparkSession, d: str) -> DataFrame:
    """Wildcards in the text are live; the limit counts organisations."""
    p = all_portals(spark, d)
    hits = p.filter(catalog.like_any("customer#0000_1", F.col("university")) | catalog.like_any("org77.", F.col("portal_url"))).withColumnRenamed("university", "name")
    return dedup.top_groups(hits, ["name", "orgid"], 20).select("orgid", "name", "portal_url")


@R.query(f"WITH {ALL_PORTALS} SELECT id, orgid, category, portal_url FROM all_portals WHERE country = 'BRAZIL' OR country = (SELECT min(country) FROM orgs) ORDER BY university, category, portal_url, id LIMIT 50 OFFSET 10")
def portal_page(spark: SparkSession, d: str) -> DataFrame:
    p = all_portals(spark, d)
    first = orgs(spark, d).agg(F.min("country").alias("first"))  # one row
    p = p.crossJoin(F.broadcast(first)).filter((F.col("country") == "BRAZIL") | (F.col("country") == F.col("first")))
    return catalog.page(p, [F.col("university"), F.col("category"), F.col("portal_url"), F.col("id")], offset=10, limit=50).select("id", "orgid", "category", "portal_url")


@R.query(f"WITH {ORGS} SELECT state, count(*) AS n FROM orgs GROUP BY state")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.count_by(orgs(spark, d), "state")


@R.query(
    f"""WITH {ALL_PORTALS}, a AS (SELECT country, count(*) AS n_orgs FROM orgs GROUP BY country), b AS (SELECT country, count(*) AS n_portals, count(DISTINCT orgid) AS n_covered FROM all_portals GROUP BY country)
    SELECT country, coalesce(n_orgs, 0) AS n_orgs, coalesce(n_portals, 0) AS n_portals, coalesce(n_covered, 0) AS n_covered FROM a FULL JOIN b USING (country)"""
)
def country_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.country_counts(orgs(spark, d), all_portals(spark, d))


@R.query(
    f"""WITH {ALL_PORTALS}, o AS (SELECT count(*) AS n_orgs FROM orgs), p AS (SELECT count(*) AS n_portals, count(DISTINCT orgid) AS n_covered FROM all_portals),
    v AS (SELECT count(*) AS n_verified FROM orgs WHERE orgid IN (SELECT l_suppkey FROM lineitem)) SELECT n_orgs, n_portals, n_covered, n_verified, round(100.0 * n_covered / n_orgs, 1) AS coverage_pct, round(n_portals / n_covered, 1) AS per_covered FROM o, p, v"""
)
def insights_totals(spark: SparkSession, d: str) -> DataFrame:
    verified = parquet(spark, d, "lineitem").select(F.col("l_suppkey").alias("orgid"))
    return catalog.insights(orgs(spark, d), all_portals(spark, d), verified)


@R.query(
    f"""WITH {ALL_PORTALS}, b AS (SELECT orgid, count(*) AS n FROM all_portals GROUP BY orgid) SELECT country, count(*) AS n_orgs, count(n) AS n_covered, round(100.0 * count(n) / count(*), 1) AS coverage_pct
    FROM orgs LEFT JOIN b USING (orgid) GROUP BY country"""
)
def insights_country(spark: SparkSession, d: str) -> DataFrame:
    x = catalog.with_portal_counts(orgs(spark, d), all_portals(spark, d))
    out = x.groupBy("country").agg(F.count("*").alias("n_orgs"), F.count_if(F.col("n_portals") > 0).alias("n_covered"))
    return out.withColumn("coverage_pct", F.round(100.0 * F.col("n_covered") / F.col("n_orgs"), 1))


@R.query(f"WITH {ORGS} SELECT country, state, count(*) AS n FROM orgs GROUP BY ALL ORDER BY n DESC, country, state LIMIT 15")
def top_states(spark: SparkSession, d: str) -> DataFrame:
    return orgs(spark, d).groupBy("country", "state").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "country", "state").limit(15)


@R.query(f"WITH {ALL_PORTALS} SELECT category, count(*) AS n, count(DISTINCT orgid) AS n_orgs, count(*) FILTER (status = 'F') AS n_final FROM all_portals GROUP BY category")
def category_dist(spark: SparkSession, d: str) -> DataFrame:
    return all_portals(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("orgid").alias("n_orgs"), F.count_if(F.col("status") == "F").alias("n_final"))


@R.query(f"WITH {ALL_PORTALS} SELECT country, state, name, portal_url, category FROM all_portals JOIN orgs USING (orgid, country) WHERE category <> ''")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    p = all_portals(spark, d).join(orgs(spark, d).select("orgid", "state", "name"), "orgid")
    return p.select("country", "state", "name", "portal_url", "category").orderBy("country", "state", "name", "portal_url")


@R.query(f"WITH {ALL_PORTALS} SELECT id, portal_url FROM all_portals WHERE portal_url LIKE 'https://p1.%' OR orgid = 7")
def lookup_domain(spark: SparkSession, d: str) -> DataFrame:
    p = all_portals(spark, d)
    return p.filter(urls.host(F.col("portal_url")).startswith("p1.") | (F.col("orgid") == 7)).select("id", "portal_url")


@R.query("SELECT event_id AS id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY event_id DESC LIMIT 200")
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    e = parquet(spark, d, "events").orderBy(F.col("event_id").desc()).limit(200)
    return e.select(F.col("event_id").alias("id"), "user_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


@R.query(
    f"""WITH {ALL_PORTALS}, s AS (SELECT s_suppkey AS orgid, s_name AS name, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0)
    SELECT coalesce(s.orgid, p.orgid) AS orgid, coalesce(s.name, p.name) AS name, coalesce(s.country, p.country) AS country, coalesce(n, 0) AS n_portals
    FROM s FULL JOIN (SELECT orgid, max(university) AS name, max(country) AS country, count(*) AS n FROM all_portals GROUP BY orgid) p ON s.orgid = p.orgid"""
)
def org_profiles(spark: SparkSession, d: str) -> DataFrame:
    s, n = parquet(spark, d, "supplier"), parquet(spark, d, "nation")
    known = s.filter("s_acctbal > 0").join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("orgid"), F.col("s_name").alias("name"), F.col("n_name").alias("country"))
    return catalog.profile(known, all_portals(spark, d))


@R.query(f"WITH {ALL_PORTALS} SELECT orgid, max(university) AS name, max(country) AS country FROM all_portals WHERE orgid NOT IN (SELECT s_suppkey FROM supplier) GROUP BY orgid")
def backfill_anti(spark: SparkSession, d: str) -> DataFrame:
    return catalog.backfill(parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("orgid")), all_portals(spark, d))


@R.query(f"WITH {ALL_PORTALS} SELECT id, orgid IN (SELECT s_suppkey FROM supplier) AS org_verified, id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS url_live FROM all_portals")
def verified_flags(spark: SparkSession, d: str) -> DataFrame:
    """Verification is by id, and exact by url, never by host."""
    p, s, li = all_portals(spark, d), parquet(spark, d, "supplier"), parquet(spark, d, "lineitem")
    vetted = s.select(F.col("s_suppkey").alias("orgid"), F.lit(True).alias("v"))
    live = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct().withColumn("x", F.lit(True))
    return p.join(vetted, "orgid", "left").join(live, "id", "left").select("id", F.coalesce("v", F.lit(False)).alias("org_verified"), F.coalesce("x", F.lit(False)).alias("url_live"))


@R.query(
    f"""WITH {FEEDBACK}, wrong AS (SELECT * FROM feedback WHERE verdict = 'wrong'), r(rule_id, pattern, action) AS (VALUES (1, 'k1d1.example.com', 'flag'), (2, 'k7d3.example.com', 'deny'))
    SELECT f.id, f.orgid, coalesce(s_name, '') AS name, coalesce(r.action, '') AS action FROM wrong f LEFT JOIN supplier ON s_suppkey = f.orgid LEFT JOIN r ON f.host = r.pattern ORDER BY f.id DESC LIMIT 100"""
)
def disputes_covered(spark: SparkSession, d: str) -> DataFrame:
    """The latest disputes with their organisation, and the rule that covers them."""
    rules_ = spark.createDataFrame([(1, "host", "k1d1.example.com", "flag"), (2, "host", "k7d3.example.com", "deny")], "rule_id int, rule_type string, pattern string, action string")
    names = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("orgid"), F.col("s_name").alias("name"))
    last = log(spark, d).filter("verdict = 'wrong'").orderBy(F.col("id").desc()).limit(100).join(names, "orgid", "left")
    return feedback.apply_rules(last, rules_, host="host", url="url", keys=["id"]).select("id", "orgid", F.coalesce("name", F.lit("")).alias("name"), "action")


@R.query(f"WITH {FEEDBACK} SELECT count(*) FILTER (verdict = 'wrong') AS disputes, count(*) FILTER (verdict = 'confirmed') AS confirms, count(DISTINCT orgid) FILTER (verdict = 'wrong') AS orgs, count(DISTINCT host) AS hosts FROM feedback")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.col("verdict") == "wrong"
    return log(spark, d).agg(F.count_if(wrong).alias("disputes"), F.count_if(F.col("verdict") == "confirmed").alias("confirms"), F.countDistinct(F.when(wrong, F.col("orgid"))).alias("orgs"), F.countDistinct("host").alias("hosts"))


MINED = "count(*) FILTER (verdict = 'wrong') AS support, count(DISTINCT orgid) FILTER (verdict = 'wrong') AS orgs, count(*) FILTER (verdict = 'confirmed') AS confirms"


@R.query(f"WITH {FEEDBACK} SELECT host, {MINED} FROM feedback GROUP BY host HAVING support >= 3 AND orgs >= 2 AND confirms = 0")
def mine_host_rules(spark: SparkSession, d: str) -> DataFrame:
    return feedback.mine(log(spark, d), "host", support=3, orgs=2)


@R.query(f"WITH {FEEDBACK} SELECT word AS token, {MINED} FROM feedback GROUP BY word HAVING support >= 2 AND orgs >= 2 AND confirms = 0")
def mine_token_rules(spark: SparkSession, d: str) -> DataFrame:
    return feedback.mine_tokens(log(spark, d), support=2, orgs=2)


@R.query(
    f"""WITH {FEEDBACK} SELECT count(*) FILTER (verdict = 'wrong') AS support, count(DISTINCT orgid) FILTER (verdict = 'wrong') AS orgs, count(*) FILTER (verdict = 'confirmed') AS confirms,
    (SELECT string_agg(url, ' ' ORDER BY id) FROM (SELECT * FROM feedback WHERE verdict = 'wrong' AND host LIKE 'k1%' ORDER BY id LIMIT 5)) AS examples FROM feedback WHERE host LIKE 'k1%'"""
)
def rule_examples(spark: SparkSession, d: str) -> DataFrame:
    return feedback.rule_counts(log(spark, d), F.col("host").startswith("k1"))


@R.query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_lww(spark: SparkSession, d: str) -> DataFrame:
    e = parquet(spark, d, "events")
    return feedback.last_write_wins(e, ["user_id", "event_type"], [F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


@R.query(
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS category FROM events)
    SELECT user_id, count(*) AS hits, coalesce(arg_max(category, event_id) FILTER (category <> ''), '') AS category, max(event_id) AS last_seq FROM e GROUP BY user_id"""
)
def upsert_counter(spark: SparkSession, d: str) -> DataFrame:
    e = parquet(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("category"))
    return feedback.counted(e, ["user_id"], "category", "event_id")


@R.query(
    f"""WITH {FEEDBACK}, new AS (SELECT host AS pattern, count(*) AS support FROM feedback WHERE verdict = 'wrong' GROUP BY host HAVING count(*) >= 3),
    old AS (SELECT DISTINCT host AS pattern, CASE WHEN host LIKE 'k1%' THEN 'active' ELSE 'rejected' END AS status, 'deny' AS action, 1 AS support FROM feedback WHERE host LIKE 'k1%' OR host LIKE 'k2%')
    SELECT coalesce(o.pattern, n.pattern) AS pattern, coalesce(status, 'proposed') AS status, coalesce(action, 'flag') AS action, coalesce(n.support, o.support) AS support FROM old o FULL JOIN new n ON o.pattern = n.pattern"""
)
def upsert_preserve(spark: SparkSession, d: str) -> DataFrame:
    f = log(spark, d)
    new = f.filter("verdict = 'wrong'").groupBy(F.col("host").alias("pattern")).agg(F.count("*").alias("support")).filter("support >= 3")
    old = f.filter("host LIKE 'k1%' OR host LIKE 'k2%'").select(F.col("host").alias("pattern")).distinct()
    old = old.select("pattern", F.when(F.col("pattern").startswith("k1"), "active").otherwise("rejected").alias("status"), F.lit("deny").alias("action"), F.lit(1).cast("long").alias("support"))
    return feedback.refreshed(old, new, ["pattern"], kept={"status": "proposed", "action": "flag"}, counts=["support"])


@R.query(f"WITH {FEEDBACK} SELECT host, count(*) FILTER (verdict = 'confirmed') AS confirms, count(*) FILTER (verdict = 'wrong') AS disputes FROM feedback GROUP BY host HAVING arg_max(verdict, id) = 'confirmed'")
def confirmed_state(spark: SparkSession, d: str) -> DataFrame:
    return feedback.standing(log(spark, d), ["host"], "id")


@R.query(f"WITH {ALL_PORTALS} SELECT orgid, count(*) AS n FROM all_portals WHERE orgid <> 7 GROUP BY orgid")
def purged_org(spark: SparkSession, d: str) -> DataFrame:
    return feedback.without(all_portals(spark, d).withColumn("orgid", F.col("orgid").cast("string")), orgid="7").groupBy(F.col("orgid").cast("long").alias("orgid")).agg(F.count("*").alias("n"))


@R.query(f"WITH {ALL_PORTALS}, f AS (SELECT DISTINCT orgid, portal_url FROM all_portals WHERE status = 'F'), o AS (SELECT DISTINCT orgid, portal_url FROM all_portals WHERE category = '1-URGENT') SELECT orgid, portal_url, 'left' AS side FROM (FROM f EXCEPT FROM o) UNION ALL SELECT orgid, portal_url, 'right' FROM (FROM o EXCEPT FROM f)")
def reconcile_sets(spark: SparkSession, d: str) -> DataFrame:
    p = all_portals(spark, d)
    return cells.differences(p.filter("status = 'F'"), p.filter("category = '1-URGENT'"), ["orgid", "portal_url"])


@R.query(f"WITH {ALL_PORTALS}, hit AS (SELECT DISTINCT orgid, category FROM all_portals WHERE status = 'P') SELECT id, orgid, category FROM all_portals WHERE (orgid, category) IN (SELECT orgid, category FROM hit)")
def activation_block(spark: SparkSession, d: str) -> DataFrame:
    p = all_portals(spark, d)
    return cells.block_of(p, p.filter("status = 'P'"), ["id"], ["orgid", "category"]).select("id", "orgid", "category")


@R.query(
    f"""WITH {ALL_PORTALS}, l AS (SELECT DISTINCT orgid, category AS login FROM all_portals WHERE status = 'F'), t AS (SELECT DISTINCT orgid, category AS terms FROM all_portals WHERE status = 'O' AND category LIKE '1%'),
    pairs AS (SELECT orgid, login, coalesce(terms, '') AS terms FROM l LEFT JOIN t USING (orgid)), have AS (SELECT DISTINCT orgid, category AS login, category AS terms FROM all_portals)
    SELECT p.* FROM pairs p LEFT JOIN have h ON p.orgid = h.orgid AND p.login = h.login AND p.terms = h.terms WHERE h.orgid IS NULL"""
)
def cross_product_missing(spark: SparkSession, d: str) -> DataFrame:
    p = all_portals(spark, d)
    logins = p.filter("status = 'F'").select("orgid", F.col("category").alias("login"))
    terms = p.filter("status = 'O' AND category LIKE '1%'").select("orgid", F.col("category").alias("terms"))
    have = p.select("orgid", F.col("category").alias("login"), F.col("category").alias("terms"))
    return cells.missing_pairs(logins, terms, have, "orgid", "login", "terms")


@R.query(f"WITH {ALL_PORTALS} SELECT orgid, university AS name, string_agg(portal_url, chr(10) ORDER BY category, portal_url) AS portal_cell, count(*) AS n FROM all_portals GROUP BY ALL")
def sheet_row(spark: SparkSession, d: str) -> DataFrame:
    return catalog.portal_cells(all_portals(spark, d), "orgid", "university").select("orgid", F.col("university").alias("name"), F.col("portals").alias("portal_cell"), F.col("n_portals").alias("n"))


@R.query(f"WITH {ALL_PORTALS}, c AS (SELECT orgid, portal_url FROM all_portals) SELECT orgid, portal_url AS url FROM c")
def cell_explode(spark: SparkSession, d: str) -> DataFrame:
    """Cells of many urls taken apart again."""
    listed = catalog.with_portal_list(all_portals(spark, d).select("orgid").distinct(), all_portals(spark, d))
    return cells.exploded(listed, "portals", "url").select("orgid", "url")


@R.query("SELECT DISTINCT p_partkey, v FROM (SELECT p_partkey, unnest([p_brand, p_type, p_name]) AS v FROM part) WHERE v LIKE '%1%'")
def unpivot_distinct(spark: SparkSession, d: str) -> DataFrame:
    return cells.unpivoted(parquet(spark, d, "part"), ["p_partkey"], ["p_brand", "p_type", "p_name"], "v", F.col("v").contains("1"))


@R.query(
    f"""WITH {ALL_PORTALS}, s AS (SELECT o.orgid, o.country, o.state, category, count(p.id) AS n, count(*) FILTER (status = 'F') AS f FROM orgs o LEFT JOIN all_portals p ON p.orgid = o.orgid GROUP BY ALL),
    c AS (SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(state) = 0 THEN 'state' WHEN grouping(country) = 0 THEN 'country' ELSE 'total' END AS level, country, state, category,
      count(DISTINCT orgid) AS n_orgs, sum(n)::BIGINT AS n_portals, count(DISTINCT orgid) FILTER (n > 0) AS n_covered, sum(f)::BIGINT AS n_final FROM s GROUP BY GROUPING SETS ((), (country), (country, state), (category)))
    SELECT *, round(100.0 * n_covered / n_orgs, 1) AS coverage_pct FROM c WHERE level <> 'category' OR category IS NOT NULL"""
)
def insights_levels(spark: SparkSession, d: str) -> DataFrame:
    """Totals, countries, states and categories from one scan of a summary, to which the last portals were added."""
    o, p = orgs(spark, d), all_portals(spark, d).select("orgid", "category", "status", "id")
    late = F.col("id") % 10 == 0
    return insights.insights(insights.merged(insights.summary(o, p.filter(~late)), insights.summary(o, p.filter(late))))


@R.query(f"WITH {ALL_PORTALS}, p AS (SELECT category, id, orgid, count(*) OVER () AS total, row_number() OVER (ORDER BY category, id) - 1 AS nth FROM all_portals) SELECT category, id, orgid FROM p WHERE nth >= total * 3 // 4 AND nth < total * 3 // 4 + 50")
def page_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Fifty portals at three quarters of the catalogue, read from the ranges that hold them."""
    at = scratch(spark, "paged")
    paging.write(all_portals(spark, d).select("category", "id", "orgid"), at, ["category", "id"], ranges=40)
    found = paging.Pages(spark, at, ["category", "id"])
    return found.page(found.total() * 3 // 4, 50)
