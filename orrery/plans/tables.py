"""Queries over changes to tables, exports, and small enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import rules, text, urls
from orrery.operators import dedup, evaluation, parts, regions, updates
from orrery.plans.roles import ALL_PORTALS, CANDIDATES, Registry, all_portals, candidates, pages
from orrery.sources import tables
from orrery.sources.tables import parquet, scratch

R = Registry()


@R.query(f"WITH {ALL_PORTALS} SELECT id::VARCHAR AS id, orgid::VARCHAR AS orgid, portal_url, '' AS note FROM all_portals")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A sheet written with a fixed order of columns, missing cells empty, and read back as strings."""
    at = tables.scratch(spark, "sheet")
    tables.write_sheet(all_portals(spark, d).withColumn("note", F.lit(None).cast("string")), at, ["id", "orgid", "portal_url", "note"])
    return tables.sheet(spark, at)


@R.query("SELECT 'SEG ' || c_mktsegment AS name, NULL::VARCHAR AS city, c_name AS orgid FROM customer")
def conformed(spark: SparkSession, d: str) -> DataFrame:
    """A table of other columns brought to a catalogue's schema."""
    c = parquet(spark, d, "customer")
    raw = c.select(F.col("c_name").alias("orgid"), F.concat(F.lit("SEG "), F.col("c_mktsegment")).alias("name"), F.lit(1).alias("extra"))
    return tables.conform(raw, tables.SCHEMAS["universities"]).select("name", "city", "orgid")


@R.query("SELECT o_orderkey, CASE WHEN s_name IS NOT NULL AND s_acctbal > 0 THEN s_name ELSE o_orderpriority END AS category FROM orders LEFT JOIN supplier ON o_orderkey = s_suppkey")
def keyed_update(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"))
    changes = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("o_orderkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("category"))
    return updates.updated(o, changes, ["o_orderkey"], ["category"])


@R.query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'deny' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey NOT IN (SELECT s_suppkey FROM supplier)")
def set_and_delete(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    o = updates.set_where(o, F.col("o_orderkey") % 100 == 0, status=F.lit("deny"))
    return updates.removed(o, parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("o_orderkey")), ["o_orderkey"])


@R.query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@R.query(f"WITH {ALL_PORTALS} SELECT DISTINCT category FROM all_portals WHERE coalesce(category, '') <> '' ORDER BY category")
def categories(spark: SparkSession, d: str) -> DataFrame:
    return all_portals(spark, d).filter(F.coalesce("category", F.lit("")) != "").select("category").distinct().orderBy("category")


@R.query(
    f"""WITH {ALL_PORTALS}, o AS (SELECT orgid, id, coalesce(nullif(list_position(['5-LOW', '1-URGENT', '2-HIGH'], category), 0), 4)::INTEGER AS nth FROM all_portals)
    SELECT orgid, string_agg(id, ' ' ORDER BY nth, id) AS ids FROM o GROUP BY orgid"""
)
def remapped_order(spark: SparkSession, d: str) -> DataFrame:
    """Portals of an organisation in the order of a list of categories, unknown ones last."""
    nth = F.coalesce(F.nullif(F.array_position(F.lit(["5-LOW", "1-URGENT", "2-HIGH"]), F.col("category")), F.lit(0)), F.lit(4))
    lists = all_portals(spark, d).groupBy("orgid").agg(F.array_sort(F.collect_list(F.struct(nth.alias("nth"), "id"))).alias("x"))
    return lists.select("orgid", F.array_join(F.transform("x", lambda p: p["id"].cast("string")), " ").alias("ids"))


@R.query(
    f"""WITH {ALL_PORTALS}, t AS (SELECT DISTINCT orgid, category, min(id) OVER (PARTITION BY orgid, category) AS id FROM all_portals WHERE category <> '4-NOT SPECIFIED')
    SELECT orgid, nth::INTEGER AS nth, category, id FROM (SELECT *, row_number() OVER (PARTITION BY orgid ORDER BY list_position(['2-HIGH', '1-URGENT', '5-LOW', '3-MEDIUM'], category)) AS nth FROM t) WHERE nth <= 3"""
)
def best_three_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Per organisation one document of a kind, the three first kinds of a list."""
    kinds = ["2-HIGH", "1-URGENT", "5-LOW", "3-MEDIUM"]
    p = all_portals(spark, d).filter(F.col("category").isin(kinds))
    one = dedup.top(p, ["orgid", "category"], [F.col("id")])
    return dedup.top(one, ["orgid"], [F.array_position(F.lit(kinds), F.col("category"))], 3, "nth").select("orgid", "nth", "category", "id")


@R.query(
    f"""WITH {ALL_PORTALS}, old AS (SELECT id, category AS old, CASE WHEN status = 'F' THEN '5-LOW' WHEN category LIKE '4%' THEN '3-MEDIUM' ELSE category END AS new FROM all_portals)
    SELECT old, new, count(*) AS n FROM old WHERE old <> new GROUP BY ALL"""
)
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    new = rules.first_of([(F.col("status") == "F", "5-LOW"), (F.col("category").startswith("4"), "3-MEDIUM")])
    p = all_portals(spark, d).select(F.col("category").alias("old"), F.coalesce(new, F.col("category")).alias("new"))
    return evaluation.transitions(p, "old", "new")


@R.query("SELECT DISTINCT 'https://' || l || '.' || lower(n_name) || '.edu/' AS url FROM nation, (VALUES ('portal'), ('lms'), ('student')) v(l)")
def probe_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses to try: each label before each domain. The labels travel as an array, so nothing is joined."""
    domains = parquet(spark, d, "nation").select(F.concat(F.lower("n_name"), F.lit(".edu")).alias("domain"))
    return domains.select(F.explode(F.lit(["portal", "lms", "student"])).alias("label"), "domain").select(F.concat(F.lit("https://"), "label", F.lit("."), "domain", F.lit("/")).alias("url")).distinct()


@R.query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 3 = 0 THEN 'b' || page_id WHEN page_id % 2 = 0 THEN 'c' END AS found, CASE WHEN page_id % 4 = 0 THEN 1 WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 2 = 0 THEN 3 ELSE 0 END AS found_step FROM pages")
def retry_chain(spark: SparkSession, d: str) -> DataFrame:
    """The first of three retries that gives something."""
    i = F.col("page_id")
    steps = [F.when(i % 4 == 0, F.col("url")), F.when(i % 3 == 0, F.concat(F.lit("b"), i)), F.when(i % 2 == 0, F.lit("c"))]
    return updates.chained(pages(spark, d), steps, "found").select("page_id", "found", "found_step")


@R.query(
    """WITH own AS (SELECT c_nationkey AS org, c_mktsegment AS portal FROM customer), up AS (SELECT DISTINCT org, n_regionkey AS parent FROM own JOIN nation ON org = n_nationkey),
    x AS (SELECT org, portal, 'own' AS via FROM own UNION ALL SELECT up.org, o.portal, 'parent' FROM up JOIN own o ON o.org = up.parent) SELECT org, portal, min(via) AS via FROM x GROUP BY ALL"""
)
def parent_portals(spark: SparkSession, d: str) -> DataFrame:
    """Portals of an organisation and of its parent, one hop only."""
    c, n = parquet(spark, d, "customer"), parquet(spark, d, "nation")
    own = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_nationkey").alias("org"), F.col("c_mktsegment").alias("portal"), F.col("n_regionkey").alias("parent"))
    return updates.one_hop(own, own, key="org", parent="parent", value="portal")


@R.query("SELECT event_id, CASE WHEN value > 90 THEN 'conflict' WHEN event_type = 'error' AND length(props) > 8 THEN 'long' WHEN event_type = 'click' THEN 'maybe' ELSE '' END AS reason FROM events")
def escalation_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first reason for a second opinion."""
    reason = rules.first_of([(F.col("value") > 90, "conflict"), ((F.col("event_type") == "error") & (F.length("props") > 8), "long"), (F.col("event_type") == "click", "maybe")], "")
    return parquet(spark, d, "events").select("event_id", reason.alias("reason"))


@R.query("SELECT doc_id, md5(encode(coalesce(text, ''))[1:200]) AS print, count(*) OVER (PARTITION BY md5(encode(coalesce(text, ''))[1:200])) AS n FROM documents")
def doc_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """MD5 of the first 200 bytes of each document, and how many documents share it."""
    docs = parquet(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("print"))
    return docs.join(docs.groupBy("print").agg(F.count("*").alias("n")), "print").select("doc_id", "print", "n")


PARTED = """seen AS (SELECT id, orgid, category, status, portal_url, 1::BIGINT AS hits FROM all_portals),
batch AS (SELECT l_orderkey AS id, min(l_linestatus) AS category, count(*) AS hits, bool_or(l_returnflag = 'R') AS gone FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' GROUP BY l_orderkey)"""


@R.query(
    f"""WITH {ALL_PORTALS}, {PARTED} SELECT s.id, orgid, coalesce(b.category, s.category) AS category, status, portal_url, s.hits + coalesce(b.hits, 0) AS hits
    FROM seen s LEFT JOIN batch b ON s.id = b.id WHERE NOT coalesce(gone, false) UNION ALL SELECT -id, NULL, category, NULL, NULL, hits FROM batch WHERE NOT gone AND id % 8 = 1"""
)
def parted_upserts(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue in parts after an upsert of late orders: a new category, counted hits, returned ones deleted, others added."""
    seen = all_portals(spark, d).select("id", "orgid", "category", "status", "portal_url", F.lit(1).cast("long").alias("hits"))
    table = parts.PartedTable(spark, scratch(spark, "parted"), ["id"], parts=32)
    table.create(seen)
    late = parquet(spark, d, "lineitem").filter("l_shipdate >= DATE '1998-06-01'").groupBy(F.col("l_orderkey").alias("id"))
    late = late.agg(F.min("l_linestatus").alias("category"), F.count("*").alias("hits"), F.bool_or(F.col("l_returnflag") == "R").alias("gone"))
    batch = late.unionByName(late.filter("NOT gone AND id % 8 = 1").withColumn("id", -F.col("id")))
    batch = batch.withColumns({c: F.lit(None).cast(seen.schema[c].dataType) for c in ("orgid", "status", "portal_url")})
    kept = {c: lambda old, new: F.coalesce(new, old) for c in ("orgid", "status", "portal_url")}
    table.upsert(batch, merged=kept | {"hits": lambda old, new: old + new}, delete=F.col("gone"))
    return table.read()


_PROBES = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in regions.ARGENTINA.probes) + ") v(label, category, path)"
REGIONAL = """h AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS host FROM pages),
o AS (SELECT page_id, [replace(host, '.example.net', '.edu.ar'), host] AS domains, CASE WHEN ends_with(host, '.org') AND contains(host, 'blog') THEN 'Argentina' END AS country FROM h),
r AS (SELECT *, CASE WHEN len(list_filter(domains, lambda d: ends_with(d, '.ar'))) > 0 OR country = 'Argentina' THEN 'argentina' END AS region FROM o)"""


def _regional(spark: SparkSession, d: str) -> DataFrame:
    host = urls.host(F.col("url"))
    o = pages(spark, d).select("page_id", F.array(F.replace(host, F.lit(".example.net"), F.lit(".edu.ar")), host).alias("domains"), F.when(host.endswith(".org") & host.contains("blog"), "Argentina").alias("country"))
    return o.withColumn("region", regions.region(F.col("domains"), F.col("country")))


@R.query(f"WITH {REGIONAL} SELECT page_id, region FROM r")
def page_regions(spark: SparkSession, d: str) -> DataFrame:
    """The region pack that holds for each page's organisation; domains of one suffix stand for a country's."""
    return _regional(spark, d).select("page_id", "region")


@R.query(f"WITH {REGIONAL}, d AS (SELECT page_id, unnest(list_distinct(domains)) AS d FROM r WHERE region IS NOT NULL) SELECT page_id, 'https://' || label || '.' || d || path AS url, category, 'argentina region probe: ' || label || '.' || d AS reason FROM d, {_PROBES}")
def region_probes(spark: SparkSession, d: str) -> DataFrame:
    """The addresses that each organisation's pack tries."""
    return regions.probes(_regional(spark, d), org="page_id", domains="domains", region="region")


@R.query(
    rf"""WITH {CANDIDATES}, u AS (SELECT page_id, host, CASE WHEN page_id % 2 = 0 THEN replace(lower(path), '/student/login', '/acceso/login') ELSE lower(path) END AS p FROM candidates)
    SELECT page_id, CASE WHEN contains(p, '/acceso/login') THEN 'SIU-Guaraní' WHEN contains(p, '/login/index.php') AND list_has_any(string_split(host, '.'), ['campus', 'campusvirtual', 'aulavirtual', 'aula', 'virtual', 'moodle', 'eduvirtual']) THEN 'Moodle' END AS platform FROM u"""
)
def region_logins(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are a regional platform's login; half of those for students are at another path."""
    moved = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/student/login"), F.lit("/acceso/login"))).otherwise(F.col("url"))
    return candidates(spark, d).select("page_id", regions.login_surface(moved)["platform"].alias("platform"))
