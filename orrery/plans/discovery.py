"""Queries over candidates: matching, choice and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import rules, urls
from orrery.operators import dedup, discovery
from orrery.plans.roles import ALL_PORTALS, ORGS, PAGE_PARTS, Registry, all_portals, orgs, pages
from orrery.sources.tables import parquet

R = Registry()


@R.query(f"WITH {ORGS} SELECT orgid, country AS rule FROM orgs WHERE country IN (SELECT n_name FROM nation WHERE n_regionkey < 3) AND contains(name, '1') AND NOT contains(name, '7')")
def affiliation_tables(spark: SparkSession, d: str) -> DataFrame:
    places = parquet(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_name").alias("rule"), F.translate(F.lower("n_name"), "_", " ").alias("alias"), F.array(F.lit("1")).alias("need"), F.array(F.lit("7")).alias("bar"))
    return discovery.matched_by_place(orgs(spark, d), places, place="country", name="name", keys=["orgid"])


@R.query(
    f"""WITH {PAGE_PARTS}, p AS (SELECT split_part(host, '.', 1) AS label, root, page_id FROM hosts WHERE root <> 'example.com'), n AS (SELECT label, root, count(*) AS n, min(page_id) AS pos FROM p GROUP BY ALL),
    s AS (SELECT label, arg_max(root, struct_pack(a := ends_with(root, '.org'), n := n, p := -pos)) AS seen FROM n GROUP BY label), all_labels AS (SELECT DISTINCT split_part(host, '.', 1) AS label FROM hosts)
    SELECT label, CASE WHEN label = 'blog' THEN 'own.edu' ELSE coalesce(seen, '') END AS domain FROM all_labels LEFT JOIN s USING (label)"""
)
def main_domains(spark: SparkSession, d: str) -> DataFrame:
    df = pages(spark, d).select(F.substring_index(urls.host(F.col("url")), ".", 1).alias("label"), "url", "page_id")
    own = spark.createDataFrame([("blog", "own.edu"), ("m", "example.com")], "label string, domain string")
    return discovery.main_domain(df, key="label", url="url", pos="page_id", configured=own, shared=["example.com"], academic=[".org"])


@R.query(
    f"""WITH {PAGE_PARTS}, x AS (SELECT *, split_part(path, '/', 2) AS seg, page_id % 7 AS conf FROM hosts),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, seg ORDER BY conf DESC, page_id) AS n FROM x) WHERE n = 1)
    SELECT page_id, host FROM (SELECT *, row_number() OVER (PARTITION BY root, seg ORDER BY len(host), page_id) AS m FROM a) WHERE m = 1"""
)
def one_per_system(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    df = pages(spark, d).select("page_id", urls.host(u).alias("host"), urls.registrable(urls.host(u)).alias("root"), F.split_part(urls.path(u), F.lit("/"), F.lit(2)).alias("seg"), (F.col("page_id") % 7).alias("conf"))
    return discovery.one_per_system(df, host="host", segment="seg", root="root", path="seg", confidence="conf", pos="page_id").select("page_id", "host")


@R.query("SELECT o_orderkey, first_row, o_orderkey > first_row AS repeat FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first_row FROM orders)")
def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    return discovery.repeats(parquet(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_orderkey", "first_row", "repeat")


@R.query(
    """WITH m AS (SELECT *, o_orderstatus = 'F' AND o_totalprice > 100000 AS ok, bool_or(o_orderstatus = 'F' AND o_totalprice > 100000) OVER w AS alive, min(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey))
    SELECT o_custkey, o_orderkey, CASE WHEN ok THEN 'ok' ELSE 'N/A' END AS state FROM m WHERE ok OR (NOT alive AND o_orderkey = first)"""
)
def pruned_rows(spark: SparkSession, d: str) -> DataFrame:
    working = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return discovery.collapsed(parquet(spark, d, "orders"), "o_custkey", working, "o_orderkey").select("o_custkey", "o_orderkey", "state")


@R.query("WITH g AS (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS reviewed, bool_or(o_orderpriority = '1-URGENT') AS real, min(o_orderkey) AS pos FROM orders GROUP BY o_custkey) SELECT o_custkey, pos FROM g WHERE NOT reviewed AND real ORDER BY pos LIMIT 25")
def unreviewed_orgs(spark: SparkSession, d: str) -> DataFrame:
    """The first organisations that have a real portal and no reviewed row."""
    g = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("reviewed"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("real"), F.min("o_orderkey").alias("pos"))
    return g.filter("NOT reviewed AND real").orderBy("pos").limit(25).select("o_custkey", "pos")


@R.query("SELECT page_id, CASE WHEN contains(h, 'thth') THEN 'Thth' WHEN contains(h, 'blog.') THEN 'Blog' ELSE 'Www' END AS vendor FROM (SELECT page_id, lower(url) AS h FROM pages) WHERE contains(h, 'thth') OR contains(h, 'blog.') OR contains(h, 'www.')")
def vendor_detect(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("Blog", 2, ["blog."]), ("Thth", 1, ["thth", "none"]), ("Www", 3, ["www."])], "vendor string, rank int, words array<string>")
    return discovery.vendors(pages(spark, d), known, keys=["page_id"], text=F.col("url"))


@R.query(
    f"""WITH {ALL_PORTALS}, t AS (SELECT orgid, portal_url, id, CASE WHEN id % 4 < 2 THEN 4 WHEN id % 4 = 2 THEN 2 ELSE 1 END AS authority FROM all_portals)
    SELECT orgid, portal_url, authority FROM (SELECT *, row_number() OVER (PARTITION BY orgid ORDER BY authority DESC, id) AS n FROM t) WHERE n = 1"""
)
def best_authority(spark: SparkSession, d: str) -> DataFrame:
    """Per organisation the finding of most authority; of equals the one found first."""
    authority = F.when(F.col("id") % 4 < 2, 4).when(F.col("id") % 4 == 2, 2).otherwise(1)
    return dedup.top(all_portals(spark, d).withColumn("authority", authority), ["orgid"], [F.col("authority").desc(), F.col("id")]).select("orgid", "portal_url", "authority")


@R.query("SELECT n_nationkey, CASE WHEN n_name LIKE '%NEG%' THEN 'none' WHEN n_name LIKE '%A' THEN 'phrase' WHEN n_name LIKE '%IN%' THEN 'city' ELSE 'none' END AS region FROM nation")
def region_names(spark: SparkSession, d: str) -> DataFrame:
    """A name's region: negative words first, then phrases, then cities."""
    name = F.col("n_name")
    region = rules.first_of([(rules.contains_any(name, ["NEG"]), "none"), (name.endswith("A"), "phrase"), (rules.contains_any(name, ["IN"]), "city")], "none")
    return parquet(spark, d, "nation").select("n_nationkey", region.alias("region"))


ERRORS_SQL = "CASE WHEN n_a = 0 THEN 'missed' WHEN shared = n_t AND shared = n_a THEN 'exact' WHEN shared > 0 AND n_a > shared THEN 'extra' WHEN shared > 0 THEN 'partial' ELSE 'wrong' END"


@R.query(
    f"""WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS agent, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS truth FROM orders GROUP BY o_custkey),
    n AS (SELECT k, coalesce(len(agent), 0) AS n_a, len(truth) AS n_t, coalesce(len(list_intersect(agent, truth)), 0) AS shared FROM a WHERE truth IS NOT NULL) SELECT {ERRORS_SQL} AS error, count(*) AS n FROM n GROUP BY 1"""
)
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    """How the found values relate to the true ones, per organisation."""
    o = parquet(spark, d, "orders")
    sets = o.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("agent"), F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("truth")).filter(F.size("truth") > 0)
    both, n_a, n_t = F.size(F.array_intersect("agent", "truth")), F.size("agent"), F.size("truth")
    error = rules.first_of([(n_a == 0, "missed"), ((both == n_t) & (both == n_a), "exact"), ((both > 0) & (n_a > both), "extra"), (both > 0, "partial")], "wrong")
    return sets.groupBy(error.alias("error")).agg(F.count("*").alias("n"))


@R.query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS bucket FROM orders ORDER BY bucket, o_orderkey")
def bucket_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows in buckets, and in their old order within one."""
    bucket = rules.first_of([(F.col("o_orderpriority").startswith("1"), "0"), (F.col("o_orderstatus") == "P", "1")], "2").cast("int")
    return parquet(spark, d, "orders").select("o_orderkey", bucket.alias("bucket")).orderBy("bucket", "o_orderkey")


@R.query("WITH c AS (SELECT l_orderkey, list(DISTINCT l_shipdate::DATE::VARCHAR) AS days FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey FROM c WHERE list_has_any(days, ['1995-01-01', '1996-02-02', '1997-03-03', '1995-06-17', '1996-12-12', '1994-07-07'])")
def any_cell_matches(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which any of several cells is in a list."""
    days = F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd"))
    cells = parquet(spark, d, "lineitem").groupBy("l_orderkey").agg(days.alias("days"))
    return cells.filter(F.arrays_overlap("days", F.lit(["1995-01-01", "1996-02-02", "1997-03-03", "1995-06-17", "1996-12-12", "1994-07-07"]))).select("l_orderkey")
