"""Queries over pages: canonical URLs, rules for hosts, deduplication, links and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import rules, text, urls
from orrery.operators import dedup, discovery, feedback, links, suffix
from orrery.plans.roles import PAGE_PARTS, Registry, pages
from orrery.sources.tables import parquet

R = Registry()


@R.query(f"WITH {PAGE_PARTS} SELECT page_id, canonical FROM canon")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@R.query(f"WITH {PAGE_PARTS} SELECT page_id, host, root, len(string_split(host, '.'))::BIGINT AS n_labels FROM hosts")
def host_registrable(spark: SparkSession, d: str) -> DataFrame:
    h = urls.host(F.col("url"))
    return pages(spark, d).select("page_id", h.alias("host"), urls.registrable(h).alias("root"), F.size(F.split(h, r"\.")).cast("long").alias("n_labels"))


@R.query(
    f"""WITH {PAGE_PARTS} SELECT page_id, regexp_replace(regexp_replace(rtrim(lower(trim(url)), '/'), '^https?://', ''), '^[w.]+', '') AS match_key,
    host || rtrim(path, '/') AS portal_key, scheme || '://' || authority AS base_host, dedup_key FROM canon"""
)
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, d).select("page_id", urls.match_key(u).alias("match_key"), urls.portal_key(u).alias("portal_key"), urls.base_host(u).alias("base_host"), urls.dedup_key(u).alias("dedup_key"))


@R.query(
    f"""WITH {PAGE_PARTS}, t AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(lower(path || ' ' || query), '[a-z]{{3,}}'))) AS token FROM parts)
    SELECT token, count(*) AS n FROM t WHERE token NOT IN ('html', 'page', 'com', 'org', 'net', 'www') GROUP BY token"""
)
def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select(F.explode(urls.path_tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@R.query(
    f"""WITH {PAGE_PARTS}, p AS (SELECT page_id, scheme || '://' || authority AS base, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM parts)
    SELECT page_id, unnest(range(1, len(seg)))::BIGINT AS up, base || '/' || seg[1] || '/' AS parent FROM p WHERE len(seg) = 2"""
)
def path_parents(spark: SparkSession, d: str) -> DataFrame:
    found = pages(spark, d).select("page_id", F.posexplode(urls.path_parents(F.col("url"))).alias("up", "parent"))
    return found.withColumn("up", F.col("up").cast("long") + 1)


@R.query(
    f"""WITH {PAGE_PARTS}, h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM parts)
    SELECT host, array_to_string(l[i + 1:], '.') AS parent FROM h, range(1, 8) r(i) WHERE i + 1 <= len(l) - 1"""
)
def parent_hosts(spark: SparkSession, d: str) -> DataFrame:
    hosts = pages(spark, d).select(urls.host(F.col("url")).alias("host")).distinct()
    return hosts.select("host", F.explode(urls.parent_hosts(F.col("host"))).alias("parent"))


SPAM = ["cheap-pills", "spam-farm"]


@R.query(f"WITH {PAGE_PARTS} SELECT page_id, host FROM parts WHERE NOT regexp_matches(host, '(^|\\.)(cheap-pills|spam-farm)\\.example\\.(com|net|org)$')")
def suffix_block(spark: SparkSession, d: str) -> DataFrame:
    blocked = spark.createDataFrame([(f"{s}.example.{t}",) for s in SPAM for t in ("com", "net", "org")], "root string")
    df = pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"))
    return suffix.not_under(df, blocked, "host", "root").select("page_id", "host")


@R.query(
    f"""WITH {PAGE_PARTS} SELECT page_id, root, CASE WHEN host <> root THEN left(host, len(host) - len(root) - 1) END AS tenant FROM hosts WHERE root IN ('example.com', 'example.org')"""
)
def tenant_prefix(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("example.com", 1), ("example.org", 2)], "root string, nth int")
    df = pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"))
    return suffix.tenant(suffix.first_match(df, roots, "host", "root", "nth", ["page_id"]), "host", "root", "tenant").select("page_id", "root", "tenant")


@R.query(f"WITH {PAGE_PARTS} SELECT page_id, dedup_key FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY page_id) AS n FROM canon) WHERE n = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    df = pages(spark, d).select("page_id", urls.dedup_key(F.col("url")).alias("dedup_key"))
    return dedup.top(df, ["dedup_key"], [F.col("page_id")])


SCORE_SQL = f"""{PAGE_PARTS}, scored AS (SELECT *, (CASE WHEN scheme = 'https' THEN 3 ELSE 0 END) + (CASE WHEN starts_with(path, '/en/') THEN 2 ELSE 0 END)
  + (CASE WHEN regexp_matches(host, '^(blog|m)\\.') THEN 0 ELSE 1 END) - (CASE WHEN contains(path, '.html') THEN 2 ELSE 0 END) AS score, split_part(host, '.', 1) AS label FROM canon)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    u, h = F.col("url"), urls.host(F.col("url"))
    score = rules.points([(urls.scheme(u) == "https", 3), (urls.path(u).startswith("/en/"), 2), (~rules.has_label(F.substring_index(h, ".", 1), ["blog", "m"]), 1), (urls.path(u).contains(".html"), -2)])
    return pages(spark, d).select("page_id", h.alias("host"), urls.registrable(h).alias("root"), F.substring_index(h, ".", 1).alias("label"), urls.path(u).alias("path"), urls.canonical(u).alias("canonical"), score.alias("score"))


@R.query(f"WITH {SCORE_SQL} SELECT page_id, host, score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, len(path), page_id DESC) AS n FROM scored) WHERE n = 1")
def dedup_best(spark: SparkSession, d: str) -> DataFrame:
    """Per host the best score, then the shorter path, then the later page."""
    best = dedup.top(_scored(spark, d), ["host"], [F.col("score").desc(), F.length("path"), F.col("page_id").desc()])
    return best.select("page_id", "host", "score")


@R.query(
    f"""WITH {SCORE_SQL}, ok AS (SELECT * FROM scored WHERE NOT regexp_matches(host, '(^|\\.)(cheap-pills|spam-farm)\\.example\\.(com|net|org)$'))
    SELECT root, label, page_id, canonical, score FROM (SELECT *, row_number() OVER (PARTITION BY root, label ORDER BY score DESC, len(path), page_id) AS n FROM ok) WHERE n = 1"""
)
def url_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """Canonical, unblocked pages: the best per registrable domain and first host label."""
    blocked = spark.createDataFrame([(f"{s}.example.{t}",) for s in SPAM for t in ("com", "net", "org")], "blocked string")
    ok = suffix.not_under(_scored(spark, d), blocked, "host", "blocked")
    return dedup.top(ok, ["root", "label"], [F.col("score").desc(), F.length("path"), F.col("page_id")]).select("root", "label", "page_id", "canonical", "score")


@R.query(f"WITH {SCORE_SQL} SELECT root, nth::INTEGER AS nth, page_id FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY label NOT IN ('www', 'm'), len(url), page_id) AS nth FROM scored) WHERE nth <= 5")
def capped_per_root(spark: SparkSession, d: str) -> DataFrame:
    """The first five pages of a domain: hinted labels first, then shorter urls."""
    df = pages(spark, d).withColumn("host", urls.host(F.col("url")))
    df = df.withColumns({"root": urls.registrable(F.col("host")), "hint": ~F.substring_index("host", ".", 1).isin("www", "m")})
    return dedup.top(df, ["root"], [F.col("hint"), F.length("url"), F.col("page_id")], 5, "nth").select("root", "nth", "page_id")


@R.query(
    f"""WITH {PAGE_PARTS}, f AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY page_id) AS n FROM canon)
    SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN regexp_matches(host, '(^|\\.)(cheap-pills|spam-farm)\\.') THEN 'blocked' WHEN ends_with(path, '.html') THEN 'extension'
    WHEN split_part(host, '.', 1) = 'm' THEN 'label' WHEN root = 'example.org' THEN 'foreign' ELSE 'kept' END AS reason, count(*) AS n_pages FROM f GROUP BY 1"""
)
def prefilter_reason(spark: SparkSession, d: str) -> DataFrame:
    """The first reason to reject a candidate. Duplicates are marked before the other rules, as a key counts as seen then."""
    h = urls.host(F.col("url"))
    df = pages(spark, d).select("page_id", h.alias("host"), urls.path(F.col("url")).alias("path"), urls.dedup_key(F.col("url")).alias("key"))
    firsts = df.groupBy("key").agg(F.min("page_id").alias("first"))
    df = df.join(firsts, "key")
    reason = rules.first_of([
        (F.col("page_id") > F.col("first"), "duplicate"), (rules.has_label(F.col("host"), SPAM), "blocked"), (F.col("path").endswith(".html"), "extension"),
        (F.substring_index("host", ".", 1) == "m", "label"), (urls.registrable(F.col("host")) == "example.org", "foreign"),
    ], "kept")
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_pages"))


@R.query(
    f"""WITH {PAGE_PARTS}, rules(rule_id, rule_type, pattern, action) AS (VALUES (1, 'host', 'example.org', 'flag'), (2, 'pattern', 'utm', 'flag'), (3, 'host', 'cheap-pills.example.com', 'deny'), (4, 'pattern', 'feed', 'deny')),
    hits AS (SELECT p.page_id, r.*, row_number() OVER (PARTITION BY p.page_id ORDER BY r.action <> 'deny', r.rule_id) AS n FROM parts p JOIN rules r ON
      (r.rule_type = 'host' AND (p.host = r.pattern OR ends_with(p.host, '.' || r.pattern))) OR (r.rule_type = 'pattern' AND list_contains(regexp_extract_all(lower(p.path || ' ' || p.query), '[a-z]{{3,}}'), r.pattern)))
    SELECT p.page_id, coalesce(h.action, '') AS action, coalesce(h.pattern, '') AS pattern FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND h.n = 1"""
)
def rules_applied(spark: SparkSession, d: str) -> DataFrame:
    active = spark.createDataFrame([(1, "host", "example.org", "flag"), (2, "pattern", "utm", "flag"), (3, "host", "cheap-pills.example.com", "deny"), (4, "pattern", "feed", "deny")], "rule_id int, rule_type string, pattern string, action string")
    df = pages(spark, d).withColumn("host", urls.host(F.col("url")))
    return feedback.apply_rules(df, active, host="host", url="url", keys=["page_id"]).select("page_id", "action", "pattern")


@R.query(
    r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
    md5(encode(coalesce(html, ''))[1:200]) AS fingerprint, len(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["''][^"'']*["''][^>]*>.*?</a>'))::BIGINT AS n_links FROM pages"""
)
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    """Title, fingerprint of the first 200 bytes, and number of links of each page."""
    p = pages(spark, d)
    return p.select("page_id", text.title(F.col("html")).alias("title"), text.fingerprint(F.col("html")).alias("fingerprint"), F.size(text.anchors(F.col("html"))).cast("long").alias("n_links"))


@R.query(
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS x FROM pages)
    SELECT page_id, md5(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS text_md5, length(trim(regexp_replace(x, '\s+', ' ', 'g')))::BIGINT AS n_chars FROM t"""
)
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    t = text.visible_text(F.col("html"))
    return pages(spark, d).select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n_chars"))


LINKS_SQL = (
    PAGE_PARTS
    + r""", raw AS (SELECT page_id, url, scheme, authority, path, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href,
    unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)))) AS pos FROM parts),
  linked AS (SELECT page_id, url AS base, pos, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href
    WHEN starts_with(href, '/') THEN scheme || '://' || authority || href
    ELSE scheme || '://' || authority || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS target, regexp_replace(authority, '^www\.', '') AS own FROM raw),
  links AS (SELECT *, regexp_replace(regexp_extract(target, '^[A-Za-z]+://([^/?#]*)', 1), '^www\.', '') AS target_host FROM linked)"""
)


@R.query(f"WITH {LINKS_SQL} SELECT page_id, count(*) AS n, count(DISTINCT target) AS n_targets, count(DISTINCT target_host) AS n_hosts FROM links GROUP BY page_id")
def links_per_page(spark: SparkSession, d: str) -> DataFrame:
    return links.page_links(pages(spark, d)).groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("target").alias("n_targets"), F.countDistinct("target_host").alias("n_hosts"))


@R.query(f"WITH {LINKS_SQL} SELECT page_id, coalesce(bool_or(target_host = own), FALSE) AS links_back FROM links GROUP BY page_id")
def links_back(spark: SparkSession, d: str) -> DataFrame:
    return links.links_back(links.page_links(pages(spark, d)))


@R.query(
    f"""WITH {LINKS_SQL}, keyed AS (SELECT page_id, pos, target, rtrim(regexp_replace(target, '[?#].*$', ''), '/') AS key FROM links WHERE regexp_matches(target, '^https?://')),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY pos) AS n FROM keyed WHERE key NOT IN (SELECT dedup_key FROM canon)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM fresh WHERE n = 1)
    SELECT page_id, pos::INTEGER AS pos, key FROM ranked WHERE r <= 3"""
)
def link_expand(spark: SparkSession, d: str) -> DataFrame:
    seen = pages(spark, d).select(urls.dedup_key(F.col("url")).alias("key"))
    return links.followups(links.page_links(pages(spark, d)), seen).select("page_id", "pos", "key")


CATEGORIES = [("Feed", ["utm_source", "/fr/"], ["the", "tion"]), ("Mobile", ["m.", "page="], ["und", "der"]), ("Archive", [".html", "/de/"], ["ing"]), ("Blog", ["blog."], ["blog"])]


def _category_sql() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    scores = ", ".join(
        f"3 * len(list_filter({quoted(t)}, lambda w: contains(u, w))) + 4 * len(list_filter({quoted(k)}, lambda w: contains(title, w))) + 2 * len(list_filter({quoted(k)}, lambda w: contains(body, w) AND NOT contains(title, w))) AS s{i}"
        for i, (_, t, k) in enumerate(CATEGORIES)
    )
    pick = " ".join(f"WHEN s{i} = top THEN '{n}'" for i, (n, *_) in enumerate(CATEGORIES))
    return f"""WITH x AS (SELECT page_id, lower(url) AS u, lower(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))) AS title,
      lower(html) AS body FROM pages), s AS (SELECT page_id, {scores} FROM x), t AS (SELECT *, greatest(s0, s1, s2, s3) AS top FROM s)
      SELECT page_id, CASE WHEN top <= 0 THEN 'Portal' {pick} END AS category, top::BIGINT AS score FROM t"""


@R.query(_category_sql())
def category_score(spark: SparkSession, d: str) -> DataFrame:
    """A weighted dictionary over url, title and text; of equal scores the earlier category."""
    name, score = rules.weighted_category(CATEGORIES, F.lower("url"), F.lower(text.title(F.col("html"))), F.lower("html"), "Portal")
    return pages(spark, d).select("page_id", name.alias("category"), score.cast("long").alias("score"))


# Kinds of portals by platform, by whole labels of the host and by parts of the path, in order.
PLATFORMS = {
    "samarth.edu.in": "Student Portal", "digitaluniversity.ac": "Student Portal", "digitaluniversity.ac.in": "Student Portal", "digiicampus.com": "Student Portal", "sumsraj.com": "Student Portal", "mponline.gov.in": "Student Portal",
    "core-campus.in": "Student Portal", "campus365.io": "Student Portal", "campuspro.in": "Student Portal", "campuspro.com": "Student Portal", "linways.com": "Student Portal", "datavista.in": "Student Portal", "camu.in": "Student Portal",
    "mycamu.co.in": "Student Portal", "etlab.in": "Student Portal", "etlab.app": "Student Portal", "bihar-ums.com": "Student Portal", "uni1erp.in": "Student Portal", "aktu.ac.in": "Student Portal", "gndu.ac.in": "Student Portal",
    "edumarshal.com": "ERP", "mastersofterp.in": "ERP", "accsofterp.com": "ERP", "campx.in": "ERP", "vmedulife.com": "ERP", "dhi-edu.com": "ERP", "edupluscampus.com": "ERP", "myclassboard.com": "ERP",
    "moodle.live": "LMS/Moodle", "cognibot.in": "LMS/Moodle", "knimbus.com": "Library Portal", "myloft.xyz": "Library Portal", "eduqfix.com": "Fee Portal", "feepayr.com": "Fee Portal", "billdesk.com": "Fee Portal",
    "ucanapply.com": "Admission Portal", "enrollonline.co.in": "Admission Portal",
}
LMS_PLATFORMS = discovery.LMS_ROOTS
LMS = ["moodle", "lms", "elearning", "learning", "vle", "lcms", "elearn"]
LABELS = [
    ("Webmail", ["webmail", "owa", "roundcube", "zimbra", "mail", "email"], []),
    ("Examination Portal", ["coe", "exam", "exams", "examination", "result", "results", "hallticket", "admitcard"], ["/exam", "/result", "/hall-ticket", "/hallticket", "/admit-card", "/admitcard", "/transcript", "/certificate", "/coe"]),
    ("Fee Portal", ["fee", "fees", "feeportal", "feeadmin", "payment", "payments", "paydirect", "eazypay"], ["/fee", "/fees", "/payment", "/onlinefee", "/feepayment"]),
    ("Library Portal", ["library", "lib", "opac", "libportal", "elibrary", "duls"], ["/library", "/opac", "/koha"]),
    ("Admission Portal", ["admission", "admissions", "apply", "enroll", "enrollonline", "ucanapply", "ucanassess"], ["/admission", "/apply", "/enroll"]),
    ("Placement Portal", ["placement", "placements", "tnp", "career", "careers"], ["/placement", "/career"]),
    ("Hostel Portal", ["hostel", "hostels"], []),
    ("ERP", ["erp", "sap", "ums", "iums", "mis", "sis", "sim", "ams", "oas", "academia", "accsoft", "mastersofterp"], ["/erp", "/ums", "/iums", "/mis"]),
    ("Academic Portal", ["academic", "academics", "grade", "grades", "records"], ["/academic", "/grade"]),
]


def portal_type(url, default: str = "Student Portal"):
    """The kind of a portal by a decision list over host labels and path."""
    h, p = urls.host(url), F.lower(urls.path(url))
    lms = rules.points([(p.endswith("/login/index.php"), 2), (p.contains("/moodle"), 2), (rules.contains_any(h, LMS), 2), (urls.under(h, LMS_PLATFORMS), 1)]) >= 2
    steps = [(urls.under(h, [root]), kind) for root, kind in PLATFORMS.items()] + [(lms, "LMS/Moodle")]
    for kind, labels, paths in LABELS:
        more = F.exists(F.split(h, r"\."), lambda x: F.endswith(x, F.lit("erp"))) if kind == "ERP" else h.contains("koha") if kind == "Library Portal" else F.lit(False)
        steps.append((rules.has_label(h, labels) | rules.contains_any(p, paths or ["\x00"]) | more, kind))
    return rules.first_of(steps, default)


@R.query(
    f"""WITH {PAGE_PARTS}, c AS (SELECT page_id, host, path, CASE WHEN contains(lower(path || ' ' || query), 'utm') THEN 'feed' WHEN contains(lower(path), 'de/') THEN 'german' WHEN contains(lower(path), 'en/') THEN 'english' END AS cat FROM parts),
    f AS (SELECT *, row_number() OVER (PARTITION BY host, coalesce(cat, path) ORDER BY page_id) AS n FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r FROM f WHERE n = 1)
    SELECT host, page_id, coalesce(cat, '') AS category FROM k WHERE r <= 4"""
)
def legal_documents(spark: SparkSession, d: str) -> DataFrame:
    """One page per host and category (of none: per path), at most four for a host."""
    u = F.col("url")
    category = rules.first_of([(F.lower(F.concat_ws(" ", urls.path(u), urls.query(u))).contains("utm"), "feed"), (F.lower(urls.path(u)).contains("de/"), "german"), (F.lower(urls.path(u)).contains("en/"), "english")])
    df = pages(spark, d).select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), category.alias("category"))
    one = dedup.top(df.withColumn("key", F.coalesce("category", "path")), ["host", "key"], [F.col("page_id")])
    return dedup.top(one, ["host"], [F.col("page_id")], 4).select("host", "page_id", F.coalesce("category", F.lit("")).alias("category"))


@R.query(
    r"""SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name_key, trim(regexp_replace(lower(c_name || ' & Co'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
    md5(c_name) AS print FROM customer"""
)
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    c = parquet(spark, d, "customer")
    return c.select("c_custkey", text.name_key(F.col("c_name")).alias("name_key"), text.slug(F.concat(F.col("c_name"), F.lit(" & Co"))).alias("slug"), text.fingerprint(F.col("c_name")).alias("print"))


@R.query(
    r"""SELECT doc_id, regexp_matches(text, '(?i)(^|[^\pL\pN_-])license($|[^\pL\pN_-])') AS named, regexp_matches(text, '(?i)(^|[^\pL\pN_-])apache\s+license($|[^\pL\pN_-])') AS apache
    FROM documents WHERE contains(lower(text), 'license')"""
)
def keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    """Keywords that hyphens don't extend, in documents that hold them at all."""
    docs = parquet(spark, d, "documents").filter(F.lower("text").contains("license"))
    return docs.select("doc_id", *[F.rlike("text", F.lit(text.keyword_pattern(k))).alias(n) for k, n in (("license", "named"), ("apache license", "apache"))])
