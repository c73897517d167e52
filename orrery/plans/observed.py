"""Queries over candidates, their pages and their links: scores, gates, predicates and matching, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import rules, sites, text, urls
from orrery.operators import catalog, cells, dedup, discovery, evaluation, gates, keyword_context, links, verdicts
from orrery.plans.roles import (
    ALL_PORTALS,
    CANDIDATES,
    ORGS,
    Registry,
    all_portals,
    candidates,
    orgs,
    sql_any,
    sql_first,
    sql_label,
    sql_list,
    sql_points,
    sql_turn,
    sql_under,
    turn,
)
from orrery.sources import tables
from orrery.sources.tables import parquet

R = Registry()
ROOT_SQL = f"""CASE WHEN len(string_split(host, '.')) < 2 THEN host WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({', '.join(f"'{s}'" for s in urls.SUFFIXES)})
  THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END"""


# ------------------------------------------------------------------ hosts and urls


@R.query(
    f"""WITH {CANDIDATES} SELECT page_id, host, {ROOT_SQL} AS registrable, CASE regexp_extract(host, '([^.]*)$', 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in urls.COUNTRIES.items())} ELSE 'Global' END AS country
    FROM candidates"""
)
def host_cases(spark: SparkSession, d: str) -> DataFrame:
    h = urls.host(F.col("url"))
    return candidates(spark, d).select("page_id", h.alias("host"), urls.registrable(h).alias("registrable"), urls.country(h).alias("country"))


@R.query(f"WITH {CANDIDATES}, r AS (SELECT page_id, split_part({ROOT_SQL}, '.', 1) AS l FROM candidates) SELECT page_id, CASE WHEN length(l) >= 3 THEN l ELSE '' END AS short FROM r")
def short_names(spark: SparkSession, d: str) -> DataFrame:
    """The first label of the registrable domain, if it has three letters."""
    root = F.substring_index(urls.registrable(urls.host(F.col("url"))), ".", 1)
    return candidates(spark, d).select("page_id", F.when(F.length(root) >= 3, root).otherwise("").alias("short"))


def _portal_type_sql(url_path: str) -> str:
    from orrery.plans import web

    lms = sql_points([(f"ends_with({url_path}, '/login/index.php')", 2), (f"contains({url_path}, '/moodle')", 2), (sql_any("host", web.LMS), 2), (sql_under("host", web.LMS_PLATFORMS), 1)])
    steps = [(sql_under("host", [root]), kind) for root, kind in web.PLATFORMS.items()] + [(f"{lms} >= 2", "LMS/Moodle")]
    for kind, labels, paths in web.LABELS:
        more = " OR len(list_filter(string_split(host, '.'), lambda x: ends_with(x, 'erp'))) > 0" if kind == "ERP" else " OR contains(host, 'koha')" if kind == "Library Portal" else ""
        some = f" OR {sql_any(url_path, paths)}" if paths else ""
        steps.append((f"({sql_label('host', labels)}{some}{more})", kind))
    return sql_first(steps, "Student Portal")


@R.query(f"WITH {CANDIDATES}, p AS (SELECT page_id, host, lower(path) AS p FROM candidates) SELECT page_id, {_portal_type_sql('p')} AS kind FROM p")
def portal_types(spark: SparkSession, d: str) -> DataFrame:
    from orrery.plans import web

    return candidates(spark, d).select("page_id", web.portal_type(F.col("url")).alias("kind"))


@R.query(
    f"""WITH {CANDIDATES}, p AS (SELECT page_id, lower(path) AS p, split_part(authority, '.', 1) AS label FROM candidates) SELECT page_id,
    {sql_first([(sql_any('p', discovery.ERROR_PATHS), ''), ('(' + ' OR '.join(f"starts_with(label, '{w}')" for w in discovery.PORTAL_LABELS) + ')', 'host'), (sql_any('p', discovery.LOGIN_PATHS), 'path')])} AS shape FROM p"""
)
def login_shapes(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("page_id", discovery.login_shape(F.col("url")).alias("shape"))


LMS_SQL = sql_points([
    ("ends_with(path, '/login/index.php')", 2), ("contains(path, '/moodle')", 2), (sql_any("host", discovery.LMS_HOSTS), 2), (sql_under("host", discovery.LMS_ROOTS), 1), ("contains(low, 'moodle')", 1),
    ("contains(low, 'powered by moodle')", 1), ("(contains(low, 'class=\"moodle-') OR contains(low, 'class=\"mod-'))", 1), ("(contains(low, 'name=\"generator\"') AND contains(low, 'moodle'))", 1),
    ("contains(low, 'cookies must be enabled in your browser')", 1),
])


@R.query(f"WITH {CANDIDATES} SELECT page_id, {LMS_SQL} AS score FROM candidates")
def lms_scores(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("page_id", discovery.lms_score(F.col("url"), F.col("html")).alias("score"))


@R.query(
    f"""WITH {CANDIDATES}, p AS (SELECT page_id, host, tenant, root, lower(path) AS p, regexp_matches(low, '<input[^>]*type=["'']password["'']') AS password FROM candidates) SELECT page_id,
    {sql_points([(sql_any('p', ['login', 'signin', 'sign-in', 'auth']), 3), ('password', 2), ("host = tenant || '.' || root", 1), ("len(list_filter(string_split(p, '/'), lambda s: s <> '')) <= 2", 1)])}
    + 5 * len(list_filter(['student'], lambda w: contains(p, w))) - 10 * len(list_filter(['staff', 'admin'], lambda w: contains(p, w))) AS score FROM p"""
)
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    primary = F.concat_ws(".", "tenant", "root")
    password = discovery.form_signals(F.col("html"))["n_passwords"] > 0
    return c.select("page_id", discovery.candidate_score(F.col("url"), password, primary).cast("long").alias("score"))


@R.query(
    rf"""WITH {CANDIDATES} SELECT page_id, len(regexp_extract_all(low, '<form[\s>]')) AS n_forms, len(regexp_extract_all(low, '<input[\s>]')) AS n_inputs,
    len(regexp_extract_all(low, '<input[^>]*type=["'']password["'']')) AS n_passwords, regexp_matches(low, '<input[^>]*(?:name|id|placeholder)=["''][^"'']*(?:user|email|login|roll|enrol|regno)') AS has_user FROM candidates"""
)
def form_signals(spark: SparkSession, d: str) -> DataFrame:
    s = discovery.form_signals(F.col("html"))
    return candidates(spark, d).select("page_id", *[s[k].cast("long").alias(k) for k in ("n_forms", "n_inputs", "n_passwords")], s["has_user"].alias("has_user"))


PHRASES, BETWEEN = ["Disclaimer", "Home", "Terms of Use", "Welcome", " Privacy Policy ", "disclaimer page"], [" - ", " | ", " :: ", " : ", " — "]


@R.query(
    f"""WITH {CANDIDATES}, t AS (SELECT page_id, lower(trim({sql_turn(PHRASES)} || {sql_turn(BETWEEN)} || title)) AS t FROM candidates)
    SELECT page_id, trim(split_part(split_part(split_part(split_part(split_part(t, ' - ', 1), ' | ', 1), ' :: ', 1), ' : ', 1), ' — ', 1)) IN ('disclaimer', 'terms of use', 'privacy policy') AS strong FROM t"""
)
def strong_titles(spark: SparkSession, d: str) -> DataFrame:
    whole = F.concat(turn(PHRASES), turn(BETWEEN), F.col("title"))
    return candidates(spark, d).select("page_id", discovery.strong_title(whole, ["disclaimer", "terms of use", "privacy policy"]).alias("strong"))


# ------------------------------------------------------------------ predicates over urls and bodies

SEEN_SQL = "page_id % 5 * 100 + page_id % 4 AS status"
ANY_MAIL = "(" + sql_first([(f"split_part(host, '.', 1) IN ({', '.join(repr(x) for x in sites.MAIL_LABELS)}) OR ends_with(split_part(host, '.', 1), 'mail') OR regexp_matches(url, '{sites.MAIL_PATHS}')", "true")], "false") + ")::BOOLEAN"


@R.query(
    f"""WITH {CANDIDATES}, p AS (SELECT *, lower(path) AS p, split_part(authority, '.', 1) AS label FROM candidates) SELECT page_id, {sql_any('p', sites.ADMIN_PATHS)} AS admin, rtrim(path, '/') = '' AS home,
    {sql_any('p', discovery.ERROR_PATHS)} AS error_path, regexp_matches(p, '{sites.SUBPAGES}') AS subpage, {sql_any('p', ['/custom.htm', '/error.htm', '/404.htm', '/errorpage', '/error.aspx', '/error.html', '/notfound'])} AS error_url,
    {sql_any('p', ['/disclaimer', '/terms', '/privacy', '/legal', '/policy'])} AS legal_path, regexp_matches(path, '(?i)privacy|terms?|t&?c|tnc|disclaimer|copyright|conditions?|cookie|\\blegal\\b') AS strong_legal,
    {sql_any("lower(url)", verdicts.TERMS)} AS terms, coalesce(list_filter({sql_list(sites.OTHER_DOCUMENTS)}, lambda w: contains(p, w))[1], '') AS other_document,
    path IN ('/terms-of-use', '/privacy-policy') AS legal_page FROM p"""
)
def path_flags(spark: SparkSession, d: str) -> DataFrame:
    """What a candidate's path says of its page."""
    u = F.col("url")
    return candidates(spark, d).select(
        "page_id", sites.admin_path(u).alias("admin"), sites.homepage(u).alias("home"), rules.contains_any(F.lower(urls.path(u)), discovery.ERROR_PATHS).alias("error_path"), sites.login_subpage(u).alias("subpage"),
        sites.error_url(u).alias("error_url"), sites.legal_path(u).alias("legal_path"), sites.strong_legal(u).alias("strong_legal"), verdicts.is_terms_url(u).alias("terms"), sites.other_document(u).alias("other_document"),
        sites.legal_page(u).alias("legal_page"),
    )


@R.query(
    f"""WITH {CANDIDATES}, p AS (SELECT *, split_part(authority, '.', 1) AS label FROM candidates) SELECT page_id, host IN ({', '.join(repr(x) for x in sites.SSO_HOSTS)}) AS sso, {ANY_MAIL} AS mail,
    contains(host, '.ac.') OR {' OR '.join(f"ends_with(host, '{s}')" for s in sites.ACADEMIC_SUFFIXES)} AS academic, coalesce(list_filter({sql_list(sites.TEST_HOSTS)}, lambda w: contains(authority, w))[1], '') AS test_part,
    CASE WHEN label = 'hr-portal' THEN 'hr' ELSE '' END AS office, {sql_any('label', sites.COLLEGE_WORDS)} OR (length(label) BETWEEN 3 AND 6) AS college,
    regexp_replace(url, '\\.samarth\\.ac\\.in\\b', '.samarth.edu.in') AS student_url, {sql_under('host', ['knimbus.com', 'samarth.edu.in'])} AS never_probe,
    (host IN ('samarth.edu.in') OR starts_with(host, 'idp.') OR {ANY_MAIL} OR contains(path, '/about')) AS junk FROM p"""
)
def host_flags(spark: SparkSession, d: str) -> DataFrame:
    """What a candidate's host says of its page."""
    u, h = F.col("url"), urls.host(F.col("url"))
    label = F.substring_index(urls.authority(u), ".", 1)
    return candidates(spark, d).select(
        "page_id", sites.generic_sso(u).alias("sso"), sites.webmail(u).alias("mail"), sites.academic_host(h).alias("academic"), sites.test_host(u).alias("test_part"), sites.office_label(u).alias("office"), sites.college_label(label).alias("college"),
        sites.student_host(u).alias("student_url"), urls.under(h, ["knimbus.com", "samarth.edu.in"]).alias("never_probe"), sites.junk_portal(u, ["samarth.edu.in"], "/about").alias("junk"),
    )


#: A block that is a footer by its class or id.
NAMED_FOOTER = "(?is)" + "|".join(rf"""<{t}[^>]*(?:class|id)=["''][^"'']*\b(?:footer|bottom)\b[^>]*>.*?</{t}>""" for t in ("div", "section", "nav"))


@R.query(
    rf"""WITH {CANDIDATES}, a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS t FROM candidates),
    dead AS (SELECT DISTINCT page_id FROM a WHERE {sql_any("lower(t)", sites.LEGAL_TEXTS)} AND ends_with(href, '#')), f AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<footer[^>]*>.*?</footer>', 0), ''), regexp_extract(html, '{NAMED_FOOTER}', 0)) AS f FROM candidates)
    SELECT page_id, length(low) < 200 OR {sql_any('low', sites.CHALLENGES)} AS challenge, len(list_filter({sql_list(sites.BLOCKS)}, lambda m: contains(low, m))) >= 2 AND NOT (length(low) <= 6000 AND {sql_any('low', sites.INTERSTITIALS)}) AS blocked,
    contains(low, 'password') AND {sql_any('low', sites.LOGIN_MARKS)} AND length(low) < 2500 AS login_page, page_id IN (SELECT page_id FROM dead) AS dead_link, md5(f) AS footer_md5,
    trim(regexp_extract(trim(regexp_replace(regexp_replace(f, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '(?i)developed by ([A-Za-z][A-Za-z0-9_ .&''-]{{2,40}})', 1)) AS maker,
    length(low) >= 500 AND len(list_filter({sql_list(sites.PDF_PHRASES)}, lambda m: contains(low, m))) >= 2 AS legal_text FROM candidates JOIN f USING (page_id)"""
)
def body_flags(spark: SparkSession, d: str) -> DataFrame:
    """What a candidate's body says, its footer and who made the site."""
    b = F.col("html")
    made = F.when(F.col("footer") != "", sites.maker(text.visible_text(F.col("footer")))).otherwise("")
    return candidates(spark, d).withColumn("footer", sites.footer(b)).select(
        "page_id", sites.challenge_page(b).alias("challenge"), sites.block_page(b).alias("blocked"), sites.login_page(b).alias("login_page"), sites.dead_legal_link(b).alias("dead_link"), F.md5("footer").alias("footer_md5"),
        made.alias("maker"), sites.legal_text(b).alias("legal_text"),
    )


FORM_SQL = r"len(regexp_extract_all(low, '<form[\s>]'))"
INPUT_SQL = r"len(regexp_extract_all(low, '<input[\s>]'))"
PASSWORD_SQL = "regexp_matches(low, '<input[^>]*type=[\"'']password[\"'']')"
HINT_SQL = "(?i)login|sign-?in|signon|/sso|/cas|shibboleth|adfs|oauth|/auth|samlrequest|auth\\."


@R.query(
    rf"""WITH {CANDIDATES}, s AS (SELECT *, [200, 401, 404, 301][page_id % 4 + 1] AS status, regexp_matches(path, '{HINT_SQL}') AS named, contains(low, 'moodle') AS platform, {ROOT_SQL} AS reg FROM candidates)
    SELECT page_id, {PASSWORD_SQL} OR ({FORM_SQL} > 0 AND {INPUT_SQL} >= 2) OR (named AND ({FORM_SQL} > 0 OR {INPUT_SQL} >= 1)) OR (platform AND (named OR {FORM_SQL} > 0))
      OR (status = 401 AND regexp_matches(url, '{HINT_SQL}')) OR (status = 200 AND rtrim(path, '/') = '' AND host <> reg) AS affords,
    {sql_first([("status NOT IN (200, 401, 403)", 'status'), ("host IN ('samarth.edu.in', 'knimbus.com')", 'bare platform'), (sql_under('host', ['bihar-ums.com']), 'foreign'), ("length(low) < 200 OR " + sql_any('low', sites.CHALLENGES), 'body'), (sql_any("lower(path)", ['/staff']), 'audience')], 'kept')} AS gate FROM s"""
)
def validated(spark: SparkSession, d: str) -> DataFrame:
    """The hard gate over an observation of each candidate: its status, host, body and audience, and whether one can log in."""
    u, h, b = F.col("url"), urls.host(F.col("url")), F.col("html")
    status = F.element_at(F.lit([200, 401, 404, 301]), (F.col("page_id") % 4 + 1).cast("int"))
    s = discovery.form_signals(b)
    affords = sites.affordance(u, F.col("status"), s["n_passwords"] > 0, s["n_forms"], s["n_inputs"], F.lower(b).contains("moodle"))
    gate = gates.validated(status=F.col("status"), host=h, body=b, audience=F.lower(urls.path(u)), bare=["samarth.edu.in", "knimbus.com"], foreign=["bihar-ums.com"], others=["/staff"])
    return candidates(spark, d).withColumn("status", status).select("page_id", affords.alias("affords"), gate.alias("gate"))


# ------------------------------------------------------------------ gates

ADMISSION = {
    "tokens": ["admission"], "platforms": ["ucanapply.com"], "exempt": ["moodle"], "titles": ["apply online", "êeux"], "strong": ["entrance test"], "weak": ["prospectus", "last date", "eligibility", "fee waiver"], "against": ["student login"],
}


@R.query(
    f"""WITH {CANDIDATES}, x AS (SELECT page_id, host, lower(host || path) AS w, lower(title) AS head, low, len(list_filter({sql_list(ADMISSION['weak'])}, lambda t: contains(low, t))) AS n FROM candidates) SELECT page_id,
    {sql_first([(sql_any('w', ADMISSION['tokens']), 'url'), (sql_under('host', ADMISSION['platforms']), 'platform'), (sql_any('low', ADMISSION['exempt']), ''), (sql_any('head', ADMISSION['titles']), 'title'),
    (sql_any('low', ADMISSION['strong']), 'strong'), (f"n >= 2 AND NOT {sql_any('low', ADMISSION['against'])}", 'weak'), ('n >= 4', 'many weak')])} AS reason FROM x"""
)
def admission_pages(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("page_id", gates.admission(F.col("url"), F.col("title"), F.col("html"), **ADMISSION).alias("reason"))


@R.query(
    f"""WITH {CANDIDATES}, x AS (SELECT *, regexp_extract(low, '(?s)<noscript[^>]*>(.*?)</noscript>', 1) AS ns, split_part(authority, '.', 1) AS label, length(html) BETWEEN 1 AND 1999 AS tiny FROM candidates) SELECT page_id,
    {sql_points([("contains(low, 'javascript disabled')", 2), (sql_any('low', ['please enable javascript', 'enable javascript in your browser', 'this site requires javascript']), 2), ("tiny AND " + sql_any('lower(path)', ['/login', '/signin', '/auth']), 3),
    ("tiny AND label IN ('login', 'portal', 'erp', 'sso') AND path IN ('', '/')", 3), (sql_any('ns', ['enable', 'javascript']), 1), ("length(html) BETWEEN 1 AND 499 AND len(regexp_extract_all(low, '<script[^>]+src=')) >= 3", 1),
    ('''regexp_matches(low, 'id=["''](?:root|app)["'']|data-reactroot|ng-app|data-vue-root')''', 1)])} AS score FROM x"""
)
def shell_scores(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("page_id", gates.shell_score(F.col("url"), F.col("html")).alias("score"))


@R.query(
    rf"""WITH {CANDIDATES}, x AS (SELECT *, lower(path) AS p, split_part(authority, '.', 1) AS label FROM candidates),
    f AS (SELECT DISTINCT page_id FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '(?is)<form(?:\s[^>]*)?>.*?</form>')) AS f FROM x)
      WHERE regexp_matches(f, '(?i)<input[^>]*type=["'']?password') AND regexp_matches(f, '(?i)<input[^>]*(?:name|id|type|placeholder)=["''][^"'']*(?:user|email|login|roll|enrol|regno)') AND regexp_extract(f, '(?i)^<form[^>]*\saction=["''](https?://[^/"''?#]+)', 1) = ''),
    a AS (SELECT DISTINCT page_id FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS t FROM x)
      WHERE trim(regexp_replace(regexp_replace(lower(t), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) IN ('login', 'student login', 'sign in', 'portal login') AND {sql_any('lower(href)', ['login', 'signin', 'auth'])})
    SELECT page_id, {sql_first([(sql_under('host', ['samarth.edu.in']), 'shared platform'), ('page_id IN (SELECT page_id FROM f)', 'form'), ("path IN ('', '/') AND page_id IN (SELECT page_id FROM a)", 'link'), (sql_any('p', discovery.ERROR_PATHS), ''),
    ('(' + ' OR '.join(f"starts_with(label, '{w}')" for w in discovery.PORTAL_LABELS) + ')', 'host'), (sql_any('p', discovery.LOGIN_PATHS), 'path')])} AS rule_name FROM x"""
)
def login_gates(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("page_id", gates.login_gate(F.col("url"), F.col("html"), ["samarth.edu.in"]).alias("rule_name"))


NAMES = [["lib", "ththre"], ["portal"], ["du"], ["samarth", "college"], ["coll"]]
OWNED = [["uni.ac.in"], ["college.edu", "usp.br"], []]


@R.query(
    f"""WITH {CANDIDATES}, x AS (SELECT page_id, host, {ROOT_SQL} AS base, {[*map(list, NAMES)]}[page_id % 5 + 1] AS names, [['uni.ac.in'], ['college.edu', 'usp.br'], []::VARCHAR[]][page_id % 3 + 1] AS owned,
      CASE WHEN {sql_under('host', ['samarth.edu.in'])} THEN left(host, greatest(length(host) - 15, 0)) END AS t FROM candidates)
    SELECT page_id, {sql_first([(sql_under('host', ['bihar-ums.com']), 'no: foreign platform'), ("t = ''", 'no: bare platform'), ("t IS NOT NULL AND len(list_filter(names, lambda s: t = s OR ends_with('.' || t, '.' || s) OR (length(s) >= 4 AND contains(t, s)))) > 0", 'tenant'),
    ('t IS NOT NULL', 'no: other tenant'), ("len(list_filter(owned, lambda o: host = o OR ends_with(host, '.' || o))) > 0", 'own domain'), ('len(list_filter(names, lambda s: length(s) >= 4 AND starts_with(base, s))) > 0', 'short name'), (sql_under('host', ['knimbus.com']), 'shared platform')], 'no: mismatch')} AS reason FROM x"""
)
def host_membership(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) if x else F.array().cast("array<string>") for x in xs]), (F.col("page_id") % len(xs) + 1).cast("int"))
    c = candidates(spark, d).select("page_id", urls.host(F.col("url")).alias("host"), pick(OWNED).alias("owned"), pick(NAMES).alias("names"))
    return gates.membership(c, host="host", owned="owned", names="names", platforms=["samarth.edu.in"], foreign=["bihar-ums.com"], shared=["knimbus.com"]).select("page_id", "reason")


@R.query(
    f"""WITH {CANDIDATES}, x AS (SELECT page_id, root, tenant || ['', 'rec', 'admission'][page_id % 3 + 1] AS tenant FROM candidates), peers AS (SELECT DISTINCT root, tenant FROM x)
    SELECT page_id, tenant FROM x WHERE NOT EXISTS (SELECT 1 FROM peers p WHERE p.root = x.root AND p.tenant <> '' AND (x.tenant = p.tenant || 'rec' OR x.tenant = p.tenant || 'admission'))"""
)
def tenant_peers(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).withColumn("tenant", F.concat("tenant", turn(["", "rec", "admission"])))
    return discovery.without_admin_peers(c, root="root", tenant="tenant", suffixes=["rec", "admission"]).select("page_id", "tenant")


# ------------------------------------------------------------------ links

LINKS = rf"""{CANDIDATES}, anchors AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS raw, unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>')))) AS pos FROM candidates),
linked AS (SELECT a.page_id, pos::INTEGER AS pos, href, trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text, host AS own,
  CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://' || authority || href
  ELSE 'https://' || authority || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS target FROM anchors a JOIN candidates USING (page_id))"""
STUDENT_SQL = sql_points([
    (sql_any("b", discovery.STUDENT_PHRASES), 3), ("contains(b, 'student')", 2), (sql_any("b", discovery.PLATFORM_WORDS) + " AND contains(parent, 'student')", 2), (sql_any("b", discovery.LOGIN_WORDS), 1),
    (sql_any("b", discovery.STAFF_WORDS), -2), (sql_any("b", discovery.OTHER_WORDS), -3),
])
@R.query(rf"WITH {LINKS} SELECT page_id, pos, target, text FROM linked WHERE regexp_matches(target, '(?i)^https?://') AND regexp_replace(regexp_extract(target, '://([^/?#]*)', 1), '^www\.', '') <> own")
def outbound_links(spark: SparkSession, d: str) -> DataFrame:
    return links.outbound(links.page_links(candidates(spark, d))).select("page_id", "pos", "target", "text")


FOOTER_SQL = LINKS.replace("FROM candidates),\nlinked", "FROM (SELECT page_id, regexp_extract(html, '(?is)<footer[^>]*>.*?</footer>', 0) AS html FROM candidates)),\nlinked")


@R.query(
    rf"""WITH {FOOTER_SQL}, f AS (SELECT page_id, own, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<footer[^>]*>.*?</footer>', 0), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS said FROM candidates JOIN (SELECT DISTINCT page_id, own FROM linked) USING (page_id)),
    x AS (SELECT l.page_id, pos, regexp_replace(regexp_extract(target, '://([^/?#]*)', 1), '^www\.', '') AS host FROM linked l JOIN f USING (page_id) WHERE regexp_matches(said, '(?i)developed by')),
    o AS (SELECT page_id, pos, {ROOT_SQL} AS root FROM x), p AS (SELECT page_id, {ROOT_SQL} AS own FROM candidates), first AS (SELECT page_id, arg_min(root, pos) AS maker FROM o JOIN p USING (page_id) WHERE root <> own AND root <> 'other.org' GROUP BY page_id)
    SELECT page_id, CASE WHEN contains(low, 'moodle') THEN 'Moodle' WHEN contains(low, 'einrich') THEN 'learned' ELSE maker END AS vendor, NOT contains(low, 'moodle') AND NOT contains(low, 'einrich') AS fresh
    FROM candidates LEFT JOIN first USING (page_id) WHERE contains(low, 'moodle') OR contains(low, 'einrich') OR maker IS NOT NULL"""
)
def vendor_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Who runs a site: a known signature, else a learned name, else the maker that its footer names and links."""
    known = spark.createDataFrame([("Moodle", 1, ["moodle"]), ("learned", 2, ["einrich"])], "vendor string, rank int, words array<string>")
    c = candidates(spark, d)
    named = discovery.vendors(c, known, keys=["page_id"], text=F.col("html")).withColumn("fresh", F.lit(False))
    made = c.filter(sites.attribution(F.col("html")) != "").filter(sites.footer(F.col("html")) != "")
    fresh = discovery.linked_makers(made, blocked=["other.org"]).select("page_id", "vendor", F.lit(True).alias("fresh"))
    return named.unionByName(fresh.join(named.select("page_id"), "page_id", "left_anti"))


@R.query(
    rf"""WITH {LINKS}, u AS (SELECT page_id, host, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS key FROM candidates), k AS (SELECT DISTINCT page_id, rtrim(regexp_replace(target, '[?#].*$', ''), '/') AS key FROM linked WHERE regexp_matches(target, '^https?://')),
    one AS (SELECT DISTINCT k.page_id, v.page_id AS via, k.key FROM k JOIN u v USING (key) WHERE v.page_id <> k.page_id), two AS (SELECT DISTINCT o.page_id, k.key FROM one o JOIN k ON o.via = k.page_id)
    SELECT page_id, key, min(level)::INTEGER AS level FROM (SELECT page_id, key, 1 AS level FROM k UNION ALL SELECT page_id, key, 2 FROM two) GROUP BY ALL"""
)
def two_level_crawl(spark: SparkSession, d: str) -> DataFrame:
    """The targets of each page, and of the stored pages that it links to."""
    c = candidates(spark, d)
    return links.two_levels(links.page_links(c), c.select("page_id", urls.dedup_key(F.col("url")).alias("key")))


@R.query(
    rf"""WITH {CANDIDATES}, c AS (SELECT page_id, host, path, CASE WHEN contains(path, 'terms') THEN 'terms' WHEN contains(path, 'privacy') THEN 'privacy' WHEN contains(path, 'fee/pay') THEN 'payment' END AS cat, page_id % 9 AS score FROM candidates WHERE {sql_any('path', ['terms', 'privacy', 'fee/pay', '/about'])}),
    f AS (SELECT *, row_number() OVER (PARTITION BY host, coalesce(cat, path) ORDER BY score DESC, page_id) AS n FROM c), g AS (SELECT *, bool_or(regexp_matches(path, '(?i)terms?|privacy')) OVER (PARTITION BY host) AS strong FROM f WHERE n = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS r FROM g WHERE strong) SELECT host, page_id, coalesce(cat, '') AS category FROM k WHERE r <= 4"""
)
def legal_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per host one page of each legal category, at most four; none for a host that has only payment policies."""
    p = urls.path(F.col("url"))
    category = rules.first_of([(p.contains("terms"), "terms"), (p.contains("privacy"), "privacy"), (p.contains("fee/pay"), "payment")])
    c = candidates(spark, d).filter(rules.contains_any(p, ["terms", "privacy", "fee/pay", "/about"]))
    c = c.select("page_id", urls.host(F.col("url")).alias("host"), p.alias("path"), category.alias("category"), sites.strong_legal(F.col("url")).alias("strong"), (F.col("page_id") % 9).alias("score"))
    return links.legal_set(c, host="host", category="category", path="path", strong="strong", order=[F.col("score").desc(), F.col("page_id")]).select("host", "page_id", F.coalesce("category", F.lit("")).alias("category"))


# ------------------------------------------------------------------ answers, names, places


@R.query(
    r"""WITH a AS (SELECT conv_id, turn, ['PROHIBITED', 'Allowed', 'ambiguous', 'unknown'][turn % 4 + 1] AS said, role FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL WHEN said = 'PROHIBITED' THEN 'No' WHEN said = 'Allowed' THEN 'Yes' WHEN said = 'ambiguous' THEN 'Maybe' END AS verdict, CASE WHEN turn % 5 = 4 THEN '' ELSE 'by ' || role END AS clause,
    CASE WHEN turn % 5 = 4 THEN '' ELSE 'turn ' || turn END AS reason FROM a"""
)
def verdict_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of VERDICT, CLAUSE and REASON at the end of whole answers; every fifth turn has none."""
    c = parquet(spark, d, "conversations")
    said = F.element_at(F.lit(["PROHIBITED", "Allowed", "ambiguous", "unknown"]), (F.col("turn") % 4 + 1).cast("int"))
    block = F.concat(F.lit("\nVERDICT: "), said, F.lit('\nclause: "by '), F.col("role"), F.lit('"\nReason: turn '), F.col("turn").cast("string"))
    answer = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 5 == 4, "").otherwise(block))
    parts = discovery.verdict_block(F.col("answer"))
    return c.select("conv_id", "turn", answer.alias("answer")).select("conv_id", "turn", *[x.alias(k) for k, x in parts.items()])


@R.query("SELECT conv_id, turn, CASE WHEN contains(coalesce(text, ''), '[') OR contains(coalesce(text, ''), ']') THEN NULL ELSE role END AS second FROM conversations")
def json_in_text(spark: SparkSession, d: str) -> DataFrame:
    """The first array in a whole answer, parsed; answers with other brackets have none."""
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(' so ["a",\n "'), F.col("role"), F.lit('"] done'))
    found = discovery.first_json(F.when(~F.coalesce("text", F.lit("")).rlike(r"[\[\]]"), answer), "array<string>")
    return parquet(spark, d, "conversations").select("conv_id", "turn", F.try_element_at(found, F.lit(2)).alias("second"))


@R.query(f"WITH {ORGS} SELECT orgid, CASE WHEN orgid % 4 = 3 THEN '' ELSE trim(state) END AS state, CASE WHEN orgid % 4 = 3 THEN '' ELSE country END AS city FROM orgs")
def state_city(spark: SparkSession, d: str) -> DataFrame:
    """State and city from a name that ends in both; every fourth name has none."""
    name = F.when(F.col("orgid") % 4 == 3, F.col("name")).otherwise(F.concat("name", F.lit(" ("), "state", F.lit(", "), "country", F.lit(")")))
    return orgs(spark, d).withColumn("name", name).select("orgid", *[c.alias(k) for k, c in discovery.state_and_city(F.col("name")).items()])


PLACES = [("u.p.", "Lucknow", [], ["#00000001"]), ("nation 1", "First", ["1"], []), ("east of the old river bank", "Bank", [], []), ("machinery", "Works", [], ["7"])]


@R.query(
    f"""WITH {ORGS}, p AS (SELECT orgid, lower(name) AS name, ' ' || trim(regexp_replace(lower(state || ' (U.P.), ' || replace(country, '_', ' ') || CASE WHEN orgid % 5 = 0 THEN ', East of the old river-bank' ELSE '' END), '[^a-z0-9]+', ' ', 'g')) || ' ' AS place FROM orgs)
    SELECT orgid, 'Lucknow' AS rule FROM p WHERE contains(place, ' u p ') AND NOT contains(name, '#00000001') UNION ALL SELECT orgid, 'First' FROM p WHERE contains(place, ' nation 1 ') AND contains(name, '1')
    UNION ALL SELECT orgid, 'Bank' FROM p WHERE contains(place, ' east of the old river bank ') UNION ALL SELECT orgid, 'Works' FROM p WHERE contains(place, ' machinery ') AND NOT contains(name, '7')"""
)
def affiliation_match(spark: SparkSession, d: str) -> DataFrame:
    """Aliases with points, digits and many words against places that write them otherwise."""
    more = F.when(F.col("orgid") % 5 == 0, ", East of the old river-bank").otherwise("")
    place = F.concat("state", F.lit(" (U.P.), "), F.translate("country", "_", " "), more)
    places = spark.createDataFrame(PLACES, "alias string, rule string, need array<string>, bar array<string>")
    return discovery.matched_by_place(orgs(spark, d).withColumn("place", place), places, place="place", name="name", keys=["orgid"])


@R.query(
    r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM conversations), n AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS x FROM w) GROUP BY ALL),
    b AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS n FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.x = b.x GROUP BY ALL)
    SELECT x.conv_id, x.turn, CASE WHEN len(x.w) + len(y.w) = 0 THEN 1.0::DOUBLE ELSE round(2.0 * coalesce(b.n, 0) / (len(x.w) + len(y.w)), 6) END AS ratio FROM w x JOIN w y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 LEFT JOIN b ON b.conv_id = x.conv_id AND b.turn = x.turn"""
)
def text_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike each turn and the next of a conversation are, by their words."""
    c = parquet(spark, d, "conversations")
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return discovery.similar(c.select("conv_id", "turn", "text").join(later, ["conv_id", "turn"]), "text", "next").select("conv_id", "turn", F.round("ratio", 6).alias("ratio"))


# ------------------------------------------------------------------ verdicts and cells


@R.query(
    f"""WITH v AS (SELECT doc_id // 3 AS org, CASE WHEN doc_id % 7 < 2 THEN '{verdicts.NONE_FOUND}' WHEN quality = 0 THEN 'No' WHEN toxic = 1 THEN 'Maybe' ELSE 'Yes' END AS verdict FROM labels),
    n AS (SELECT org, CASE WHEN verdict = '{verdicts.NONE_FOUND}' THEN 'Yes' ELSE verdict END AS v, count(*) AS n FROM v GROUP BY ALL), none AS (SELECT org, bool_and(verdict = '{verdicts.NONE_FOUND}') AS none FROM v GROUP BY org)
    SELECT org, CASE WHEN none THEN '{verdicts.NONE_FOUND}' ELSE arg_max(v, n * 10 + CASE v WHEN 'No' THEN 3 WHEN 'Maybe' THEN 2 ELSE 1 END) END AS verdict FROM n JOIN none USING (org) GROUP BY org, none"""
)
def verdict_ties(spark: SparkSession, d: str) -> DataFrame:
    """Few votes for each organisation, with ties and with organisations where nothing was found."""
    verdict = F.when(F.col("doc_id") % 7 < 2, verdicts.NONE_FOUND).when(F.col("quality") == 0, "No").when(F.col("toxic") == 1, "Maybe").otherwise("Yes")
    return verdicts.majority(parquet(spark, d, "labels").select(F.floor(F.col("doc_id") / 3).alias("org"), verdict.alias("verdict")), "org")


@R.query(
    f"""WITH {ALL_PORTALS}, e AS (SELECT orgid, list(DISTINCT '/x/' || id) AS expected FROM all_portals WHERE status = 'F' GROUP BY orgid), f AS (SELECT orgid, list(portal_url) AS found FROM all_portals WHERE category < '3' GROUP BY orgid),
    h AS (SELECT e.orgid, len(expected) AS expected, len(list_filter(expected, lambda x: len(list_filter(coalesce(found, []), lambda u: contains(u, x))) > 0)) AS hits FROM e LEFT JOIN f USING (orgid)) SELECT orgid, hits, expected, round(hits / expected, 4) AS recall FROM h"""
)
def eval_recall(spark: SparkSession, d: str) -> DataFrame:
    """What share of each organisation's expected strings the found urls contain."""
    p = all_portals(spark, d)
    expected = p.filter("status = 'F'").groupBy("orgid").agg(F.collect_set(F.concat(F.lit("/x/"), "id")).alias("expected"))
    found = p.filter("category < '3'").groupBy("orgid").agg(F.collect_list("portal_url").alias("found"))
    both = expected.join(found, "orgid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return evaluation.recall(both, ["orgid"], "expected", "found")


@R.query(
    f"""WITH {ALL_PORTALS}, a AS (SELECT orgid, list(portal_url ORDER BY category, portal_url) AS p FROM all_portals GROUP BY orgid), b AS (SELECT orgid, list('t' || id ORDER BY id) FILTER (status <> 'P') AS t FROM all_portals GROUP BY orgid)
    SELECT orgid, pos::INTEGER AS pos, p[pos + 1] AS portals, CASE WHEN len(p) = coalesce(len(t), 0) THEN t[pos + 1] ELSE 'N/A' END AS terms FROM a JOIN b USING (orgid), range(0, 1000) r(pos) WHERE pos < len(p)"""
)
def cell_zip(spark: SparkSession, d: str) -> DataFrame:
    """Cells of urls and of terms side by side, where they have as many lines."""
    p = all_portals(spark, d)
    listed = catalog.with_portal_list(p.select("orgid").distinct(), p)
    terms = p.groupBy("orgid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") != "P", F.col("id")))), lambda i: F.concat(F.lit("t"), i.cast("string"))), "\n").alias("terms"))
    return cells.zipped(listed.join(terms, "orgid"), "portals", "terms", ["orgid"])


CLAUSES = keyword_context.Terms(
    strong=["license", "que"], weak=["the", "und", "los"], objects=["copyright", "data"], exempt=["license"], negating=["une", "den "], permissive=[" in "], prohibitive=[" der", "thing"], near=(40, 50, 90),
)


def _clauses_sql(t: keyword_context.Terms) -> str:
    """The terms are single words of which none is part of another, so no coverage needs to carry over.

    Cut at each character that no word has, a text's pieces and their lengths give every word's place.
    """
    order = [(w, s, n) for s, words, n in (("strong", t.strong, t.near[0]), ("weak", t.weak, t.near[1])) for w in sorted(words, key=lambda w: (-len(w), w))]
    words = ", ".join(f"({i}, '{w}', '{s}', {n}, {str(w in t.exempt).upper()})" for i, (w, s, n) in enumerate(order))
    around = lambda c, n: f"substring({c}, greatest(a - {n}, 0) + 1, b + {n} - greatest(a - {n}, 0))"
    return rf"""WITH words(k, word, strength, n, exempt) AS (VALUES {words}), docs AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents),
    tok AS (SELECT doc_id, unnest(s) AS w, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split_regex(low, '[^\pL\pN_-]') AS s FROM docs)),
    pos AS (SELECT doc_id, w, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(w) - 1)::BIGINT AS a FROM tok),
    h AS (SELECT doc_id, k, word, strength, n, exempt, a, a + length(w) AS b, low, t FROM pos JOIN words ON w = word JOIN docs USING (doc_id)),
    c AS (SELECT *, {sql_any(around('low', 'n'), t.negating)} AS neg, {sql_any(around('low', 'n'), t.permissive)} AS perm, {sql_any(around('low', 'n'), t.prohibitive)} AS pro, exempt OR {sql_any(around('low', t.near[2]), t.objects)} AS about FROM h),
    f AS (SELECT *, min(CASE WHEN NOT neg THEN a END) OVER (PARTITION BY doc_id, k) AS first FROM c),
    odd AS (SELECT doc_id, bool_or(strength = 'strong' AND (neg OR perm) AND (first IS NULL OR a <= first)) AS conflict FROM f GROUP BY doc_id),
    m AS (SELECT doc_id, k, word, strength, a, CASE WHEN strength = 'strong' AND about THEN 'prohibitive' WHEN strength = 'strong' THEN 'ambiguous' WHEN perm THEN 'permissive' WHEN pro THEN 'prohibitive' ELSE 'ambiguous' END AS context,
      substring(trim(regexp_replace({around('t', 100)}, '\s+', ' ', 'g')), 1, 200) AS quote FROM f WHERE a = first),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth, word || ' (' || context || ', ' || chr(39) || replace(substring(quote, 1, 80), chr(39), 'ʼ') || chr(39) || ')' AS shown FROM m),
    per AS (SELECT doc_id, count(*) FILTER (strength = 'strong' AND context = 'prohibitive') AS s, count(*) FILTER (strength = 'weak' AND context = 'prohibitive') AS w, bool_or(context = 'ambiguous') AS u,
      string_agg(word || ':' || strength || ':' || context || ':' || a, ',' ORDER BY k) AS found, count(*) || ' matches: ' || string_agg(shown, '; ' ORDER BY k) FILTER (nth <= 3) || CASE WHEN count(*) > 3 THEN ' ...and ' || (count(*) - 3) || ' more' ELSE '' END AS evidence,
      array_to_string(string_split(arg_min(quote, k) FILTER (context = 'prohibitive'), ' ')[1:14], ' ') AS clause FROM r GROUP BY doc_id)
    SELECT doc_id, CASE WHEN s >= 1 OR w >= 2 THEN 'No' WHEN w = 1 OR u THEN 'Maybe' ELSE 'Yes' END AS verdict, CASE WHEN s >= 2 THEN 0.95 WHEN s = 1 THEN 0.8 WHEN w >= 2 THEN 0.7 WHEN w = 1 THEN 0.4 WHEN u THEN 0.35 ELSE 0.9 END::DOUBLE AS confidence,
    coalesce(conflict, FALSE) AS conflict, coalesce(found, '') AS found, CASE WHEN evidence IS NULL THEN 'No restrictive keywords found' WHEN length(evidence) > 500 THEN rtrim(substring(evidence, 1, 497)) || '...' ELSE evidence END AS evidence, coalesce(clause, '') AS clause
    FROM docs LEFT JOIN odd USING (doc_id) LEFT JOIN per USING (doc_id)"""


def _occurrences(texts: DataFrame) -> DataFrame:
    """found as term:strength:context:start, joined."""
    show = lambda m: F.concat_ws(":", m["term"], m["strength"], m["context"], m["start"].cast("string"))
    out = keyword_context.judge(texts, CLAUSES, key="doc_id", text="text")
    return out.select("doc_id", "verdict", "confidence", "conflict", F.array_join(F.transform("found", show), ",").alias("found"), "evidence", "clause")


@R.query(_clauses_sql(CLAUSES))
def keyword_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on whole documents from keywords and their windows, with confidence, conflict, evidence and clause."""
    return _occurrences(parquet(spark, d, "documents").select("doc_id", "text"))


def _letters_sql(n: str, most: int = 4) -> str:
    below = [(26 ** (k + 1) - 26) // 25 for k in range(most + 1)]  # numbers of fewer than k + 1 letters
    cases = [f"WHEN {n} <= {below[k]} THEN " + " || ".join(f"chr(CAST(65 + ({n} - {below[k - 1] + 1}) // {26**j} % 26 AS INTEGER))" for j in range(k - 1, -1, -1)) for k in range(1, most + 1)]
    return "CASE " + " ".join(cases) + " END"


@R.query(f"SELECT p_partkey, {_letters_sql('(p_partkey + 1)')} AS letters FROM part")
def column_letters(spark: SparkSession, d: str) -> DataFrame:
    """Sheet columns by number."""
    return parquet(spark, d, "part").select("p_partkey", sites.column_letter(F.col("p_partkey") + 1).alias("letters"))


# ------------------------------------------------------------------ judgements and metrics joined on


@R.query(
    f"""WITH {CANDIDATES}, m AS (SELECT n_name, 'nation' || n_nationkey || '.com' AS d, n_nationkey AS rank FROM nation) SELECT page_id, host, coalesce(h.score, r.score, 0) AS authority FROM candidates
    LEFT JOIN (SELECT DISTINCT tenant || '.' || root AS host, 7 AS score FROM candidates WHERE root IN ('usp.br', 'college.edu')) h USING (host) LEFT JOIN (VALUES ('uni.ac.in', 5), ('college.edu', 3), ('x.edu.au', 2)) r(root, score) USING (root)"""
)
def authority_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each candidate's host, else of its domain, else zero: one joined table, no lookups."""
    c = candidates(spark, d).withColumn("host", urls.host(F.col("url")))
    known = c.filter(F.col("root").isin("usp.br", "college.edu")).select(F.concat_ws(".", "tenant", "root").alias("name")).distinct().withColumn("score", F.lit(7))
    known = known.unionByName(spark.createDataFrame([("uni.ac.in", 5), ("college.edu", 3), ("x.edu.au", 2)], "name string, score int"))
    return discovery.with_metrics(c, known, host="host", domain="root", into="authority").select("page_id", "host", "authority")


@R.query(
    """WITH j AS (SELECT o_custkey AS org, o_orderkey AS cand FROM orders), c AS (SELECT l_orderkey AS cand, max(l_returnflag) AS verdict FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), f AS (SELECT o_orderkey AS cand, o_orderstatus AS verdict FROM orders WHERE o_totalprice > 200000)
    SELECT org, j.cand, coalesce(c.verdict, f.verdict, '?') AS verdict, CASE WHEN c.verdict IS NOT NULL THEN 'cache' WHEN f.verdict IS NOT NULL THEN 'judge' ELSE 'none' END AS via FROM j LEFT JOIN c USING (cand) LEFT JOIN f USING (cand)"""
)
def merged_judgements(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of candidates: those of the cache first, then a judge's for the rest, else none."""
    o, li = parquet(spark, d, "orders"), parquet(spark, d, "lineitem")
    cached = li.filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("cand")).agg(F.max("l_returnflag").alias("verdict"))
    fresh = o.filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("cand"), F.col("o_orderstatus").alias("verdict"))
    return verdicts.through(o.select(F.col("o_custkey").alias("org"), F.col("o_orderkey").alias("cand")), [("cache", cached), ("judge", fresh)], ["cand"], default="?")


@R.query(
    """WITH base AS (SELECT o_custkey AS org, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'No' WHEN o_orderstatus = 'P' THEN 'Maybe' ELSE 'Yes' END AS verdict, o_totalprice / 500000 AS confidence FROM orders)
    SELECT org, id, CASE WHEN up AND s_name IS NOT NULL THEN CASE WHEN s_acctbal > 0 THEN 'No' ELSE 'Yes' END ELSE verdict END AS verdict, CASE WHEN up AND s_name IS NOT NULL THEN 'second' ELSE 'keyword' END AS via
    FROM (SELECT *, verdict = 'Maybe' OR confidence < 0.2 AS up FROM base) LEFT JOIN supplier ON s_suppkey = id % 200"""
)
def second_opinions(spark: SparkSession, d: str) -> DataFrame:
    """Unclear verdicts and those of little confidence take a second opinion where there is one."""
    o = parquet(spark, d, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "No").when(F.col("o_orderstatus") == "P", "Maybe").otherwise("Yes")
    base = o.select(F.col("o_custkey").alias("org"), F.col("o_orderkey").alias("id"), verdict.alias("verdict"), (F.col("o_totalprice") / 500000).alias("confidence"), (F.col("o_orderkey") % 200).alias("case"))
    said = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("case"), F.when(F.col("s_acctbal") > 0, "No").otherwise("Yes").alias("second"))
    return verdicts.escalated(base, said, ["case"], when=(F.col("verdict") == "Maybe") | (F.col("confidence") < 0.2)).select("org", "id", "verdict", "via")


@R.query(
    """WITH f AS (SELECT c_custkey AS org, max_by(o_orderpriority, o_orderkey) AS level, max(o_orderkey) AS url FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey),
    v AS (SELECT l_orderkey AS url, CASE max(l_returnflag) WHEN 'R' THEN 'No' WHEN 'N' THEN 'Maybe' ELSE 'Yes' END AS verdict FROM lineitem GROUP BY 1)
    SELECT org, coalesce(level, 'none') AS level, CASE WHEN f.url IS NULL THEN 'Yes (No T&C Found)' ELSE coalesce(verdict, 'Maybe') END AS verdict, CASE WHEN f.url IS NULL THEN 0.6 WHEN verdict IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM f LEFT JOIN v USING (url)"""
)
def org_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """One finding for each organisation and its verdict; organisations without a finding get a default row."""
    c, o, li = parquet(spark, d, "customer"), parquet(spark, d, "orders"), parquet(spark, d, "lineitem")
    found = dedup.top(o.filter("o_orderstatus = 'F'"), ["o_custkey"], [F.col("o_orderkey").desc()]).select(F.col("o_custkey").alias("org"), F.col("o_orderpriority").alias("level"), F.col("o_orderkey").alias("url"))
    flag = F.max("l_returnflag")
    judged = li.groupBy(F.col("l_orderkey").alias("url")).agg(F.when(flag == "R", "No").when(flag == "N", "Maybe").otherwise("Yes").alias("verdict"), F.lit(0.9).alias("confidence"))
    return verdicts.per_org(c.select(F.col("c_custkey").alias("org")), found, judged, org="org", url="url").select("org", "level", "verdict", "confidence")


@R.query(
    """WITH q AS (SELECT o_orderkey AS id, o_custkey % 50 AS vendor, o_orderkey % 900 AS url FROM orders), v AS (SELECT s_suppkey AS vendor, 'V' || s_nationkey AS verdict FROM supplier WHERE s_acctbal > 5000), u AS (SELECT c_custkey AS url, 'U' || c_nationkey AS verdict FROM customer WHERE c_acctbal > 2000)
    SELECT id, coalesce(v.verdict, u.verdict, 'S' || url % 3) AS verdict, CASE WHEN v.verdict IS NOT NULL THEN 'vendor' WHEN u.verdict IS NOT NULL THEN 'url' ELSE 'scored' END AS via FROM q LEFT JOIN v USING (vendor) LEFT JOIN u USING (url)"""
)
def verdict_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The vendor's cached verdict, else the url's, else a score of the page for what both lack."""
    q = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("vendor"), (F.col("o_orderkey") % 900).alias("url"))
    vendor = parquet(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("vendor"), F.concat(F.lit("V"), "s_nationkey").alias("verdict"))
    url = parquet(spark, d, "customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("url"), F.concat(F.lit("U"), "c_nationkey").alias("verdict"))
    return verdicts.cascade(q, [("vendor", vendor, ["vendor"]), ("url", url, ["url"])], scored=F.concat(F.lit("S"), F.col("url") % 3)).select("id", "verdict", "via")


# ------------------------------------------------------------------ ids, sheets, anchors and wrapped links


@R.query("SELECT c_custkey, c_custkey || CASE WHEN c_custkey % 3 = 1 THEN '.5' ELSE '' END AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS first FROM customer")
def id_cells(spark: SparkSession, d: str) -> DataFrame:
    """Ids as sheets show them, and the first filled one of several cells."""
    key = F.col("c_custkey")
    shown = F.concat(F.lit(" "), key, F.when(key % 3 == 1, ".5").otherwise(".0"))
    return parquet(spark, d, "customer").select("c_custkey", text.id_text(shown).alias("id"), text.first_filled(F.when(key % 2 == 0, F.concat(F.lit(" "), "c_name")), F.lit("  "), F.col("c_mktsegment")).alias("first"))


@R.query("SELECT s_suppkey AS id, NULL::VARCHAR AS email, 'sup' AS orgid, NULL::INTEGER AS result_count FROM supplier UNION ALL SELECT n_nationkey, n_name, 'nat', n_regionkey::INTEGER FROM nation")
def appended_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two shapes appended to one table of a catalogue's schema."""
    at, schema = tables.scratch(spark, "log"), tables.SCHEMAS["search_log"]
    tables.append(parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("sup").alias("orgid")), at, schema)
    tables.append(parquet(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("email"), F.lit("nat").alias("orgid"), F.col("n_regionkey").alias("result_count")), at, schema)
    return spark.read.schema(schema).parquet(at).select("id", "email", "orgid", "result_count")


@R.query(
    f"""WITH {ALL_PORTALS}, h AS (SELECT *, regexp_extract(portal_url, '://([^/]*)', 1) AS host FROM all_portals), a AS (SELECT orgid, list(portal_url) FILTER (status = 'F') AS u, list(host) FILTER (status = 'F') AS h, list(portal_url) FILTER (status = 'O') AS tu, list(host) FILTER (status = 'O') AS th FROM h GROUP BY orgid)
    SELECT orgid, coalesce(list_has_any(u, tu), FALSE) OR coalesce(list_has_any(h, th), FALSE) AS matched FROM a"""
)
def truth_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether any found url, or else any found host, of an organisation is a true one."""
    url, h = F.col("portal_url"), urls.host(F.col("portal_url"))
    lists = lambda s: [F.collect_list(F.when(F.col("status") == s, x)) for x in (url, h)]
    (u, hosts), (tu, th) = lists("F"), lists("O")
    out = all_portals(spark, d).groupBy("orgid").agg(u.alias("u"), hosts.alias("h"), tu.alias("tu"), th.alias("th"))
    return out.select("orgid", evaluation.matches(F.col("u"), F.col("tu"), F.col("h"), F.col("th")).alias("matched"))


@R.query(rf"""WITH {LINKS}, k AS (SELECT page_id, pos, href, trim(regexp_replace(trim(lower(text)), '[.,;:!?_>»→•·-]+$', '')) AS key FROM linked) SELECT page_id, pos, key, key IN ({', '.join(repr(x) for x in sites.PORTAL_TEXTS)}) OR (key = 'portal' AND regexp_matches(href, '(?i)/login|/portal')) AS portal FROM k""")
def portal_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Which links of a page are named like a portal."""
    found = links.page_links(candidates(spark, d))
    return found.select("page_id", "pos", sites.anchor_key(F.col("text")).alias("key"), sites.portal_anchor(F.col("text"), F.col("href")).alias("portal"))


@R.query(f"WITH {CANDIDATES} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '/l/?x=' || page_id END AS target FROM candidates")
def unwrapped_links(spark: SparkSession, d: str) -> DataFrame:
    """The targets of redirect links; other links stay."""
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/l/?uddg="), F.url_encode("url"), F.lit("&r=1"))).otherwise(F.concat(F.lit("/l/?x="), "page_id"))
    return candidates(spark, d).select("page_id", urls.unwrapped(link).alias("target"))


@R.query(f"WITH {ALL_PORTALS} SELECT id, orgid FROM all_portals WHERE orgid NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000)")
def active_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose organisation is in no list of inactive ones."""
    inactive = parquet(spark, d, "supplier").filter("s_acctbal < 3000").select(F.col("s_suppkey").alias("orgid"))
    return dedup.not_in(all_portals(spark, d), inactive, ["orgid"]).select("id", "orgid")


@R.query(rf"""WITH {CANDIDATES} SELECT page_id, contains(host, '.ac.') OR {' OR '.join(f"ends_with(host, '{s}')" for s in sites.ACADEMIC_SUFFIXES)} OR regexp_matches(title, '(?i)university|college|on') AS academic FROM candidates""")
def vendor_guard(spark: SparkSession, d: str) -> DataFrame:
    """Sites that look like an organisation's own and not like a vendor's: by host, or by the words of their title."""
    return candidates(spark, d).select("page_id", sites.own_site(urls.host(F.col("url")), F.col("title"), "(?i)university|college|on").alias("academic"))
