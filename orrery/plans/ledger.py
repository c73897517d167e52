"""The discovery of portals for organisations as one ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import rules, sites, urls
from orrery.operators import discovery, gates, ledger, structure
from orrery.plans.roles import CANDIDATES, Registry, candidates, pages, sql_any, sql_first, sql_list, sql_points, sql_under
from orrery.plans.structure import _HEADS, NAMES_SQL, STAFF_HEADINGS, STAFF_NAMES, STUDENT_HEADINGS, STUDENT_NAMES, WORDS_SQL

R = Registry()
POLICY = ledger.Policy(
    shared=["knimbus.com", "talentlms.com", "mastersofterp.in"], blocked=["samarth.ac.in"], state_platforms={"Bihar": ["bihar-ums.com"], "Assam": ["ucanapply.com"]},
    labels=["portal", "lms", "erp", "exam", "fees", "library", "www", "admissions", "hostel", "placement", "sso", "students"],
)
BLOCK = 35  # pages whose candidates are harvested for one organisation
LINKED = ["portal", "lms", "erp", "exam", "fees", "mail", "records"]
CATEGORIES = [("lms", ["moodle", "lms", "campus"]), ("fees", ["fee"]), ("exam", ["exam", "coe"]), ("library", ["library", "koha"])]


def organisations(spark: SparkSession, d: str) -> DataFrame:
    """An organisation for one page of each block of BLOCK: its names and domains are made of the page's host."""
    p = pages(spark, d).filter(F.col("page_id") % BLOCK == 3)
    name = F.substring_index(urls.host(F.col("url")), ".", 1)
    own, n = F.concat(name, F.lit(".uni.ac.in")), F.length(name)
    none = F.array().cast("array<string>")
    return p.select(
        F.floor(F.col("page_id") / BLOCK).alias("orgid"), F.when(n % 3 == 0, F.concat(name, F.lit(".usp.br"))).otherwise(own).alias("primary"), F.array(F.concat(name, F.lit(".college.edu"))).alias("domains"),
        F.when(n % 2 == 0, F.array(F.concat(name, F.lit(".mastersofterp.in")))).otherwise(none).alias("extra_domains"), F.array(F.lit("records")).alias("extra_labels"), F.array(F.lit("x.edu.au")).alias("extra_roots"),
        F.element_at(F.array(F.lit("Bihar"), F.lit("Assam"), F.lit(None).cast("string")), (n % 3 + 1).cast("int")).alias("state"), F.when(n % 4 == 0, F.array(name)).otherwise(none).alias("exact"),
        F.when(n % 3 != 1, F.array(F.substring(name, 1, 5))).otherwise(none).alias("auto"), F.substring(name, 1, 4).alias("acronym"), F.array(*[F.concat(F.lit(f"{x}."), name, F.lit(".x.edu.au")) for x in LINKED]).alias("anchored"),
    )


ORGANISATIONS = f"""named AS (SELECT page_id // {BLOCK} AS orgid, split_part(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', ''), '.', 1) AS name FROM pages WHERE page_id % {BLOCK} = 3),
organisations AS (SELECT orgid, CASE WHEN length(name) % 3 = 0 THEN name || '.usp.br' ELSE name || '.uni.ac.in' END AS main, name || '.college.edu' AS domain, CASE WHEN length(name) % 2 = 0 THEN name || '.mastersofterp.in' END AS extra,
  (['Bihar', 'Assam', NULL])[length(name) % 3 + 1] AS state, CASE WHEN length(name) % 4 = 0 THEN [name] ELSE [] END AS exact, CASE WHEN length(name) % 3 <> 1 THEN [left(name, 5)] ELSE [] END AS auto, left(name, 4) AS acronym, list_transform({sql_list(LINKED)}, lambda x: x || '.' || name || '.x.edu.au') AS anchored FROM named)"""


def harvested(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate for the organisation of its page's block, with what its page shows. A third of the tenants recruit."""
    c = candidates(spark, d).filter("page_id IS NOT NULL")
    c = c.withColumn("url", F.when(F.col("page_id") % 3 == 1, F.replace("url", F.lit(".samarth.edu.in"), F.lit("rec.samarth.edu.in"))).otherwise(F.col("url")))
    shown = structure.structured(c, keep=("page_id", "url", "root"))
    found, url = F.col("elements"), F.col("url")
    who = gates.audience(structure.headings(found, F.col("text")), structure.control_names(found), others=STAFF_HEADINGS, students=STUDENT_HEADINGS, other_names=STAFF_NAMES, student_names=STUDENT_NAMES)
    password = F.exists(found, lambda e: (e["tag"] == "input") & (F.lower(structure.attribute(e, "type")) == "password"))
    category = rules.first_of([(rules.contains_any(F.lower(url), words), name) for name, words in CATEGORIES], "other")
    rows = shown.select(F.col("page_id").alias("pos"), F.floor((F.col("page_id") % 2**40) / BLOCK).alias("orgid"), "url", urls.host(url).alias("host"), category.alias("category"), password.alias("password"), (F.col("root") == "knimbus.com").alias("bypass"), who.alias("audience"))
    rows = rows.join(organisations(spark, d), "orgid")
    return rows.withColumn("score", discovery.candidate_score(F.col("url"), F.col("password"), F.col("primary")))


def before() -> list[tuple[str, F.Column]]:
    """The stages that a page's url and body decide."""
    url = F.col("url")
    return [
        ("prefilter", F.when(sites.login_subpage(url), F.lit("page beside a login")).when(sites.error_url(url), F.lit("error page")).when(sites.legal_page(url), F.lit("legal page"))),
        ("sign-in", F.when(sites.generic_sso(url) | sites.webmail(url), F.lit("shared sign-in"))),
        ("audience", F.when(F.col("audience") == "non_student", F.lit("not for students"))),
    ]


_TENANTS = [*POLICY.tenant_roots, *POLICY.all_states]
_STRIP = r"CASE WHEN starts_with({h}, {p}) AND length({h}) > length({p}) THEN substr({h}, length({p}) + 1) END"
_REC = "CASE WHEN page_id % 3 = 1 THEN replace({0}, '.samarth.edu.in', 'rec.samarth.edu.in') ELSE {0} END"
HARVESTED = rf"""{CANDIDATES}, {ORGANISATIONS},
shown AS (SELECT page_id, root, html, low, path, {_REC.format('url')} AS url, {_REC.format('authority')} AS authority, {_REC.format('host')} AS host, lower(array_to_string(list_filter(flatten([{_HEADS}]), lambda x: x <> ''), ' ')) AS head, flatten(list_transform({NAMES_SQL}, lambda n: {WORDS_SQL})) AS words FROM candidates),
rows AS (SELECT page_id AS pos, (page_id % 1099511627776) // {BLOCK} AS orgid, url, host, authority, path, lower(path) AS p, {sql_first([(sql_any('lower(url)', words), name) for name, words in CATEGORIES], 'other')} AS category,
  regexp_matches(html, '(?i)<input[^>]*type=["'']?password') AS password, root = 'knimbus.com' AS bypass,
  {sql_first([(f"{sql_any('head', STAFF_HEADINGS)} OR list_has_any(words, {sql_list(STAFF_NAMES)})", 'non_student')], 'other')} AS audience FROM shown),
joined AS (SELECT *, {sql_points([(sql_any('p', ['login', 'signin', 'sign-in', 'auth']), 3), ('password', 2), ('host = main', 1), ("len(list_filter(string_split(p, '/'), lambda s: s <> '')) <= 2", 1)])}
  + 5 * len(list_filter(['student'], lambda w: contains(p, w))) - 10 * len(list_filter(['staff', 'admin'], lambda w: contains(p, w))) AS score,
  CASE state WHEN 'Bihar' THEN ['bihar-ums.com'] WHEN 'Assam' THEN ['ucanapply.com'] ELSE [] END AS own FROM rows JOIN organisations USING (orgid)),
rooted AS (SELECT *, list_filter(list_concat(own, {sql_list(POLICY.tenant_roots)}), lambda r: host = r OR ends_with(host, '.' || r))[1] AS on_root, list_filter({sql_list(_TENANTS)}, lambda r: host = r OR ends_with(host, '.' || r))[1] AS any_root,
  list_filter({sql_list(POLICY.all_states)}, lambda r: NOT list_contains(own, r) AND (host = r OR ends_with(host, '.' || r))) AS others,
  list_filter(list_concat([main, domain], CASE WHEN extra IS NULL THEN [] ELSE [extra] END), lambda r: host = r OR ends_with(host, '.' || r))[1] AS mine,
  list_distinct(list_concat(CASE WHEN len(exact) > 0 THEN exact ELSE auto END, CASE WHEN length(acronym) >= 4 AND acronym NOT IN ({', '.join(repr(x) for x in POLICY.ambiguous)}) THEN [acronym] ELSE [] END)) AS names,
  list_distinct(list_concat(exact, list_filter(auto, lambda s: NOT list_contains({sql_list(POLICY.ambiguous)}, s)), CASE WHEN acronym NOT IN ({', '.join(repr(x) for x in POLICY.ambiguous)}) THEN [acronym] ELSE [] END)) AS siblings,
  split_part(regexp_extract(host, '([^.]+\.(?:{'|'.join(s.replace('.', '[.]') for s in urls.SUFFIXES)})|[^.]+\.[^.]+)$', 1), '.', 1) AS base, list_filter([main, domain], lambda r: host = r OR ends_with(host, '.' || r))[1] AS strict FROM joined),
cut AS (SELECT *, left(host, greatest(length(host) - length(on_root) - 1, 0)) AS prefix, string_split(left(host, greatest(length(host) - length(any_root) - 1, 0)), '.')[-1] AS tenant,
  list_filter(string_split(left(host, greatest(length(host) - length(strict) - 1, 0)), '.'), lambda x: x <> '') AS labels,
  CASE regexp_extract(host, '([^.]*)$', 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in urls.COUNTRIES.items())} END AS there, CASE regexp_extract(main, '([^.]*)$', 1) WHEN 'in' THEN 'India' WHEN 'br' THEN 'Brazil' END AS here FROM rooted),
ruled AS (SELECT *, {sql_first([
    ("len(others) > 0", "platform of another state"), ("host = on_root", "bare platform"), ("on_root IS NOT NULL AND len(names) = 0", "no names for the tenant"),
    (f"on_root IS NOT NULL AND list_has_any(names, list_concat([prefix, string_split(prefix, '.')[-1]], list_transform({sql_list(POLICY.prefixes)}, lambda f: {_STRIP.format(h='prefix', p='f')})))", "tenant"),
    ("on_root IS NOT NULL AND len(list_filter(names, lambda s: length(s) >= 4 AND contains(prefix, s))) > 0", "name within the tenant"), ("on_root IS NOT NULL", "another tenant"), ("host = mine", "own domain"), ("mine IS NOT NULL", "below an own domain"),
    ("list_contains(anchored, host)", "linked from the home page"), ("len(list_filter(siblings, lambda s: length(s) >= 4 AND (starts_with(base, s) OR contains(host, '.' || s || '.')))) > 0", "name in the domain"), (sql_under('host', POLICY.shared), "shared platform"),
  ], 'mismatch')} AS rule_name FROM cut)"""
_OK = ["tenant", "name within the tenant", "own domain", "below an own domain", "linked from the home page", "name in the domain", "shared platform"]
_OFFENDS = f"NOT list_contains({sql_list([*POLICY.labels, 'records'])}, x) AND (len(list_filter({sql_list(POLICY.college_words)}, lambda w: contains(x, w))) > 0 OR (length(x) BETWEEN 3 AND 6 AND regexp_matches(x, '[a-z]')))"


@R.query(f"WITH {HARVESTED} SELECT pos, orgid, host, rule_name AS membership, rule_name IN ({', '.join(repr(x) for x in _OK)}) AS belongs FROM ruled")
def org_membership(spark: SparkSession, d: str) -> DataFrame:
    """By which rule each candidate's host belongs to its organisation, or doesn't."""
    return ledger.membership(harvested(spark, d), POLICY).select("pos", "orgid", "host", F.col("member.rule").alias("membership"), F.col("member.ok").alias("belongs"))


@R.query(
    rf"""WITH {HARVESTED}, legal AS (SELECT pos FROM ruled WHERE path IN ('/terms-of-use', '/privacy-policy')),
    judged AS (SELECT *, CASE WHEN regexp_matches(p, '{sites.SUBPAGES}') THEN 'prefilter|page beside a login' WHEN {sql_any('p', sites.ERROR_PATHS)} THEN 'prefilter|error page' WHEN pos IN (SELECT pos FROM legal) THEN 'prefilter|legal page'
      WHEN split_part(host, '.', 1) IN ({', '.join(repr(x) for x in sites.MAIL_LABELS)}) OR ends_with(split_part(host, '.', 1), 'mail') THEN 'sign-in|shared sign-in'
      WHEN audience = 'non_student' THEN 'audience|not for students'
      WHEN {sql_any('p', sites.ADMIN_PATHS)} THEN 'admin page|admin path' WHEN {sql_under('host', POLICY.blocked)} THEN 'blocklist|blocked host'
      WHEN any_root IS NOT NULL AND len(list_filter({sql_list(POLICY.other_tenants)}, lambda s: ends_with(tenant, s))) > 0 THEN 'other tenant|tenant not for students'
      WHEN there <> here THEN 'country|' || there || ' for ' || here
      WHEN host = main AND rtrim(p, '/') IN ({', '.join(repr(x) for x in ledger.HOME_PATHS)}) AND NOT password THEN 'home page|home page without login'
      WHEN NOT (bypass AND any_root IS NULL) AND rule_name NOT IN ({', '.join(repr(x) for x in _OK)}) THEN 'membership|' || rule_name
      WHEN password AND ends_with(host, '.' || main) AND {sql_any('p', ledger.STRONG_PATHS)} THEN NULL
      WHEN {sql_under('host', POLICY.shared)} OR {sql_under('host', ['x.edu.au'])} THEN NULL WHEN strict IS NULL THEN 'labels|off domain'
      WHEN len(list_filter(labels, lambda x: {_OFFENDS})) > 0 THEN 'labels|labels: ' || array_to_string(list_filter(labels, lambda x: {_OFFENDS}), ',') END AS verdict FROM ruled),
    best AS (SELECT *, row_number() OVER (PARTITION BY orgid, authority, category, verdict IS NULL ORDER BY score DESC, length(rtrim(path, '/')), pos DESC) AS n FROM judged)
    SELECT pos, orgid, host, category, score, CASE WHEN verdict IS NULL AND n > 1 THEN 'duplicate' ELSE nullif(split_part(verdict, '|', 1), '') END AS stage,
      CASE WHEN verdict IS NULL AND n > 1 THEN 'better one of its host and category' ELSE nullif(split_part(verdict, '|', 2), '') END AS reason FROM best"""
)
def discovery_ledger(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of all organisations, each with the first stage that rejects it and why, or neither."""
    return ledger.consolidated(harvested(spark, d), POLICY, before()).select("pos", "orgid", "host", "category", "score", "stage", "reason")
