"""Queries over the structure of pages: their elements, main parts, footers, links in context and login forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import rules, sites
from orrery.operators import dedup, discovery, gates, grams, links, structure
from orrery.plans.roles import CANDIDATES, Registry, candidates, sql_any, sql_first, sql_list, sql_points
from orrery.sources.tables import parquet, scratch

R = Registry()

# What names an audience in headings, in names of controls and in fields.
STAFF_HEADINGS = ["staff login", "admin login", "admin portal", "faculty", "employee", "vendor", "recruitment", "alumni", "intranet"]
STUDENT_HEADINGS = ["student login", "students login", "learner login", "candidate login", "student portal"]
STAFF_NAMES = ["admin", "administrator", "administration", "staff", "employee", "faculty", "teacher", "principal", "vendor", "recruiter", "recruitment", "hr", "humanresources", "alumni"]
STUDENT_NAMES = ["student", "students", "learner", "candidate"]
OTHER_FIELDS = ["from no", "form no", "challan no", "challan number", "application no", "application number", "token no", "token number", "dd number", "demand draft", "transaction id", "transaction number"]
IDENTITY_FIELDS = [
    "enrollment number", "enrolment number", "roll number", "roll no", "roll no.", "student id", "student code", "student no", "registration number", "reg no", "reg. no", "university id", "university roll", "admission number",
    "scholar number", "prn number", "prn no", "form number", "username", "user id", "user name", "mobile number", "email", "employee id", "bar code", "barcode", "sol roll", "sol id", "id card", "id no", "exam roll", "htno",
    "hall ticket no", "hall ticket number", "seat no", "seat number", "lib id", "library id", "admission no", "scholar no",
]
CONTEXT = ["student", "students", "enrolled", "enrollment", "enrolment", "academic", "semester", "session", "college", "department", "faculty", "programme", "course"]


def pages(spark: SparkSession, d: str) -> DataFrame:
    return structure.structured(candidates(spark, d), keep=("page_id", "url"))


def _pieces(html: str, between: str = " ") -> str:
    """SQL of the texts between tags, joined."""
    plain = "replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
    return rf"array_to_string(list_filter(list_transform(regexp_split_to_array({html}, '<[^>]*>'), lambda t: regexp_replace({plain}, '^\s+|\s+$', '', 'g')), lambda t: t <> ''), '{between}')"


SHOWN = rf"""{CANDIDATES}, shown AS (SELECT page_id, url, html, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '<x>', 'g') AS bare FROM candidates)"""


@R.query(
    rf"""WITH {CANDIDATES}, tags AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)(<script[^>]*>).*?</script>|<!--.*?-->', '\1', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM candidates)
    SELECT page_id, lower(tag) AS tag, count(*) AS n FROM tags GROUP BY page_id, lower(tag)"""
)
def page_elements(spark: SparkSession, d: str) -> DataFrame:
    """How many elements of each tag a page has."""
    return structure.elements(candidates(spark, d)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@R.query(rf"WITH {SHOWN} SELECT page_id, md5({_pieces('bare')}) AS text_md5 FROM shown")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of each page, its parts joined by spaces."""
    return pages(spark, d).select("page_id", F.md5(F.replace("text", F.lit(structure.SEP), F.lit(" "))).alias("text_md5"))


@R.query(
    rf"""WITH {CANDIDATES}, t AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>|<form(?:\s[^>]*)?>.*?</form>', '<x>', 'g') AS x FROM candidates),
    m AS (SELECT page_id, {_pieces("regexp_extract(x, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS article, {_pieces("CASE WHEN contains(x, '<body') THEN regexp_extract(x, '(?is)<body[^>]*>(.*)', 1) ELSE x END")} AS body FROM t)
    SELECT page_id, md5(trim(regexp_replace(CASE WHEN length(article) >= 100 THEN article ELSE body END, '\s+', ' ', 'g'))) AS text_md5 FROM m"""
)
def main_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of a page's main part, without navigation, footers and small forms."""
    return pages(spark, d).select("page_id", F.md5(structure.main_text(F.col("elements"), F.col("content"))).alias("text_md5"))


ANCHOR = r"""(?is)(<(?:li|div)>)?([^<>]*)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>"""
#: Links in order, their text and that of the block around them.
LINKED = rf"""{SHOWN}, raw AS (SELECT page_id, url, unnest(range(len(regexp_extract_all(bare, '{ANCHOR}', 0)))) AS pos, unnest(regexp_extract_all(bare, '{ANCHOR}', 1)) AS block, unnest(regexp_extract_all(bare, '{ANCHOR}', 2)) AS before,
  unnest(regexp_extract_all(bare, '{ANCHOR}', 3)) AS href, unnest(regexp_extract_all(bare, '{ANCHOR}', 4)) AS inner_html FROM shown),
linked AS (SELECT page_id, url, pos::INTEGER AS pos, href, {_pieces('inner_html', '')} AS text, CASE WHEN coalesce(block, '') = '' THEN '' ELSE trim(before) || {_pieces('inner_html', '')} END AS parent FROM raw)"""
STUDENT_SQL = sql_points([
    (sql_any("b", discovery.STUDENT_PHRASES), 3), ("contains(b, 'student')", 2), (sql_any("b", discovery.PLATFORM_WORDS) + " AND contains(lower(parent), 'student')", 2), (sql_any("b", discovery.LOGIN_WORDS), 1),
    (sql_any("b", discovery.STAFF_WORDS), -2), (sql_any("b", discovery.OTHER_WORDS), -3),
])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    found = structure.links_in_context(pages(spark, d))
    return found.withColumn("score", discovery.student_anchor_score(F.col("href"), F.col("text"), F.col("parent_text")))


@R.query(f"WITH {LINKED} SELECT page_id, pos, parent, {STUDENT_SQL} AS score FROM (SELECT *, lower(href || ' ' || text) AS b FROM linked)")
def anchor_scores(spark: SparkSession, d: str) -> DataFrame:
    """How likely each link of each page leads to a student's portal, by its text and that of the block around it."""
    return _scored(spark, d).select("page_id", "pos", F.col("parent_text").alias("parent"), "score")


@R.query(
    rf"""WITH {LINKED}, s AS (SELECT *, {STUDENT_SQL} AS score FROM (SELECT *, lower(href || ' ' || text) AS b FROM linked) WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(#|mailto:|tel:|javascript:)')),
    once AS (SELECT page_id, href, max(score) AS score, arg_min(pos, (-score, pos)) AS pos FROM s WHERE score >= 2 GROUP BY page_id, href)
    SELECT page_id, nth::INTEGER AS nth, href, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS nth FROM once) WHERE nth <= 3"""
)
def best_links(spark: SparkSession, d: str) -> DataFrame:
    """The three best links of a page for students, of two points or more, each target once."""
    scored = _scored(spark, d).filter("score >= 2").filter((F.col("href") != "") & ~F.col("href").rlike("(?i)^(#|mailto:|tel:|javascript:)"))
    order = [F.col("score").desc(), F.col("pos")]
    return dedup.top(dedup.top(scored, ["page_id", "href"], order), ["page_id"], order, 3, "nth").select("page_id", "nth", "href", "score")


FOOTER_SQL = LINKED.replace("FROM shown)", "FROM (SELECT page_id, url, CASE WHEN contains(bare, '<footer') THEN regexp_extract(bare, '(?is)<footer[^>]*>.*?</footer>', 0) ELSE regexp_extract(bare, '(?is)<div id=\"site-footer-links\".*', 0) END AS bare FROM shown))", 1)


@R.query(
    rf"""WITH {FOOTER_SQL}, l AS (SELECT *, CASE WHEN contains(b, 'terms') THEN 3 WHEN contains(b, 'privacy') THEN 2 WHEN {sql_any('b', sites.LEGAL_TEXTS)} THEN 1 ELSE 0 END AS said, ends_with(lower(href), '.pdf') AS pdf FROM (SELECT *, lower(text) AS b FROM linked)),
    s AS (SELECT *, CASE WHEN pdf AND said > 0 THEN said + 1 WHEN pdf THEN 2 ELSE said END AS score FROM l)
    SELECT page_id, href, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS n FROM s WHERE score > 0) WHERE n = 1"""
)
def footer_links(spark: SparkSession, d: str) -> DataFrame:
    """The best link of each footer that names a policy: terms before privacy before others; documents a point more."""
    found = structure.links_in_context(pages(spark, d), within=structure.footer)
    low = F.lower("text")
    said = F.when(low.contains("terms"), 3).when(low.contains("privacy"), 2).when(rules.contains_any(low, sites.LEGAL_TEXTS), 1).otherwise(0)
    pdf = F.lower(F.substring_index(F.substring_index("href", "#", 1), "?", 1)).endswith(".pdf")
    score = F.when(pdf & (said > 0), said + 1).when(pdf, 2).otherwise(said)
    return dedup.top(found.withColumn("score", score).filter("score > 0"), ["page_id"], [F.col("score").desc(), F.col("pos")]).select("page_id", "href", "score")


@R.query(
    rf"""WITH {SHOWN}, f AS (SELECT page_id, CASE WHEN contains(bare, '<footer') THEN regexp_extract(bare, '(?is)<footer[^>]*>.*?</footer>', 0) ELSE regexp_extract(bare, '(?is)<div id="site-footer-links".*', 0) END AS f FROM shown), t AS (SELECT page_id, {_pieces('f')} AS said FROM f)
    SELECT page_id, said, trim(regexp_extract(said, '(?i)developed by ([A-Za-z][A-Za-z0-9_ .&''-]{{2,40}})', 1)) AS maker FROM t"""
)
def footer_texts(spark: SparkSession, d: str) -> DataFrame:
    """What each page's footer says, and who made the site by it."""
    said = F.coalesce(structure.text_of(structure.footer(F.col("elements")), F.col("text")), F.lit(""))
    return pages(spark, d).select("page_id", said.alias("said")).select("page_id", "said", sites.maker(F.col("said")).alias("maker"))


CONTROL = r"""(?i)<(?:form|input)(?:\s[^>]*)?>"""
NAMES_SQL = rf"""list_filter(flatten(list_transform(regexp_extract_all(html, '{CONTROL}'), lambda t: [regexp_extract(t, '(?i)\sname=["'']([^"'']*)["'']', 1), regexp_extract(t, '(?i)\sid=["'']([^"'']*)["'']', 1)])), lambda n: n <> '')"""
WORDS_SQL = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(n, '([a-z])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '[$-]', '_', 'g')), '_'), lambda w: w <> '')"


@R.query(rf"WITH {CANDIDATES}, f AS (SELECT page_id, unnest({NAMES_SQL}) AS n FROM candidates) SELECT page_id, n AS name, array_to_string({WORDS_SQL}, ' ') AS words FROM f")
def label_words(spark: SparkSession, d: str) -> DataFrame:
    """Names and ids of the pages' controls, taken apart into words."""
    names = pages(spark, d).select("page_id", F.explode(structure.control_names(F.col("elements"))).alias("name"))
    return names.select("page_id", "name", F.array_join(discovery.label_tokens(F.col("name")), " ").alias("words"))


_HEADS = ", ".join(f"list_transform(regexp_extract_all(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)[1:{most}], lambda h: {_pieces('h', '')})" for tag, most in (("title", 1), ("h1", 3), ("h2", 3), ("h3", 3)))


@R.query(
    rf"""WITH {CANDIDATES}, h AS (SELECT page_id, lower(array_to_string(list_filter(flatten([{_HEADS}]), lambda x: x <> ''), ' ')) AS head, flatten(list_transform({NAMES_SQL}, lambda n: {WORDS_SQL})) AS words FROM candidates)
    SELECT page_id, {sql_first([(f"{sql_any('head', STAFF_HEADINGS)} OR list_has_any(words, {sql_list(STAFF_NAMES)})", 'non_student'), (f"{sql_any('head', STUDENT_HEADINGS)} OR list_has_any(words, {sql_list(STUDENT_NAMES)})", 'student')], 'ambiguous')} AS audience FROM h"""
)
def login_audiences(spark: SparkSession, d: str) -> DataFrame:
    """Whom a page is for, by its title, headings and controls."""
    found = F.col("elements")
    who = gates.audience(structure.headings(found, F.col("text")), structure.control_names(found), others=STAFF_HEADINGS, students=STUDENT_HEADINGS, other_names=STAFF_NAMES, student_names=STUDENT_NAMES)
    return pages(spark, d).select("page_id", who.alias("audience"))


_ATTRIBUTES = ", ".join(rf"""regexp_extract(t, '(?i)\s{a}=["'']([^"'']*)["'']', 1)""" for a in structure.FIELD_NAMES)
_INNER = r"[^<]|</?label[^>]*>|<input[^>]*>"
FIELD_SQL = rf"""{SHOWN}, inputs AS (SELECT page_id, html, {_pieces('bare')} AS whole, regexp_extract_all(html, '(?i)<input(?:\s[^>]*)?>') AS inputs FROM shown),
typed AS (SELECT *, list_filter(inputs, lambda t: NOT list_contains({sql_list(structure.NOT_PRIMARY)}, lower(regexp_extract(t, '(?i)\stype=["'']?([^"''\s>]*)', 1))))[1] AS t FROM inputs),
said AS (SELECT page_id, html, whole, inputs, CASE WHEN t IS NULL THEN '' ELSE lower(array_to_string(list_filter([{_ATTRIBUTES},
  CASE WHEN regexp_matches(t, '\sid="') THEN regexp_extract(html, '<label for="' || regexp_extract(t, '\sid="([^"]*)"', 1) || '">(.*?)</label>', 1) ELSE '' END,
  {_pieces(f"regexp_extract(html, '(?is)<(?:form|div)(?:[ ][^>]*)?>((?:{_INNER})*<input[^>]*>(?:{_INNER})*)</(?:form|div)>', 1)")}[1:100]], lambda v: v <> ''), ' ')) END AS primary_said FROM typed)"""


@R.query(f"WITH {FIELD_SQL} SELECT page_id, primary_said AS said FROM said")
def primary_fields(spark: SparkSession, d: str) -> DataFrame:
    """What pages say about the first field that one types into."""
    return pages(spark, d).select("page_id", structure.primary_field(F.col("elements"), F.col("text")).alias("said"))


def _first_word(c: str, words: list[str]) -> str:
    return f"list_filter({sql_list(words)}, lambda w: contains({c}, w))[1]"


@R.query(
    rf"""WITH {FIELD_SQL}, fields AS (SELECT page_id, primary_said, lower(whole) AS body, lower(array_to_string(list_filter(list_concat(regexp_extract_all(html, '(?is)<label[^>]*>(.*?)</label>', 1), flatten(list_transform(inputs, lambda t: [{_ATTRIBUTES}]))), lambda v: v <> ''), ' ')) AS fields FROM said),
    found AS (SELECT page_id, body, {_first_word('primary_said', OTHER_FIELDS)} AS o, {_first_word('fields', IDENTITY_FIELDS)} AS i, {_first_word('body', CONTEXT)} AS c, len(list_filter({sql_list(CONTEXT)}, lambda w: contains(body, w))) AS n FROM fields)
    SELECT page_id, CASE WHEN o IS NOT NULL THEN 'non_student' WHEN i IS NOT NULL THEN 'student' WHEN body = '' THEN 'ambiguous' WHEN n >= 2 THEN 'student' ELSE 'non_student' END AS verdict,
      CASE WHEN o IS NOT NULL THEN 'primary field: ' || o WHEN i IS NOT NULL THEN 'identity field: ' || i WHEN body = '' THEN 'no text' WHEN n >= 2 THEN 'context: ' || c ELSE 'no identity field or context' END AS reason FROM found"""
)
def form_audiences(spark: SparkSession, d: str) -> DataFrame:
    """Whom the pages' forms are for, by their fields, and why."""
    who = structure.form_audience(F.col("elements"), F.col("text"), others=OTHER_FIELDS, identity=IDENTITY_FIELDS, context=CONTEXT)
    return pages(spark, d).select("page_id", who.alias("w")).select("page_id", "w.verdict", "w.reason")


@R.query(
    r"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS pattern FROM pages)
    SELECT pattern, count(*) AS n_docs, min(doc_id) AS first_doc FROM words JOIN documents ON contains(text, pattern) GROUP BY pattern"""
)
def signature_documents(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents the text of each of the pages' links occurs, anywhere in the text."""
    words = links.page_links(parquet(spark, d, "pages")).select(F.col("text").alias("pattern"))
    found = grams.matches(parquet(spark, d, "documents"), words, text="text", keep=["doc_id"])
    return found.groupBy("pattern").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@R.query(
    r"""WITH p AS (SELECT p_partkey, p_type, p_name FROM part), likes AS (SELECT DISTINCT '%' || split_part(p_type, ' ', 2) || '_' || left(split_part(p_type, ' ', 3), 2) || '%' AS pattern FROM p UNION SELECT DISTINCT left(p_name, 2) || '%' || right(p_name, 3) FROM p UNION SELECT '%\_%')
    SELECT pattern, count(*) AS n, min(p_partkey) AS first_part FROM p JOIN likes ON p_type LIKE pattern ESCAPE '\' OR p_name LIKE pattern ESCAPE '\' GROUP BY pattern"""
)
def like_searches(spark: SparkSession, d: str) -> DataFrame:
    """Many searches of the catalogue of parts by name or type, with live wildcards."""
    # parts of equal type and name are found by the same searches, so one of them is searched and all are counted
    at = scratch(spark, "kinds")
    parquet(spark, d, "part").groupBy("p_type", "p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).write.parquet(at)
    p = spark.read.parquet(at)
    word = lambda n: F.split_part("p_type", F.lit(" "), F.lit(n + 1))
    likes = p.select(F.concat(F.lit("%"), word(1), F.lit("_"), F.substring(word(2), 1, 2), F.lit("%")).alias("pattern")).unionByName(p.select(F.concat(F.substring("p_name", 1, 2), F.lit("%"), F.expr("right(p_name, 3)")).alias("pattern")))
    likes = likes.unionByName(p.select(F.lit(r"%\_%").alias("pattern")).limit(1))
    texts = p.select(F.explode(F.array("p_type", "p_name")).alias("text")).distinct()
    found = grams.matches(texts, likes, text="text", keep=["text"], like=True)
    hits = p.join(found.withColumnRenamed("text", "p_type"), "p_type").unionByName(p.join(found.withColumnRenamed("text", "p_name"), "p_name"))
    return hits.groupBy("p_type", "p_name", "pattern").agg(F.first("n").alias("n"), F.first("first").alias("first")).groupBy("pattern").agg(F.sum("n").alias("n"), F.min("first").alias("first_part"))


@R.query(
    rf"""WITH {LINKED}, t AS (SELECT page_id, pos, href, text, parent, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www[.]', '') AS own, CASE WHEN starts_with(href, '//') THEN 'https:' || href ELSE href END AS target FROM linked WHERE regexp_matches(href, '^(https?:)?//')),
    h AS (SELECT *, regexp_replace(regexp_extract(target, '://([^/?#]*)', 1), '^www[.]', '') AS host FROM t)
    SELECT page_id, host, min(CASE WHEN lower(text) = 'student portal' THEN target END) AS portal_url, count(*) AS n_links FROM h WHERE host <> own AND NOT ends_with(host, '.' || own) AND host <> 'other.org' GROUP BY page_id, host"""
)
def sibling_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The other hosts that candidates link to."""
    return links.siblings(candidates(spark, d).select("page_id", "url", F.col("url").alias("primary"), "html"), primary="primary", blocked=["other.org"])


@R.query()
def text_rechecks(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation held against the next, by matching blocks. SQL has no such measure."""
    c = parquet(spark, d, "conversations")
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return discovery.rechecked(c.select("conv_id", "turn", "text").join(later, ["conv_id", "turn"]), "text", "next").select("conv_id", "turn", "ratio", "confirmed", "reason")
