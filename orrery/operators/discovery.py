"""Finding and ranking candidate portals: scores, gates, matching by place and name, and dedup of systems."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import rules, urls
from orrery.operators import grams
from orrery.operators.dedup import top
from orrery.operators.links import footer_links

# Words that tell a student's login from others, and paths and labels of logins.
STUDENT_PHRASES = ["student login", "student portal", "student access"]
PLATFORM_WORDS = ["umis", "ums", "portal"]
LOGIN_WORDS = ["login", "signin"]
STAFF_WORDS = ["staff", "faculty", "teacher", "admin", "employee"]
OTHER_WORDS = ["alumni", "recruitment", "vendor"]
LOGIN_PATHS = ["login", "signin", "sign-in", "logon", "/sso", "/auth", "acesso", "entrar", "ingresar", "acceso", "autenticacao", "autogestion"]
PORTAL_LABELS = ["portal", "portais", "campus", "campusvirtual", "aulavirtual", "moodle", "autogestion", "guarani", "siu", "alumno", "alumnos", "aluno", "estudiante", "estudiantes", "student", "students", "sso", "id", "auth"]
ERROR_PATHS = ["error", "/404", "/403", "/500", "notfound", "not-found", "page-not-found", "unavailable", "maintenance", "/oops"]
LMS_HOSTS = ["moodle", "lms", "elearning", "learning", "vle", "lcms", "elearn"]
LMS_ROOTS = ["cognibot.in", "talentlms.com", "classplusapp.com", "edmingle.com", "schoolyard.in", "blackboard.com", "canvaslms.com", "instructure.com", "brightspace.com", "moodlecloud.com"]




def student_anchor_score(href: Column, text: Column, parent: Column) -> Column:
    """How likely a link leads students to their portal: points for and against, all added."""
    both = F.lower(F.concat_ws(" ", href, F.trim(text)))
    near = rules.contains_any(both, PLATFORM_WORDS) & F.lower(F.coalesce(parent, F.lit(""))).contains("student")
    hits = [(rules.contains_any(both, STUDENT_PHRASES), 3), (both.contains("student"), 2), (near, 2), (rules.contains_any(both, LOGIN_WORDS), 1), (rules.contains_any(both, STAFF_WORDS), -2), (rules.contains_any(both, OTHER_WORDS), -3)]
    return rules.points(hits)


def login_shape(url: Column) -> Column:
    """`host` if the first host label names a portal, `path` if the path names a login, else empty; error pages are neither."""
    path = F.lower(urls.path(url))
    label = F.substring_index(urls.authority(url), ".", 1)
    starts = F.exists(F.lit(PORTAL_LABELS), lambda w: F.startswith(label, w))
    return F.when(rules.contains_any(path, ERROR_PATHS), "").when(starts, "host").when(rules.contains_any(path, LOGIN_PATHS), "path").otherwise("")


def lms_score(url: Column, body: Column) -> Column:
    """Evidence for a learning platform; two points suffice."""
    host, path, low = urls.host(url), urls.path(url), F.lower(F.coalesce(body, F.lit("")))
    return rules.points([
        (path.endswith("/login/index.php"), 2), (path.contains("/moodle"), 2), (rules.contains_any(host, LMS_HOSTS), 2), (urls.under(host, LMS_ROOTS), 1), (low.contains("moodle"), 1),
        (low.contains("powered by moodle"), 1), (low.contains('class="moodle-') | low.contains('class="mod-'), 1), (low.contains('name="generator"') & low.contains("moodle"), 1), (low.contains("cookies must be enabled in your browser"), 1),
    ])


def candidate_score(url: Column, password: Column, primary: Column, student: list[str] = ["student"], others: list[str] = ["staff", "admin"]) -> Column:  # noqa: B006
    """A login path, a password field, the primary host and a short path speak for a candidate, other audiences against it."""
    path, host = F.lower(urls.path(url)), urls.host(url)
    short = F.size(F.filter(F.split(path, "/"), lambda s: s != "")) <= 2
    found = lambda words: F.size(rules.contained(path, words))
    base = rules.points([(rules.contains_any(path, ["login", "signin", "sign-in", "auth"]), 3), (password, 2), (host == primary, 1), (short, 1)])
    return base + 5 * found(student) - 10 * found(others)


def form_signals(html: Column) -> dict[str, Column]:
    """Columns that tell a login form: numbers of forms, inputs and password fields, and whether a user field is there."""
    low = F.lower(F.coalesce(html, F.lit("")))
    n = lambda p: F.regexp_count(low, F.lit(p))
    user = low.rlike(r"""<input[^>]*(?:name|id|placeholder)=["'][^"']*(?:user|email|login|roll|enrol|regno)""")
    return {"n_forms": n(r"<form[\s>]"), "n_inputs": n(r"<input[\s>]"), "n_passwords": n(r"""<input[^>]*type=["']password["']"""), "has_user": user}


def label_tokens(name: Column) -> Column:
    """The words of a control's name: apart at `_`, `$`, `-`, between lower and upper case, and before a word's capital; lower case."""
    return F.filter(F.transform(F.split(name, r"[_$\-]|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), F.lower), lambda w: w != "")


def strong_title(title: Column, phrases: list[str]) -> Column:
    """Whether the part of a title before its first separator is one of the phrases."""
    first = F.lower(F.trim(title))
    for mark in (" - ", " | ", " :: ", " : ", " — "):
        first = F.substring_index(first, mark, 1)
    return F.trim(first).isin(phrases)


def first_json(text: Column, schema: str) -> Column:
    """The first array in free text, parsed; null if it is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), schema)


def verdict_block(text: Column) -> dict[str, Column]:
    """VERDICT, CLAUSE and REASON lines of an answer; the verdict is null unless it is one."""
    line = lambda name: F.trim(F.regexp_extract(text, rf"(?im)^\s*{name}:(.*)$", 1))
    said = F.upper(line("VERDICT"))
    verdict = rules.first_of([(said.contains("PROHIBIT"), "No"), (said.contains("AMBIG"), "Maybe"), (said.contains("ALLOW"), "Yes")])
    return {"verdict": verdict, "clause": F.trim(F.regexp_replace(line("CLAUSE"), '^"+|"+$', "")), "reason": line("REASON")}


def matched_by_place(df: DataFrame, places: DataFrame, *, place: str, name: str, keys: list[str]) -> DataFrame:
    """Rows with the rules whose alias stands in their place as whole words and whose word lists allow their name.

    Places and aliases are taken apart alike, at all but a-z and 0-9, so `U.P.` is `u p`. Runs of words of the place,
    as long as the longest alias, meet the aliases by an equi join: an alias inside a word never matches. Null places
    and aliases without words match nothing. places: rule, alias, need (array: some must be in the name, if any),
    bar (array: none may be).
    """
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    rules_ = places.withColumn("__alias", split(F.col("alias"))).filter(F.size("__alias") > 0)
    longest = rules_.agg(F.coalesce(F.max(F.size("__alias")), F.lit(0))).first()[0]
    w = split(F.col(place))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(1, longest))), lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))))
    said = df.select(*keys, F.lower(F.col(name)).alias("__name"), F.explode(F.array_distinct(runs)).alias("__alias"))
    hits = said.join(rules_.withColumn("__alias", F.array_join("__alias", " ")), "__alias")
    ok = (F.size("need") == 0) | F.exists("need", lambda t: F.contains(F.col("__name"), t))
    return hits.filter(ok & ~F.exists("bar", lambda t: F.contains(F.col("__name"), t))).select(*keys, "rule").distinct()


def without_admin_peers(df: DataFrame, *, root: str, tenant: str, suffixes: list[str]) -> DataFrame:
    """Rows without those whose tenant is another tenant of the same root with a suffix."""
    peers = df.select(F.col(root).alias("__root"), F.col(tenant).alias("__tenant")).distinct()
    bare = F.explode(F.filter(F.transform(F.lit(suffixes), lambda s: F.when(F.endswith(F.col(tenant), s), F.regexp_replace(F.col(tenant), F.concat(s, F.lit("$")), ""))), lambda p: p.isNotNull() & (p != "")))
    doomed = df.select(root, tenant, bare.alias("__bare")).distinct()
    doomed = doomed.join(peers, (F.col(root) == F.col("__root")) & (F.col("__bare") == F.col("__tenant")), "left_semi").select(root, tenant).distinct()
    return df.join(doomed, [root, tenant], "left_anti")


def main_domain(df: DataFrame, *, key: str, url: str, pos: str, configured: DataFrame, shared: list[str], academic: list[str]) -> DataFrame:
    """Per key its own domain: the configured one, else the most frequent academic one of its urls, else the most frequent.

    Shared platforms don't count. Of equals, the domain seen first wins. configured: key, domain.
    """
    found = df.select(key, pos, urls.registrable(urls.host(F.col(url))).alias("d")).filter((F.col("d") != "") & ~F.col("d").isin(shared))
    n = found.groupBy(key, "d").agg(F.count("*").alias("n"), F.min(pos).alias("at"))
    rank = F.struct(F.exists(F.lit(academic), lambda t: F.endswith(F.col("d"), t)).alias("a"), F.col("n"), (-F.col("at")).alias("at"))
    seen = n.groupBy(key).agg(F.max_by("d", rank).alias("seen"))
    own = configured.filter(~F.col("domain").isin(shared)).select(key, "domain")
    return df.select(key).distinct().join(own, key, "left").join(seen, key, "left").select(key, F.coalesce("domain", "seen", F.lit("")).alias("domain"))


def one_per_system(df: DataFrame, *, host: str, segment: str, root: str, path: str, confidence: str, pos: str) -> DataFrame:
    """The best of each host and path segment, then of each domain and path the shortest host; confident ones first."""
    best = top(df, [host, segment], [F.col(confidence).desc(), F.col(pos)])
    return top(best, [root, path], [F.length(host), F.col(pos)])


def repeats(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """df with first_row, the first row of the same keys, and whether the row repeats it."""
    firsts = df.groupBy(*keys).agg(F.min(row).alias("first_row"))
    return df.join(firsts, keys).withColumn("repeat", F.col(row) > F.col("first_row"))


def collapsed(df: DataFrame, key: str, working: Column, pos: str) -> DataFrame:
    """Working rows; of keys that have none, the first row, marked N/A."""
    marked = df.withColumn("__ok", working)
    alive = marked.groupBy(key).agg(F.bool_or("__ok").alias("__any"), F.min(pos).alias("__first"))
    kept = marked.join(alive, key).filter(F.col("__ok") | (~F.col("__any") & (F.col(pos) == F.col("__first"))))
    return kept.withColumn("state", F.when(F.col("__ok"), "ok").otherwise("N/A")).drop("__ok", "__any", "__first")


def vendors(df: DataFrame, signatures: DataFrame, *, keys: list[str], text: Column) -> DataFrame:
    """keys (unique) and the first vendor, by rank and then name, of whom a signature is in a row's text, whatever its case.

    signatures: vendor, rank, words (array); of any number, as they are met by their rarest grams (operators.grams).
    """
    words = signatures.select("vendor", "rank", F.explode("words").alias("pattern"))
    found = grams.matches(df.select(*keys, F.lower(text).alias("__low")), words, text="__low", keep=keys)
    return found.join(words, "pattern").groupBy(*keys).agg(F.min_by("vendor", F.struct("rank", "vendor")).alias("vendor"))


def linked_makers(df: DataFrame, blocked: list[str], *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows with the first domain that their footer links to and that isn't their own or blocked."""
    found = footer_links(df, page=page, url=url, html=html).withColumn("vendor", urls.registrable(F.col("target_host")))
    away = (F.col("vendor") != "") & (F.col("vendor") != urls.registrable(urls.host(F.col("base")))) & ~F.col("vendor").isin(blocked)
    return top(found.filter(away), [page], [F.col("pos")]).select(page, "vendor")


def with_metrics(df: DataFrame, known: DataFrame, *, host: str, domain: str, into: str) -> DataFrame:
    """df with the score of its host, else of its domain, else 0. known: name (unique), score."""
    by = lambda c, to: known.select(F.col("name").alias(c), F.col("score").alias(to))
    joined = df.join(by(host, "__own"), host, "left").join(by(domain, "__up"), domain, "left")
    return joined.withColumn(into, F.coalesce("__own", "__up", F.lit(0))).drop("__own", "__up")


def state_and_city(name: Column) -> dict[str, Column]:
    """State and city of a name that ends in both in brackets; empty without them."""
    part = lambda i: F.trim(F.regexp_extract(name, r"\(([^,()]*),([^()]*)\)\s*$", i))
    return {"state": part(1), "city": part(2)}


def similar(df: DataFrame, left: str, right: str, into: str = "ratio") -> DataFrame:
    """df with the share of words, counted as often as they occur, that two texts have in common; two without words: 1.

    Words are runs of letters and digits, lower case. Null texts are empty.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # sorted words, each with how many like it went before: multisets become sets
    numbered = lambda c: F.transform(F.col(c), lambda w, i: F.concat(w, F.lit(":"), (i - F.array_position(F.col(c), w)).cast("string")))
    made = df.withColumns({"__a": F.array_sort(words(left)), "__b": F.array_sort(words(right))})
    n = F.size("__a") + F.size("__b")
    ratio = F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(numbered("__a"), numbered("__b"))) / n)
    return made.withColumn(into, ratio).drop("__a", "__b")


def block_ratio(df: DataFrame, left: str, right: str, into: str = "ratio", most: int = 4096) -> DataFrame:
    """df with the likeness of two texts by matching blocks: twice the characters in common blocks over those of both.

    The longest common block is taken, then those left and right of it, and so on; characters that make up over a hundredth of a
    right text of 200 or more begin no block. The measure looks at the first `most` characters, as it takes time that
    grows with their square; null is empty, and two empty texts are alike. Each pair is one row: nothing is shuffled.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, most)
    return df.withColumn(into, ratio(cut(left), cut(right)))


def rechecked(df: DataFrame, left: str, right: str, least: float = 0.5) -> DataFrame:
    """df with whether a second reading of a page confirms the first, and why not: both there, and alike enough."""
    out = block_ratio(df, left, right)
    empty = (F.coalesce(F.col(left), F.lit("")) == "") | (F.coalesce(F.col(right), F.lit("")) == "")
    reason = F.when(empty, "empty on one of the readings").when(F.col("ratio") < least, "diverged").otherwise("consistent")
    return out.withColumn("reason", reason).withColumn("confirmed", F.col("reason") == "consistent")
