"""Gates that candidates pass or not, each with a reason, and the choice among those that pass.

The lists of words, platforms and suffixes are parameters: literal arrays here, tables with an equi join on host
suffixes (orrery.operators.suffix) where they are long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import rules, urls
from orrery.functions.sites import challenge_page
from orrery.functions.text import anchors
from orrery.operators.dedup import top
from orrery.operators.discovery import label_tokens, login_shape

SHELL = 3  # points from which a page counts as a shell that scripts fill


def shell_score(url: Column, html: Column) -> Column:
    """Evidence that a page is empty until its scripts run."""
    html = F.coalesce(html, F.lit(""))
    low, path = F.lower(html), F.lower(urls.path(url))
    label = F.substring_index(urls.authority(url), ".", 1)
    noscript = F.regexp_extract(low, r"(?s)<noscript[^>]*>(.*?)</noscript>", 1)
    tiny = F.length(html).between(1, 1999)
    return rules.points([
        (low.contains("javascript disabled"), 2), (rules.contains_any(low, ["please enable javascript", "enable javascript in your browser", "this site requires javascript"]), 2),
        (tiny & rules.contains_any(path, ["/login", "/signin", "/auth"]), 3), (tiny & label.isin("login", "portal", "erp", "sso") & path.isin("", "/"), 3),
        (rules.contains_any(noscript, ["enable", "javascript"]), 1), (F.length(html).between(1, 499) & (F.regexp_count(low, F.lit(r"<script[^>]+src=")) >= 3), 1),
        (low.rlike(r"""id=["'](?:root|app)["']|data-reactroot|ng-app|data-vue-root"""), 1),
    ])


def admission(url: Column, title: Column, text: Column, *, tokens: list[str], platforms: list[str], exempt: list[str], titles: list[str], strong: list[str], weak: list[str], against: list[str]) -> Column:
    """Why a page is for applicants and not for students, or empty.

    The url decides first, then the platform; an exempting word ends the search, then a title phrase, a strong
    phrase, two weak ones with nothing against, or four whatever is against.
    """
    where, head, body = F.lower(F.concat(urls.host(url), urls.path(url))), F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    n = F.size(rules.contained(body, weak))
    return rules.first_of([
        (rules.contains_any(where, tokens), "url"), (urls.under(urls.host(url), platforms), "platform"), (rules.contains_any(body, exempt), ""), (rules.contains_any(head, titles), "title"),
        (rules.contains_any(body, strong), "strong"), ((n >= 2) & ~rules.contains_any(body, against), "weak"), (n >= 4, "many weak"),
    ], "")


def audience(headings: Column, names: Column, *, others: list[str], students: list[str], other_names: list[str], student_names: list[str]) -> Column:
    """Whom a login is for, by its headings and the words of its control names: others are looked for first."""
    low = F.lower(F.coalesce(headings, F.lit("")))
    words = F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), label_tokens))
    has = lambda xs: F.arrays_overlap(words, F.lit(xs))
    return rules.first_of([(rules.contains_any(low, others) | has(other_names), "non_student"), (rules.contains_any(low, students) | has(student_names), "student")], "ambiguous")


def strict_form(html: Column, url: Column) -> Column:
    """Whether a form holds a password and a user field and is sent to its own host."""
    forms = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<form(?:\s[^>]*)?>.*?</form>"), F.lit(0))
    action = lambda f: F.regexp_extract(f, r"""(?i)^<form[^>]*\saction=["'](https?://[^/"'?#]+)""", 1)
    own = urls.host(url)
    good = lambda f: (
        f.rlike(r"""(?i)<input[^>]*type=["']?password""") & f.rlike(r"""(?i)<input[^>]*(?:name|id|type|placeholder)=["'][^"']*(?:user|email|login|roll|enrol|regno)""") & ((action(f) == "") | (urls.host(action(f)) == own))
    )
    return F.exists(forms, good)


def login_link(html: Column) -> Column:
    """The first link whose text says login and whose path looks like one; null without any."""
    hit = lambda a: F.lower(a["text"]).isin("login", "student login", "sign in", "portal login") & rules.contains_any(F.lower(a["href"]), ["login", "signin", "auth"])
    return F.try_element_at(F.filter(anchors(F.coalesce(html, F.lit(""))), hit), F.lit(1))["href"]


def login_gate(url: Column, html: Column, shared: list[str]) -> Column:
    """The rule by which a page counts as a login, or empty."""
    shape = login_shape(url)
    home = urls.path(url).isin("", "/")
    return rules.first_of([(urls.under(urls.host(url), shared), "shared platform"), (strict_form(html, url), "form"), (home & login_link(html).isNotNull(), "link"), (shape == "host", "host"), (shape == "path", "path")], "")


def validated(*, status: Column, host: Column, body: Column, audience: Column, bare: list[str], foreign: list[str], others: list[str], allowed: tuple[int, ...] = (200, 401, 403)) -> Column:
    """The first reason to reject an observed candidate, or `kept`: its status, a bare or foreign platform, an empty or challenged body, its audience."""
    return rules.first_of([
        (~status.isin(*allowed) | status.isNull(), "status"), (host.isin(bare), "bare platform"), (urls.under(host, foreign), "foreign"), (challenge_page(body), "body"), (rules.contains_any(audience, others), "audience"),
    ], "kept")


def membership(df: DataFrame, *, host: str, owned: str, names: str, platforms: list[str], foreign: list[str], shared: list[str], into: str = "reason") -> DataFrame:
    """df with why a host belongs to an organisation (`owned`: its domains, `names`: its short names), or why not.

    A foreign platform never does. On a platform of tenants, the tenant must be one of the names, or hold one of
    four letters or more. Else an own domain or a host below it; else a name at the start of the registrable
    domain; else a shared platform. Reasons that start with `no` reject.
    """
    h = F.lower(F.col(host))
    root = F.try_element_at(F.filter(urls.host_suffixes(h), lambda s: s.isin(platforms)), F.lit(1))
    tenant = F.when(root.isNotNull(), F.substr(h, F.lit(1), F.greatest(F.length(h) - F.length(root) - 1, F.lit(0))))
    parts = df.withColumns({"__h": h, "__tenant": tenant, "__base": urls.registrable(h)})
    named = F.exists(names, lambda s: (F.col("__tenant") == s) | (F.substring_index("__tenant", ".", -1) == s) | ((F.length(s) >= 4) & F.contains(F.col("__tenant"), s)))
    mine = F.exists(owned, lambda d: (F.col("__h") == d) | F.endswith(F.col("__h"), F.concat(F.lit("."), d)))
    begins = F.exists(names, lambda s: (F.length(s) >= 4) & F.startswith(F.col("__base"), s))
    on = lambda roots: F.arrays_overlap(urls.host_suffixes(F.col("__h")), F.lit(roots)) if roots else F.lit(False)
    reason = rules.first_of([
        (F.coalesce(F.col("__h"), F.lit("")) == "", "no host"), (on(foreign), "no: foreign platform"), (F.col("__tenant") == "", "no: bare platform"), (F.col("__tenant").isNotNull() & named, "tenant"),
        (F.col("__tenant").isNotNull(), "no: other tenant"), (mine, "own domain"), (begins, "short name"), (on(shared), "shared platform"),
    ], "no: mismatch")
    return parts.withColumn(into, reason).drop("__h", "__tenant", "__base")


def consolidated(df: DataFrame, *, keep: Column, host: str, category: str, score: str, path: str, pos: str) -> DataFrame:
    """Candidates that pass, one per host and category: the best score, then the shorter path, then the later one."""
    order = [F.col(score).desc(), F.length(urls.without_trailing(F.col(path))), F.col(pos).desc()]
    return top(df.filter(keep), [host, category], order)
