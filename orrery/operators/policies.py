"""Which candidates are documents of terms: three validators, each a list of stages for orrery.operators.ledger.

They read observed pages: url, final_url (after redirects), status, html, and the columns of structure.structured() (text,
elements). Organisations' domains come as columns. The lists are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import rules, sites, urls
from orrery.operators import structure
from orrery.operators.discovery import strong_title

# Parts of urls, hosts, titles and bodies.
ASSETS = r"(?i)\.(?:js|mjs|css|map|json|xml|png|jpe?g|gif|svg|webp|woff2?|ttf|ico|mp4|woff)(?:$|\?)"
SCRIPTS = r"(?i)/public_api/|/autoblock|/banner/|/gtag|/gtm[./]|/analytics|/pixel|/consent[_-]?script"
CONSENT_HOSTS = ["cookiebot", "onetrust", "privacytools", "iubenda", "cookieyes", "termly", "cookielaw", "usercentrics", "civiccomputing"]
ASSET_LABELS = ["cdn", "static", "assets", "media", "api", "app", "apps", "aplicacao", "aplicativo", "img", "images", "js"]
STRONG_PATH = r"(?i)term|termos|t[eé]rmin|privac|privacid|privacy|condic|condi[cç][oõ]es|cookie|aviso.?de.?privac|politica.?de.?privac|nutzungsbeding|datenschutz|conditions|confidentialit|/tos(?:[/?.]|$)|/cgu|/agb"
POLICY_PATH = r"(?i)term|/tos(?:[/?.]|$)|termos|condic|condi[cç][oõ]es|t[eé]rmin|privac|privaci|privacystatement|datenschutz|/legal|/agb|/cgu|policy|policies|gdpr|lgpd|servicesagreement|/agreement|use-?agreement|eula|aviso.?de.?privac|politica.?de.?privac|pol[ií]tica"
VENDOR_HOSTS = ["google.com", "policies.google.com", "microsoft.com", "privacy.microsoft.com", "instructure.com", "blackboard.com", "moodle.com", "moodle.org", "d2l.com", "brightspace.com", "canvaslms.com", "openathens.net", "ellucian.com"]
BODY_ERRORS = [
    "technical issue", "an error has occurred", "an error occurred", "error occurred", "page not found", "404 not found", "the resource cannot be found", "server error in", "an exception of type", "service unavailable",
    "request could not be processed", "an unexpected error", "object reference not set",
]
TITLE_WORDS = ["terms", "conditions", "disclaimer", "privacy", "policy", "tos", "agreement", "legal"]
STRONG_TITLES = ["disclaimer", "privacy policy", "privacy notice", "terms and conditions", "terms of use", "terms of service", "terms"]
HOME_MARKS = ["notifications", "tenders", "grievance redressal", "anti-ragging", "covid", "admissions open"]
LEAST, MOST, MOST_LINKS = 500, 80_000, 50  # characters of a body, links
GLOBAL_HOSTS = [
    "google.com", "google.co.in", "policies.google.com", "gstatic.com", "googleapis.com", "youtube.com", "gmail.com", "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "whatsapp.com", "telegram.org",
    "pinterest.com", "microsoft.com", "office.com", "live.com", "bing.com", "apple.com", "cloudflare.com", "amazon.com", "adobe.com", "mozilla.org", "w3.org", "wordpress.com", "wordpress.org", "jquery.com", "github.com",
]
SLUGS = ["privacy", "terms", "tnc", "disclaimer", "legal", "condition", "policy", "website-polic", "hyperlinking"]
HOMES = ["", "/home", "/index", "/index.html", "/index.php", "/app"]
RETURNS = ["returnurl", "redirect", "redirecturl", "returnto"]
LOGIN_PARTS = ["/login", "/signin", "/sign-in", "/account/login", "/users/login"]
ERROR_PARTS = ["/error", "/errors", "/404", "/pagenotfound", "/page-not-found", "/oops"]
NOT_FOUND = ["page not found", "not found", "404 error", "error 404", "page does not exist", "page you requested", "doesn't exist", "does not exist"]
BODY_WORDS = ["terms", "privacy", "conditions", "disclaimer", "personal data", "cookie", "we collect", "you agree", "use of this", "this policy", "copyright", "legal", "intellectual property", "refund"]


def _why(when: Column, reason: str | Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(reason) if isinstance(reason, str) else reason)


def _first(c: Column, words: list[str]) -> Column:
    """The first of the words that a text holds, null without one."""
    return F.try_element_at(rules.contained(c, words), F.lit(1))


def document_url(url: Column, own: list[Column]) -> list[tuple[str, Column]]:
    """Whether an address may be that of a document: no script or asset, no consent banner, no landing on a law; of other sites
    than the organisation's (`own`: its registrable domains) and the vendors', only with a policy's name in its path."""
    host, path = urls.host(url), urls.path(url)
    whole = F.lower(F.concat(path, F.lit("?"), urls.query(url)))
    strong = whole.rlike(STRONG_PATH)
    mine = F.coalesce(F.array_contains(F.array(*own), urls.registrable(host)), F.lit(False))
    return [
        ("address", _why((host == "") | ~urls.scheme(url).isin("http", "https"), "no web address")),
        ("asset", _why(path.rlike(ASSETS) | F.coalesce(url, F.lit("")).rlike(SCRIPTS), "script or asset")),
        ("consent", _why(rules.contains_any(host, CONSENT_HOSTS), "consent banner")),
        ("law", _why(path.rlike("(?i)^/(?:lgpd|gdpr|dpo)/?$"), "landing on a law")),
        ("label", _why(F.substring_index(host, ".", 1).isin(ASSET_LABELS) & ~strong, "host of assets")),
        ("third party", _why(~mine & ~urls.under(host, VENDOR_HOSTS) & ~strong & ~whole.rlike(POLICY_PATH), "unrelated third party")),
    ]


def strict_page(allowed: Column) -> list[tuple[str, Column]]:
    """Whether an observed page is a document of terms by its own words. allowed: an array of domains.

    A title whose first part is a phrase of terms excuses size, number of links and marks of a home page.
    """
    url, final, body = F.col("url"), F.coalesce("final_url", "url"), F.lower(F.coalesce("html", F.lit("")))
    elements, text = F.col("elements"), F.col("text")
    title = F.coalesce(structure.text_of(structure.first(elements, structure.tagged("title")), text, " "), F.lit(""))
    heads = F.transform(F.slice(F.filter(elements, structure.tagged("h1")), 1, 5), lambda e: structure.text_of(e, text))
    said = F.lower(F.concat(title, F.lit(" | "), F.array_join(heads, " | ")))
    strong, n_links, size = strong_title(title, STRONG_TITLES), F.size(F.filter(elements, structure.tagged("a"))), F.length(F.coalesce("html", F.lit("")))
    host = urls.host(url)
    on = F.exists(allowed, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    other = sites.other_document(url)
    return [
        ("host", _why(~on, "host not allowed")),
        ("error url", _why(sites.error_url(url), "error address")),
        ("other document", _why(other != "", F.concat(F.lit("another document: "), other))),
        ("status", _why(F.coalesce("status", F.lit(0)) != 200, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("unknown"))))),
        ("final url", _why(sites.error_url(final), "redirected to an error")),
        ("empty", _why(body.rlike(r"^\s*$"), "empty body")),
        ("error body", F.when(_first(body, BODY_ERRORS).isNotNull(), F.concat(F.lit("error: "), _first(body, BODY_ERRORS)))),
        ("size", _why(~strong & (size < LEAST), "too short").otherwise(_why(~strong & (size > MOST), "too long"))),
        ("title", _why(~rules.contains_any(said, TITLE_WORDS), "title and headings name no terms")),
        ("links", _why(~strong & (n_links > MOST_LINKS), "too many links")),
        ("home page", F.when(~strong & _first(body, HOME_MARKS).isNotNull(), F.concat(F.lit("home page: "), _first(body, HOME_MARKS)))),
    ]


def level_page(allowed: Column) -> list[tuple[str, Column]]:
    """Whether a page on a level of the ladder is one of terms: not a global platform's, not behind a login, a redirect or an
    error, named as legal or speaking of it. Documents as files need a legal name."""
    url, final, path = F.col("url"), F.coalesce("final_url", "url"), F.lower(urls.path(F.col("url")))
    end, query = F.lower(urls.path(final)), F.lower(urls.query(final))
    body = F.lower(F.replace("text", F.lit(structure.SEP), F.lit(" ")))
    asks = rules.contains_any(path, SLUGS)
    file = path.endswith(".pdf")
    host = urls.host(final)
    on = F.exists(allowed, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    named = (asks | path.rlike(sites.LEGAL_SLUG)) & ~path.rlike(sites.NOT_LEGAL)
    n = F.size(rules.contained(body, BODY_WORDS))
    page = lambda when, why: _why(~file & when, why)
    return [
        ("platform", _why(urls.registrable(urls.host(url)).isin(GLOBAL_HOSTS), "global platform")),
        ("file name", _why(file & ~(path.rlike(sites.LEGAL_SLUG) & ~path.rlike(sites.NOT_LEGAL)), "file without a legal name")),
        ("blocked", page(sites.challenge_page(F.col("html")), "empty or blocked")),
        ("final host", page(~on, "redirected elsewhere")),
        ("home page", page(asks & F.regexp_replace(end, "/+$", "").isin(HOMES), "redirected to the home page")),
        ("login", page(rules.contains_any(query, RETURNS), "address to return to").otherwise(page(asks & (rules.contains_any(end, LOGIN_PARTS) | sites.login_page(body)), "login page"))),
        ("error", page(query.contains("aspxerrorpath") | rules.contains_any(end, ERROR_PARTS), "error page")),
        ("content", page(F.length(body) < LEAST, "too short").otherwise(page(rules.contains_any(body, NOT_FOUND), "says not found"))),
        ("article", page(~sites.legal_page(url), "article or other page")),
        ("words", page(n < F.when(named, 1).otherwise(2), "speaks of no terms")),
    ]
