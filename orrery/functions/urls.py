"""URLs and hosts as column expressions.

Hosts and paths are cut out of the string by patterns; nothing is validated, so odd host names survive and a
missing scheme is no error. All functions give '' for a null URL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that never name another resource, suffixes below which a domain is registered, countries
# of top-level domains, and words that say nothing about a path.
TRACKING = ["ref", "referrer", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "source", "from", "via"]
SUFFIXES = ["ac.in", "co.in", "edu.in", "gov.in", "net.in", "org.in", "ac.uk", "co.uk", "gov.uk", "com.au", "edu.au", "gov.au"]
COUNTRIES = {
    "in": "India", "ar": "Argentina", "br": "Brazil", "bd": "Bangladesh", "id": "Indonesia", "pk": "Pakistan", "np": "Nepal", "lk": "Sri Lanka",
    "ph": "Philippines", "mx": "Mexico", "ng": "Nigeria", "ke": "Kenya", "za": "South Africa", "eg": "Egypt", "my": "Malaysia", "cl": "Chile",
    "co": "Colombia", "pe": "Peru", "th": "Thailand", "vn": "Vietnam",
}
STOP_TOKENS = [
    "login", "logon", "signin", "sign", "portal", "portals", "student", "students", "index", "home", "main", "default", "php", "aspx", "asp", "jsp",
    "html", "htm", "www", "http", "https", "com", "org", "net", "edu", "ac", "in", "co", "user", "users", "account", "auth", "app", "apps", "web",
    "site", "page", "view", "college", "university", "institute", "campus", "online", "welcome", "erp", "lms",
]


# Each function uses its argument once: expressions nest, and a second use would double what stands below.


def _full(url: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "^(?![A-Za-z][A-Za-z0-9+.-]*://)(?=.)", "http://")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_full(url), "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(_full(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(_full(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(_full(url), r"^[^?#]*\?([^#]*)", 1)


def host(url: Column) -> Column:
    """Lower case, without user, port and a leading `www.`."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", ""), r"^www\.", "")


def without_trailing(c: Column, chars: str = "/") -> Column:
    return F.regexp_replace(c, f"[{chars}]+$", "")


def match_key(url: Column) -> Column:
    """The key by which feedback and catalogue URLs meet: no scheme, no trailing `/`, no leading run of `w` and `.`."""
    low = without_trailing(F.lower(F.trim(F.coalesce(url, F.lit("")))))
    return F.regexp_replace(F.regexp_replace(low, "^https?://", ""), "^[w.]+", "")


def portal_key(url: Column) -> Column:
    return F.concat(host(url), without_trailing(path(url)))


def base_host(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def without_session(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "(?i);jsessionid=[^/?#]*", "")


def kept_query(url: Column, tracking: list[str] = TRACKING) -> Column:
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^[^=]*", 0)).isin(tracking))
    return F.array_join(pairs, "&")


def canonical(url: Column, tracking: list[str] = TRACKING) -> Column:
    """Lower-case scheme and authority without its default port; no session id, tracking keys or fragment."""
    u = without_session(url)
    where = F.regexp_replace(base_host(u), "^(http://.*):80$|^(https://.*):443$", "$1$2")
    q = F.regexp_replace(F.concat(F.lit("?"), kept_query(u, tracking)), r"^\?$", "")
    return F.regexp_replace(F.concat(where, path(u), q), "^://$", "")


def dedup_key(url: Column) -> Column:
    """Canonical without query and trailing `/`: pages that differ in these are one."""
    return without_trailing(F.regexp_replace(canonical(url), r"\?.*$", ""))


def registrable(h: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The last two labels, or three below one of the two-label suffixes; a shorter host is itself."""
    some = "|".join(x.replace(".", r"\.") for x in suffixes)
    return F.regexp_extract(h, rf"(?<![^.])(?:(?:[^.]+\.)?(?:{some})|[^.]+\.[^.]*|[^.]*)$", 0)


def host_suffixes(h: Column) -> Column:
    """The host and all its parents: an equi join on these finds the rules for a host and its subdomains."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def parent_hosts(h: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The parents of a host up to its registrable domain, nearest first."""
    return F.filter(F.slice(host_suffixes(h), 2, 64), lambda x: F.length(x) >= F.length(registrable(h, suffixes)))


def path_parents(url: Column, most: int = 3) -> Column:
    """Base URLs of the ancestor folders of a path, nearest first."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    n = F.size(parts) - 1
    steps = F.when(n > 0, F.slice(F.sequence(n, F.lit(1), F.lit(-1)), 1, most)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.concat(base_host(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))


def path_tokens(url: Column, stop: list[str] = STOP_TOKENS) -> Column:
    """Distinct runs of three or more letters in path and query, without words that say nothing."""
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", path(url), query(url))), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.lit(stop))


def country(h: Column, default: str = "Global") -> Column:
    top = F.regexp_extract(F.rtrim(F.lower(h), F.lit(".")), r"([^.]*)$", 1)
    names = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, top), F.lit(default))


def under(h: Column, roots: list[str]) -> Column:
    """Whether the host is one of the roots or below one."""
    return F.arrays_overlap(host_suffixes(h), F.lit(roots)) if roots else F.lit(False)


def unwrapped(url: Column, key: str = "uddg") -> Column:
    """The target of a redirect link, else the link."""
    target = F.regexp_extract(url, f"[?&]{key}=([^&#]+)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(url)
