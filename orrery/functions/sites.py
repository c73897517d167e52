"""Predicates over the urls and bodies of stored pages. Lists are parameters or constants of this module; all are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import rules, text, urls

# Parts of paths, hosts and bodies that tell a page's kind.
ADMIN_PATHS = ["/admin/", "/admin/login", "/wp-admin", "/wp-login.php", "/administrator", "/administrator/", "/manage/login", "/dashboard/login", "/backend/login", "/cms/login", "/control/login", "/cpanel", "/adminpanel"]
SUBPAGES = "forgot|reset|recover|register|signup|sign-up|logout|change.?password|first.?access|primeiro.?acesso|esqueci"
SSO_HOSTS = ["accounts.google.com", "login.microsoftonline.com", "login.live.com", "outlook.office.com", "outlook.office365.com", "login.microsoft.com", "sso.godaddy.com", "sso.secureserver.net"]
MAIL_LABELS = ["webmail", "mail", "email", "roundcube", "horde", "squirrelmail", "zimbra", "owa", "mymail", "rainloop", "afterlogic"]
MAIL_PATHS = r"(?i)/(?:webmail|roundcube|horde|squirrelmail|owa|zimbra|rainloop)(?:/|$|\?)|:209[56]"
LOGIN_HINT = r"(?i)login|sign-?in|signon|/sso|/cas|shibboleth|adfs|oauth|/auth|samlrequest|auth\."
ACADEMIC_SUFFIXES = [".ac.in", ".edu.in", ".edu", ".gov.in", ".res.in", ".nic.in", ".ac.uk", ".edu.au", ".edu.pk", ".edu.np"]
CHALLENGES = ["just a moment", "cf-browser-verification", "cf-challenge", "_cf_chl_", "attention required", "checking your browser", "enable javascript and cookies", "ddos protection by", "captcha-delivery", "px-captcha"]
BLOCKS = ["you have been blocked", "attention required! | cloudflare", "unable to access", "access denied", "error 1020", "ray id:", "this website is using a security service to protect itself"]
INTERSTITIALS = ["just a moment", "checking your browser", "performing security verification", "verify you are human", "verifying you are human", "cf_chl", "cf-challenge", "needs to review the security of your connection"]
LOGIN_MARKS = ["forgot password", "remember me", "sign in", "log in", "login"]
LEGAL_TEXTS = ["privacy policy", "terms of use", "terms and conditions", "terms of service", "terms & conditions", "legal", "disclaimer"]
LEGAL_PATHS = ["/disclaimer", "/terms", "/privacy", "/legal", "/policy"]
STRONG_LEGAL = r"(?i)privacy|terms?|t&?c|tnc|disclaimer|copyright|conditions?|website[\s_-]*polic|cookie|\blegal\b"
ERROR_PATHS = ["/custom.htm", "/error.htm", "/404.htm", "/errorpage", "/error.aspx", "/error.html", "/notfound.html", "/notfound"]
ERROR_KEYS = ["aspxerrorpath", "errorpage", "notfound"]
OTHER_DOCUMENTS = ["aicte", "naac", "nirf", "approval", "accreditation", "prospectus", "syllabus", "result", "admitcard", "tender", "recruitment", "annual-report", "annual_report"]
TEST_HOSTS = ["staging", "beta", "test", "dev", "sandbox", "uat", "qa", "preprod"]
OFFICE_LABELS = ["hr", "payroll", "finance", "procurement", "vendor"]
COLLEGE_WORDS = ["college", "institute", "school", "faculty", "dept", "department"]
PORTAL_TEXTS = [
    "student portal", "students portal", "student login", "students login", "examination portal", "exam portal", "exams portal", "online exam portal", "online examination portal", "admit card", "hall ticket", "result portal",
    "results portal", "lms", "lms portal", "learning portal", "moodle", "moodle portal", "online learning", "fee portal", "fee payment portal", "online fee", "library portal", "elibrary", "transcript portal", "certificate portal",
]
PDF_PHRASES = ["terms and conditions", "terms of use", "terms of service", "privacy policy", "disclaimer", "website policy", "intellectual property", "liability", "as is", "without warranty", "governing law", "unauthorized use", "all rights reserved"]
LEGAL_SLUG = r"(?i)privacy|terms|conditions?|disclaimer|copyright|cookie|\blegal\b|website[\s_-]*polic|data[\s_-]*protection|acceptable[\s_-]*use|hyperlink|\btnc\b|t&c"
NOT_LEGAL = r"(?i)legal[\s_/-]*(?:awareness|aid|cell|literacy|studies|education|services?|department|club|camp|metrolog|heir|maxim|news)|/news/|/blog/|/events?/|/notice-?board|/gallery"
PAYMENT_SLUG = r"(?i)payment|refund|cancellation|\bpatents?\b|\bfees?\b"
ARTICLE_WORDS = [
    "day", "week", "year", "semester", "topic", "aspect", "mechanism", "report", "assessment", "seminar", "webinar", "workshop", "celebration", "event", "news", "blog", "article", "notice", "circular", "result", "admission",
    "scholarship", "souvenir", "magazine", "bulletin", "newsletter", "prospectus", "syllabus", "brochure", "agenda", "minutes", "frequency", "transparent", "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
]


def _path(url: Column) -> Column:
    return F.lower(urls.path(url))


def admin_path(url: Column, tokens: list[str] = ADMIN_PATHS) -> Column:
    return rules.contains_any(_path(url), tokens)


def homepage(url: Column) -> Column:
    return urls.without_trailing(urls.path(url)) == ""


def login_subpage(url: Column) -> Column:
    """Pages beside a login that are never the entry itself."""
    return _path(url).rlike(SUBPAGES)


def generic_sso(url: Column, hosts: list[str] = SSO_HOSTS) -> Column:
    return urls.host(url).isin(hosts)


def webmail(url: Column) -> Column:
    first = F.substring_index(urls.host(url), ".", 1)
    return first.isin(MAIL_LABELS) | first.endswith("mail") | F.coalesce(url, F.lit("")).rlike(MAIL_PATHS)


def academic_host(host: Column, suffixes: list[str] = ACADEMIC_SUFFIXES) -> Column:
    return host.contains(".ac.") | F.exists(F.lit(suffixes), lambda s: F.endswith(host, s))


def own_site(host: Column, title: Column, words: str = "(?i)university|college|institute") -> Column:
    """Whether a site is an organisation's own: by an academic host, or by its title."""
    return academic_host(host) | F.coalesce(title, F.lit("")).rlike(words)


def challenge_page(html: Column, marks: list[str] = CHALLENGES) -> Column:
    """An empty body or one of a bot challenge."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return (F.length(low) < 200) | rules.contains_any(low, marks)


def block_page(html: Column, marks: list[str] = BLOCKS, passing: list[str] = INTERSTITIALS, most: int = 6000) -> Column:
    """A final refusal: two marks or more, on a page that isn't a short one of a challenge that passes by itself."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return ~((F.length(low) <= most) & rules.contains_any(low, passing)) & (F.size(rules.contained(low, marks)) >= 2)


def login_page(body: Column, marks: list[str] = LOGIN_MARKS, most: int = 2500) -> Column:
    """A short body that asks for a password and offers to sign in."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return low.contains("password") & rules.contains_any(low, marks) & (F.length(low) < most)


def dead_legal_link(html: Column) -> Column:
    """Whether a link that names a policy leads nowhere, as scripts open it."""
    dead = lambda h: h.isin("", "javascript:", "javascript:void(0)") | F.endswith(h, F.lit("#"))
    return F.exists(text.anchors(F.coalesce(html, F.lit(""))), lambda a: rules.contains_any(F.lower(a["text"]), LEGAL_TEXTS) & (a["href"] != "") & dead(F.lower(F.trim(a["href"]))))


def legal_path(url: Column, tokens: list[str] = LEGAL_PATHS) -> Column:
    return rules.contains_any(_path(url), tokens)


def strong_legal(url: Column) -> Column:
    """A strong legal word in path or query; payment policies alone have none."""
    return F.concat_ws(" ", urls.path(url), urls.query(url)).rlike(STRONG_LEGAL)


def legal_page(url: Column) -> Column:
    """Whether a segment of the path is a short slug that names a legal page, and no article."""
    segments = F.filter(F.split(urls.path(url), "/"), lambda s: s != "")
    slug = lambda s: F.lower(F.replace(F.regexp_replace(s, r"\.[^.]*$", ""), F.lit("%20"), F.lit("-")))
    words = lambda s: F.filter(F.split(s, "[-_+]+"), lambda w: w != "")
    good = lambda s: (s != "") & (F.size(words(s)) <= 6) & ~F.arrays_overlap(words(s), F.lit(ARTICLE_WORDS)) & ~s.rlike(PAYMENT_SLUG) & s.rlike(LEGAL_SLUG) & ~s.rlike(NOT_LEGAL)
    return F.exists(F.transform(segments, slug), good)


def error_url(url: Column) -> Column:
    return rules.contains_any(_path(url), ERROR_PATHS) | rules.contains_any(F.lower(urls.query(url)), ERROR_KEYS)


def other_document(url: Column, patterns: list[str] = OTHER_DOCUMENTS) -> Column:
    """The first pattern of other documents that the decoded path holds, or empty."""
    path = F.lower(F.coalesce(F.try_url_decode(urls.path(url)), urls.path(url)))
    return F.coalesce(F.try_element_at(rules.contained(path, patterns), F.lit(1)), F.lit(""))


def test_host(url: Column, parts: list[str] = TEST_HOSTS) -> Column:
    """The first part of a host that names no production site, or empty."""
    return F.coalesce(F.try_element_at(rules.contained(urls.authority(url), parts), F.lit(1)), F.lit(""))


def office_label(url: Column, tokens: list[str] = OFFICE_LABELS) -> Column:
    """The first host label that is a token, or begins with it and a hyphen; empty without one."""
    first = lambda label: F.try_element_at(F.filter(F.lit(tokens), lambda t: (label == t) | F.startswith(label, F.concat(t, F.lit("-"))) | F.startswith(label, F.concat(t, F.lit("_")))), F.lit(1))
    found = F.filter(F.transform(F.split(urls.authority(url), r"\."), first), lambda t: t.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def college_label(label: Column, words: list[str] = COLLEGE_WORDS) -> Column:
    """A label that names a college: by a word, or as a short name of 3 to 6 characters with a letter."""
    low = F.lower(label)
    return rules.contains_any(low, words) | (F.length(low).between(3, 6) & low.rlike(r"\p{L}"))


def anchor_key(c: Column) -> Column:
    """The text of a link without trailing marks, lower case."""
    return F.trim(F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), "[.,;:!?\\-_>»→•·]+$", ""))


def portal_anchor(c: Column, href: Column, known: list[str] = PORTAL_TEXTS) -> Column:
    """A link whose text is a portal's; the mere word needs a path that says so."""
    key = anchor_key(c)
    return key.isin(known) | ((key == "portal") & rules.contains_any(_path(href), ["/login", "/portal"]))


def student_host(url: Column) -> Column:
    """A url whose platform serves students at a twin host of its staff's."""
    return F.regexp_replace(url, r"(?i)\.samarth\.ac\.in\b", ".samarth.edu.in")


def legal_text(body: Column, phrases: list[str] = PDF_PHRASES, least: int = 500, needed: int = 2) -> Column:
    """Text long enough and with enough phrases of terms."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return (F.length(low) >= least) & (F.size(rules.contained(low, phrases)) >= needed)


def affordance(url: Column, status: Column, password: Column, forms: Column, inputs: Column, platform: Column) -> Column:
    """Evidence that a page lets one log in: fields, a named url with a form, a platform, a refusal, or an app's own host."""
    named = F.concat_ws("?", urls.path(url), urls.query(url)).rlike(LOGIN_HINT)
    app = (status == 200) & homepage(url) & (urls.query(url) == "") & (urls.host(url) != urls.registrable(urls.host(url)))
    return password | ((forms > 0) & (inputs >= 2)) | (named & ((forms > 0) | (inputs >= 1))) | (platform & (named | (forms > 0))) | (status.isin(401, 403, 429) & url.rlike(LOGIN_HINT)) | app


def junk_portal(url: Column, marketing: list[str], patterns: str) -> Column:
    """Urls that are never a portal: content, shared sign-in, bare platforms, identity providers and mail."""
    host = urls.host(url)
    return url.rlike(patterns) | generic_sso(url) | host.isin(marketing) | host.startswith("idp.") | webmail(url)


def footer(html: Column) -> Column:
    """The footer of a page: by its tag, else the first block whose class or id says so; empty without one."""
    by_tag = F.regexp_extract(html, r"(?is)<footer[^>]*>.*?</footer>", 0)
    by_name = F.regexp_extract(html, r"""(?is)<(div|section|nav)[^>]*(?:class|id)=["'][^"']*\b(?:footer|bottom)\b[^>]*>.*?</\1>""", 0)
    return F.coalesce(F.nullif(by_tag, F.lit("")), F.nullif(by_name, F.lit("")), F.lit(""))


def maker(said: Column) -> Column:
    """Who made a site, as a text of it says; empty if it doesn't."""
    return F.trim(F.regexp_extract(said, r"(?i)(?:powered|designed|developed|maintained|crafted)\s*(?:&|and|\s)*\s*(?:by|with)\s*[:\-]?\s*([A-Za-z][\w .&'-]{2,40})", 1))


def attribution(html: Column) -> Column:
    """Who made a site, as its footer says, or the page where it has none."""
    return maker(text.visible_text(F.coalesce(F.nullif(footer(html), F.lit("")), html)))


def column_letter(n: Column, most: int = 14) -> Column:
    """The letters of a sheet's column: 1 is A, 26 Z, 27 AA, 18279 AAAA; empty below 1."""
    step = lambda s, _: F.when(s["n"] > 0, F.struct(F.floor((s["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char(F.lit(65) + (s["n"] - 1) % 26), s["said"]).alias("said"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(n.cast("long").alias("n"), F.lit("").alias("said")), step, lambda s: s["said"])
