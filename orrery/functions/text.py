"""Names, cells and web pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def slug(c: Column, most: int = 70) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit("x"))


def acronym(c: Column, skip: tuple[str, ...] = ("of", "and", "the", "for", "in"), least: int = 3) -> Column:
    """Initials of the words but `skip`; '' if there are fewer than `least`."""
    words = F.filter(F.split(name_key(c), " "), lambda w: (w != "") & ~w.isin(*skip))
    out = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.length(out) >= least, out).otherwise("")


def cell_items(c: Column, between: str = "[\\r\\n,]+") -> Column:
    """The trimmed non-empty items of a cell with many values."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), between), lambda x: F.trim(x)), lambda x: x != "")


def cell_urls(c: Column) -> Column:
    """The http items of a cell; none if it says that there is no portal."""
    items = F.filter(cell_items(c), lambda x: F.lower(x).startswith("http"))
    return F.when(F.lower(F.coalesce(c, F.lit(""))).contains("no portal"), F.slice(items, 1, 0)).otherwise(items)


def id_text(c: Column) -> Column:
    """An id as text, without the `.0` that spreadsheets add."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(""))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title(html: Column) -> Column:
    return one_line(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def generator(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)""", 1))


def visible_text(html: Column) -> Column:
    """The text between tags, scripts and styles apart, on one line."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return one_line(F.regexp_replace(bare, r"<[^>]+>", " "))


def main_text(html: Column, least: int = 100) -> Column:
    """The visible text of a page's main part: of its <main> or <article> if that is long enough, else of all but its chrome.

    Chrome are scripts, styles, navigation, headers, footers and asides.
    """
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|nav|header|footer|aside)[^>]*>.*?</\1>", " ")
    parts = [visible_text(F.regexp_extract(bare, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)) for tag in ("main", "article")]
    out = visible_text(bare)
    for p in reversed(parts):
        out = F.when(F.length(p) >= least, p).otherwise(out)
    return out


def anchors(html: Column) -> Column:
    """The links of a page in order: array of href and text."""
    pattern = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    hrefs, texts = (F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(hrefs.alias("href"), texts.alias("text")), lambda a: F.struct(a["href"].alias("href"), one_line(F.regexp_replace(a["text"], "<[^>]+>", " ")).alias("text")))


def fingerprint(body: Column, most: int = 200) -> Column:
    """MD5 of the first bytes of a body."""
    return F.md5(F.substring(F.encode(F.coalesce(body, F.lit("")), "UTF-8"), 1, most))


def short_clause(c: Column, most: int = 14) -> Column:
    return F.array_join(F.slice(F.split(one_line(c), " "), 1, most), " ")


def keyword_pattern(keyword: str) -> str:
    """A keyword that hyphens and letters don't extend; any white space between its words."""
    import re

    return r"(?U)(?i)(?<![\w-])" + r"\s+".join(map(re.escape, keyword.split())) + r"(?![\w-])"
