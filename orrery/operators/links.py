"""Links of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import rules, sites, urls
from orrery.functions.text import anchors
from orrery.operators import structure
from orrery.operators.dedup import not_in, top


def absolute(href: Column, base: Column) -> Column:
    """A link made absolute: with a scheme, from the root, or from the folder of the base."""
    folder = F.regexp_replace(urls.path(base), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(urls.scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(urls.base_host(base), href))
        .otherwise(F.concat(urls.base_host(base), F.when(folder == "", "/").otherwise(folder), href))
    )


def page_links(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per link: page, pos, base, href, text, target (absolute), and its host."""
    found = pages.select(page, F.col(url).alias("base"), F.posexplode(anchors(F.col(html))).alias("pos", "a"))
    found = found.select(page, "pos", "base", F.col("a.href").alias("href"), F.col("a.text").alias("text"), absolute(F.col("a.href"), F.col("base")).alias("target"))
    return found.withColumn("target_host", urls.host(F.col("target")))


def outbound(links: DataFrame) -> DataFrame:
    """Links to other hosts than their page's."""
    return links.filter(F.col("target").rlike("(?i)^https?://") & (F.col("target_host") != urls.host(F.col("base"))))


def links_back(links: DataFrame, page: str = "page_id") -> DataFrame:
    """Per page whether any link leads to its own host."""
    own = F.col("target_host") == urls.host(F.col("base"))
    return links.groupBy(page).agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("links_back"))


def followups(links: DataFrame, seen: DataFrame, *, page: str = "page_id", key: str = "key", cap: int = 3) -> DataFrame:
    """Per page the first `cap` distinct targets whose key no page has yet."""
    keyed = links.filter(F.col("target").rlike("(?i)^https?://")).withColumn(key, urls.dedup_key(F.col("target")))
    fresh = top(not_in(keyed, seen, [key]), [page, key], [F.col("pos")])
    return top(fresh, [page], [F.col("pos")], cap)


def footer_links(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """As page_links(), of the links inside each page's footer."""
    found = structure.links_in_context(structure.structured(pages, html=html, keep=(page, url)), within=structure.footer)
    found = found.select(page, "pos", F.col(url).alias("base"), "href", "text", absolute(F.col("href"), F.col(url)).alias("target"))
    return found.withColumn("target_host", urls.host(F.col("target")))


def two_levels(links: DataFrame, stored: DataFrame, *, page: str = "page_id", key: str = "key") -> DataFrame:
    """page, key and level of the distinct targets of each page (1), and of the stored pages that it links to (2).

    stored: page and key. Links of a page to itself lead nowhere; of two levels the first counts.
    """
    out = links.filter(F.col("target").rlike("(?i)^https?://")).select(page, urls.dedup_key(F.col("target")).alias(key)).distinct()
    via = out.join(stored.select(F.col(page).alias("__via"), key), key).filter(F.col("__via") != F.col(page)).select(page, "__via").distinct()
    second = via.join(out.select(F.col(page).alias("__via"), key), "__via").select(page, key)
    both = out.withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2)))
    return both.groupBy(page, key).agg(F.min("level").alias("level"))


def legal_set(df: DataFrame, *, host: str, category: str, path: str, strong: str, order: list[Column], cap: int = 4) -> DataFrame:
    """Per host one row of each category (of none: of each path), at most `cap`; a host without any strong row has none."""
    one = top(df.withColumn("__key", F.coalesce(category, path)), [host, "__key"], order).drop("__key")
    good = one.groupBy(host).agg(F.bool_or(strong).alias("__strong")).filter("__strong").select(host)
    return top(one.join(good, host, "left_semi"), [host], order, cap)


#: Words around a link that speak against a portal for students.
NOT_PORTAL = ["alumni", "faculty only", "staff only", "recruitment", "vendor", "tender", "rti", "employee", "admin"]


def siblings(pages: DataFrame, *, primary: str, blocked: list[str], known: list[str] = sites.PORTAL_TEXTS, against: list[str] = NOT_PORTAL, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The other hosts that a home page links to: page, host, portal_url (the first link to it that reads as a portal, else null) and n_links.

    primary names the column with the page's own host; it, hosts below it and those under `blocked` are no siblings. A
    link reads as a portal by its whole text, unless the block around it says whom else it is for.
    """
    structured = structure.structured(pages, html=html, keep=(page, url, primary))
    found = structure.links_in_context(structured, blocks=("li", "div", "p", "nav", "section", "aside"))
    found = found.withColumn("target", absolute(F.trim("href"), F.col(url))).filter((F.trim("href") != "") & F.col("target").rlike("(?i)^https?://") & ~F.col("href").rlike("^(#|mailto:|tel:|javascript:)"))
    found = found.withColumns({"host": urls.host(F.col("target")), "__own": urls.host(F.col(primary))})
    found = found.filter((F.col("host") != "") & (F.col("host") != F.col("__own")) & ~F.endswith("host", F.concat(F.lit("."), "__own")) & ~urls.under(F.col("host"), blocked))
    portal = sites.portal_anchor(F.col("text"), F.col("target"), known) & ~rules.contains_any(F.lower("parent_text"), against)
    return found.groupBy(page, "host").agg(F.min_by(F.when(portal, F.col("target")), F.when(portal, F.col("pos"))).alias("portal_url"), F.count("*").alias("n_links"))
