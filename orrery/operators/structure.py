"""The structure of stored pages: elements as intervals, so that questions about a page's tree are questions about ranges.

A page's tags are read once, with a stack of open elements. Elements are numbered as they open; those inside an
element are a run of numbers (el to last), and its text is a run of characters of the page's text (text_from to
text_to). The texts between tags, stripped, stand in the page's text one after the other with SEP between them, so an element's
text with spaces, or with nothing between its parts, is one cut and one replacement. A second text, `content`,
leaves out what frames a page: CHROME elements, and forms of little text.

structured() keeps a page one row, with its elements as an array: no shuffle, and the questions are column expressions.
elements() is the same as a table.

As parsers of real pages do, a closing tag closes the nearest open element of its name and all within; one without such an element
is passed over; void and self-closed elements hold nothing; what is open at the end ends there. The closing tags of body and
html end nothing, as what follows them still belongs to the body. Comments, declarations
and the bodies of scripts, styles and templates are no text. Attributes' names are lower case, of repeated ones the last counts.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import rules
from orrery.functions.text import one_line

SEP = "\x1f"  # between two texts of a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "template")
ROOTS = ("html", "body")  # open up to the end of the page
CHROME = ("script", "style", "noscript", "nav", "header", "footer", "aside")
SMALL_FORM = 400  # characters of text below which a form is chrome
BLOCKS = ("li", "div", "p", "section", "nav")
#: Parts of ids and classes that name a page's main part.
MAIN_HINTS = ["main-wrapper", "main-content", "site-content", "page-content", "post-content", "entry-content", "content-area", "main_content", "page__content", "container-main"]
NOT_PRIMARY = ["password", "hidden", "submit", "button", "reset", "image", "file", "checkbox", "radio"]
FIELD_NAMES = ["placeholder", "aria-label", "name", "id", "title"]

_ATTRIBUTE = r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))?+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)|<([A-Za-z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE.replace("(", "(?:").replace("(?:?", "(?")})*+)>|<([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(_ATTRIBUTE)
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}


class Page:
    """Elements and texts of one page."""

    def __init__(self, html: str):
        self.tags, self.parents, self.depths, self.lasts, self.attributes = [], [], [], [], []
        self.texts, self.of, self.first_text, self.end_text = [], [], [], []  # texts and their element; per element the run of texts
        self.stack, self.counts, self.hidden, self.piece = [], Counter(), 0, []
        at, last = 0, html.rfind(">") + 1  # no tag ends behind it
        while True:
            m = TOKEN.search(html, at, last) if at < last else None
            self.said(html[at : m.start()] if m else html[at:].partition("<!--")[0])
            if m is None:
                break
            at = m.end()
            close, tag, run, odd, odd_run = m.groups()
            if close is not None:
                self.close(close.lower())
            elif tag or odd:
                name = (tag or odd).lower()
                self.open(name, run if tag else odd_run)
                if name in ENDS and self.stack and self.stack[-1] == len(self.tags) - 1:
                    stop = ENDS[name].search(html, at)
                    at = stop.start() if stop else len(html)
            else:
                self.settle()  # a comment parts two texts
        self.settle()
        while self.stack:
            self.end(self.stack.pop())

    def said(self, raw: str) -> None:
        if raw and not self.hidden:
            self.piece.append(raw)

    def settle(self) -> None:
        if self.piece:
            text = entities.unescape("".join(self.piece)).strip().replace(SEP, " ")
            self.piece = []
            if text:
                self.texts.append(text)
                self.of.append(self.stack[-1] if self.stack else -1)

    def open(self, name: str, run: str) -> None:
        self.settle()
        found, upto = {}, 0
        for a in ATTRIBUTE.finditer(run):
            value = a[2] or ""
            found[a[1].lower()] = entities.unescape(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value)
            upto = a.end()
        el = len(self.tags)
        self.tags.append(name), self.attributes.append(found)
        self.parents.append(self.stack[-1] if self.stack else -1), self.depths.append(len(self.stack))
        self.lasts.append(el), self.first_text.append(len(self.texts)), self.end_text.append(len(self.texts))
        if name not in VOID and "/" not in run[upto:]:
            self.stack.append(el)
            self.counts[name] += 1
            self.hidden += name in HIDDEN

    def end(self, el: int) -> None:
        self.lasts[el], self.end_text[el] = len(self.tags) - 1, len(self.texts)
        self.counts[self.tags[el]] -= 1
        self.hidden -= self.tags[el] in HIDDEN

    def close(self, name: str) -> None:
        self.settle()
        was = 0 if name in ROOTS else self.counts[name]
        while was and self.counts[name] == was:
            self.end(self.stack.pop())

    def offsets(self, kept: list[bool]) -> tuple[str, list[tuple[int, int]]]:
        """The kept texts with SEP between them, and each element's run of characters in it."""
        begins, ends, n = [], [0], 0  # where the next text begins, and where the last one ended
        for t, k in zip(self.texts, kept, strict=True):
            begins.append(n + 1 if n else 0)
            if k:
                n = begins[-1] + len(t)
            ends.append(n)
        begins.append(n + 1 if n else 0)
        runs = [(begins[a], max(begins[a], ends[b])) for a, b in zip(self.first_text, self.end_text, strict=True)]
        return SEP.join(t for t, k in zip(self.texts, kept, strict=True) if k), runs

    def rows(self, chrome: frozenset[str], small_form: int) -> tuple[str, str, list[dict]]:
        text, runs = self.offsets([True] * len(self.texts))
        out, kept = [False] * len(self.tags), [True] * len(self.texts)

        def drop(el: int) -> None:
            for i in range(el, self.lasts[el] + 1):
                out[i] = True
            for i in range(self.first_text[el], self.end_text[el]):
                kept[i] = False

        for el, tag in enumerate(self.tags):
            if tag in chrome and not out[el]:
                drop(el)
        sizes = self.offsets(kept)[1]
        for el, tag in enumerate(self.tags):
            if tag == "form" and not out[el] and sizes[el][1] - sizes[el][0] < small_form:
                drop(el)
        content, inner = self.offsets(kept)
        return text, content, [
            {"el": i + 1, "tag": tag, "parent": p + 1, "depth": d, "last": last + 1, "attrs": list(attrs.items()), "text_from": a, "text_to": b, "dropped": o, "content_from": x, "content_to": y}
            for i, (tag, p, d, last, attrs, (a, b), o, (x, y)) in enumerate(zip(self.tags, self.parents, self.depths, self.lasts, self.attributes, runs, out, inner, strict=True))
        ]


ELEMENT = [
    ("el", pa.int32(), "int"), ("tag", pa.string(), "string"), ("parent", pa.int32(), "int"), ("depth", pa.int32(), "int"), ("last", pa.int32(), "int"), ("attrs", pa.map_(pa.string(), pa.string()), "map<string,string>"),
    ("text_from", pa.int32(), "int"), ("text_to", pa.int32(), "int"), ("dropped", pa.bool_(), "boolean"), ("content_from", pa.int32(), "int"), ("content_to", pa.int32(), "int"),
]
ROWS = 100  # pages whose elements are handed on together


def structured(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id",), chrome: tuple[str, ...] = CHROME, small_form: int = SMALL_FORM) -> DataFrame:
    """The columns `keep` of each page, its text and content, and its elements in the order in which they open.

    An element has its number el (from 1), tag, parent (0 for none), depth, the number of the last element inside it,
    attrs, its runs in text and content (code points, end exclusive), and whether it is dropped from content. A null
    or empty page has no elements and an empty text. Repeated rows stay.
    """
    kind, dropped = pa.struct([(n, t) for n, t, _ in ELEMENT]), frozenset(chrome)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [Page(x or "").rows(dropped, small_form) for x in part.column("__html").to_pylist()]
                texts, contents, elements = zip(*found, strict=True)
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(contents, pa.string()), pa.array(elements, pa.list_(kind))], [*keep, "text", "content", "elements"])

    source = pages.select(*keep, F.col(html).alias("__html"))
    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kept}, text string, content string, elements array<struct<{', '.join(f'{n}:{t}' for n, _, t in ELEMENT)}>>")


def elements(pages: DataFrame, **options) -> DataFrame:
    """A row per element of each page, with its text."""
    found = structured(pages, **options)
    rest = [c for c in found.columns if c not in ("text", "content", "elements")]
    return found.select(*rest, F.col("text").alias("__text"), F.explode("elements").alias("e")).select(*rest, "e.*", text_of(F.col("e"), F.col("__text")).alias("text")).drop("content_from", "content_to")


# Questions about one page, as expressions over its row.


def text_of(element: Column, text: Column, between: str = " ") -> Column:
    """An element's text, its parts joined by `between`."""
    return F.replace(F.substring(text, element["text_from"] + 1, element["text_to"] - element["text_from"]), F.lit(SEP), F.lit(between))


def content_of(element: Column, content: Column) -> Column:
    """An element's text without chrome."""
    return F.replace(F.substring(content, element["content_from"] + 1, element["content_to"] - element["content_from"]), F.lit(SEP), F.lit(" "))


def first(found: Column, holds) -> Column:
    """The first element that `holds`; null without one."""
    return F.try_element_at(F.filter(found, holds), F.lit(1))


def tagged(*tags: str):
    """The condition that an element has one of the tags."""
    return lambda e: e["tag"].isin(*tags)


def inside(found: Column, element: Column) -> Column:
    """The elements within one, itself included; none of a null element."""
    return F.coalesce(F.slice(found, element["el"], element["last"] - element["el"] + 1), F.slice(found, F.lit(1), F.lit(0)))


def attribute(element: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(element["attrs"], F.lit(name)), F.lit(""))


def named(element: Column) -> Column:
    """Id and classes of an element, lower case."""
    return F.lower(F.concat_ws(" ", attribute(element, "id"), attribute(element, "class")))


def main_text(found: Column, content: Column, *, least: int = 100, hints: list[str] = MAIN_HINTS, lower: int = 200, upper: int = 100_000) -> Column:
    """The text of a page's main part, on one line.

    The first <main>, else the first <article>, else the first with role=main, if its text without chrome has `least`
    characters; else the longest div or section (the first of equals) whose id or class holds a hint and whose text
    is between `lower` and `upper` long; else the body; else the page.
    """
    live = F.filter(found, lambda e: ~e["dropped"])
    long = lambda e: e["content_to"] - e["content_from"]
    steps = [first(live, tagged(t)) for t in ("main", "article")] + [first(live, lambda e: attribute(e, "role") == "main")]
    hinted = F.filter(live, lambda e: e["tag"].isin("div", "section") & rules.contains_any(named(e), hints) & (long(e) > lower) & (long(e) < upper))
    largest = F.array_max(F.transform(hinted, lambda e: F.struct(long(e).alias("size"), (-e["el"]).alias("before"))))
    out = F.coalesce(content_of(first(live, tagged("body")), content), F.replace(content, F.lit(SEP), F.lit(" ")))
    out = F.coalesce(content_of(F.try_element_at(found, -largest["before"]), content), out)
    for step in reversed(steps):
        out = F.when(long(step) >= least, content_of(step, content)).otherwise(out)
    return one_line(out)


def footer(found: Column, pattern: str = r"(?i)\b(footer|site-footer|bottom)\b") -> Column:
    """The element that is a page's footer: the first <footer>, else the first div, section or nav by a class, then by its id; null without one."""
    steps = [first(found, tagged("footer"))]
    for tag in ("div", "section", "nav"):
        for name in ("class", "id"):
            steps.append(first(F.filter(found, tagged(tag)), lambda e: attribute(e, name).rlike(pattern)))  # noqa: B023
    return F.coalesce(*steps)


def headings(found: Column, text: Column, each: int = 3) -> Column:
    """The title and the first few headings of each of three levels, joined by spaces."""
    parts = [F.slice(F.filter(found, tagged(tag)), 1, 1 if tag == "title" else each) for tag in ("title", "h1", "h2", "h3")]
    said = [F.transform(p, lambda e: text_of(e, text, "")) for p in parts]
    return F.array_join(F.filter(F.concat(*said), lambda t: t != ""), " ")


def control_names(found: Column) -> Column:
    """The names and ids of forms and inputs."""
    controls = F.filter(found, tagged("form", "input"))
    return F.filter(F.flatten(F.transform(controls, lambda e: F.array(attribute(e, "name"), attribute(e, "id")))), lambda n: n != "")


def labels_for(found: Column, text: Column, identifier: Column) -> Column:
    """The texts of the labels of the control of that id."""
    own = F.filter(found, lambda e: (e["tag"] == "label") & (identifier != "") & (attribute(e, "for") == identifier))
    return F.filter(F.transform(own, lambda e: text_of(e, text)), lambda t: t != "")


def primary_field(found: Column, text: Column, near: int = 100) -> Column:
    """What is said about the first input that one types into: its attributes, its labels, and the begin of its parent's text; lower case, empty without one."""
    field = first(found, lambda e: (e["tag"] == "input") & ~F.lower(F.trim(F.coalesce(F.nullif(attribute(e, "type"), F.lit("")), F.lit("text")))).isin(*NOT_PRIMARY))
    attributes = F.filter(F.array(*[attribute(field, a) for a in FIELD_NAMES]), lambda v: v != "")
    parent = F.substring(F.coalesce(text_of(F.try_element_at(found, F.nullif(field["parent"], F.lit(0))), text), F.replace(text, F.lit(SEP), F.lit(" "))), 1, near)
    said = F.concat(attributes, labels_for(found, text, attribute(field, "id")), F.filter(F.array(parent), lambda t: t != ""))
    return F.when(field.isNotNull(), F.lower(F.array_join(said, " "))).otherwise("")


def field_words(found: Column, text: Column) -> Column:
    """The texts of all labels and what the attributes of all inputs say, lower case."""
    labels = F.filter(F.transform(F.filter(found, tagged("label")), lambda e: text_of(e, text)), lambda t: t != "")
    values = F.flatten(F.transform(F.filter(found, tagged("input")), lambda e: F.array(*[attribute(e, a) for a in FIELD_NAMES])))
    return F.lower(F.array_join(F.concat(labels, F.filter(values, lambda v: v != "")), " "))


def form_audience(found: Column, text: Column, *, others: list[str], identity: list[str], context: list[str], needed: int = 2) -> Column:
    """Whom a login form is for: a struct of verdict and reason.

    What the field to type into says comes first (`others`), then an identity in any label or input, then words of
    context in the page's text, of which `needed` count. Without all of these a form isn't for students; a page without text is ambiguous.
    """
    given = F.struct(primary_field(found, text).alias("primary"), field_words(found, text).alias("fields"), F.lower(F.replace(text, F.lit(SEP), F.lit(" "))).alias("body"))

    def judged(g: Column) -> Column:
        hit = F.struct(*[F.try_element_at(rules.contained(g[c], words), F.lit(1)).alias(c) for c, words in (("primary", others), ("fields", identity))], rules.contained(g["body"], context).alias("around"), g["body"].alias("body"))
        return F.transform(F.array(hit), decided)[0]

    def decided(h: Column) -> Column:
        other, own, n = h["primary"], h["fields"], F.size(h["around"])
        verdict = rules.first_of([(other.isNotNull(), "non_student"), (own.isNotNull(), "student"), (h["body"] == "", "ambiguous"), (n >= needed, "student")], "non_student")
        reason = F.when(other.isNotNull(), F.concat(F.lit("primary field: "), other)).when(own.isNotNull(), F.concat(F.lit("identity field: "), own)).when(h["body"] == "", F.lit("no text"))
        reason = reason.when(n >= needed, F.concat(F.lit("context: "), h["around"][0])).otherwise(F.lit("no identity field or context"))
        return F.struct(verdict.alias("verdict"), reason.alias("reason"))

    return F.transform(F.array(given), judged)[0]  # bound in a transform, so that each part is computed once


def links_in_context(pages: DataFrame, within=None, blocks: tuple[str, ...] = BLOCKS) -> DataFrame:
    """A row per link of structured() pages: pos, href, text and parent_text (parts joined by nothing), and in_footer.

    The parent is the nearest element around the link of a kind in `blocks`. `within` names the element whose links are
    wanted, as an expression over elements; a page where it is null has none.
    """
    found = F.col("elements")
    links = F.filter(found if within is None else inside(found, within(found)), lambda e: (e["tag"] == "a") & F.map_contains_key(e["attrs"], F.lit("href")))
    foot = footer(found)
    rest = [c for c in pages.columns if c not in ("text", "content", "elements")]
    open_blocks = F.filter(found, tagged(*blocks))
    rows = pages.select(*rest, F.col("text").alias("__text"), open_blocks.alias("__blocks"), foot.alias("__foot"), F.posexplode(links).alias("pos", "e"))
    # the last block that opened before the link and ends after it is the nearest
    around = F.try_element_at(F.filter("__blocks", lambda b: (b["el"] < F.col("e.el")) & (b["last"] >= F.col("e.last"))), F.lit(-1))
    e = F.col("e")
    return rows.select(
        *rest, "pos", attribute(e, "href").alias("href"), text_of(e, F.col("__text"), "").alias("text"), F.coalesce(text_of(around, F.col("__text"), ""), F.lit("")).alias("parent_text"),
        F.coalesce(e["el"].between(F.col("__foot.el"), F.col("__foot.last")), F.lit(False)).alias("in_footer"),
    )
