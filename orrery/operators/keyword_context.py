"""Verdicts on a text from keywords and the words around them.

Keywords are taken the longest first (equal lengths by the alphabet). An occurrence inside one that is already
counted is passed over. Phrases in the window around an occurrence decide: a negating one drops it and the next
occurrence is tried; else it is permissive, prohibitive or ambiguous, and the keyword is done. A strong keyword
counts as prohibitive unless nothing that it could be about stands near; a weak one counts as its window says.

What is covered carries over from keyword to keyword, so a text is judged in one pass by a small function, in Arrow
batches; the function holds no state between texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import short_clause


@dataclass(frozen=True)
class Terms:
    strong: list[str]
    weak: list[str]
    objects: list[str]
    exempt: list[str] = field(default_factory=list)  # strong ones that need no object near
    negating: list[str] = field(default_factory=list)
    permissive: list[str] = field(default_factory=list)
    prohibitive: list[str] = field(default_factory=list)
    near: tuple[int, int, int] = (40, 50, 90)  # characters on each side: strong, weak, objects


EXAMPLE = Terms(
    strong=["scrape", "scraping", "crawl", "crawling", "data mining", "harvest"], weak=["archive", "index", "extract"], objects=["data", "website", "content", "records"],
    exempt=["scrape", "scraping", "crawl", "crawling", "data mining", "harvest"], negating=["without harvest"], permissive=["is permitted"], prohibitive=["may not", "must not"],
)


def _pattern(keyword: str) -> re.Pattern[str]:
    return re.compile(r"(?<![\w-])" + r"\s+".join(map(re.escape, keyword.split())) + r"(?![\w-])", re.IGNORECASE)


def occurrences(text: str, terms: Terms) -> tuple[list[tuple[str, str, str, int, int]], bool]:
    """term, strength, context, start and end of each keyword that counts, in the order of the keywords; and whether a
    strong one stands in a negating or permissive window."""
    low, covered, out, conflict = text.lower(), [], [], False
    some = lambda phrases, a, b, n: any(p in low[max(0, a - n) : b + n] for p in phrases)
    for strength, words, n in (("strong", terms.strong, terms.near[0]), ("weak", terms.weak, terms.near[1])):
        for word in sorted(words, key=lambda w: (-len(w), w)):
            for m in _pattern(word).finditer(text):
                a, b = m.span()
                if any(a >= x and b <= y for x, y in covered):
                    continue
                negated = some(terms.negating, a, b, n)
                conflict |= strength == "strong" and (negated or some(terms.permissive, a, b, n))
                if negated:
                    continue
                if strength == "strong":
                    about = word in terms.exempt or some(terms.objects, a, b, terms.near[2])
                    context = "prohibitive" if about else "ambiguous"
                else:
                    context = "permissive" if some(terms.permissive, a, b, n) else "prohibitive" if some(terms.prohibitive, a, b, n) else "ambiguous"
                covered.append((a, b))
                out.append((word, strength, context, a, b))
                break
    return out, conflict


def quote(text: str, start: int, end: int, most: int = 200) -> str:
    """The words around a place, on one line."""
    return " ".join(text[max(0, start - most // 2) : end + most // 2].split())[:most]


FOUND = ["term", "strength", "context", "start", "end", "quote"]


def judge(df: DataFrame, terms: Terms, *, key: str, text: str) -> DataFrame:
    """key, found (term, strength, context, start, end, quote), verdict (No, Maybe or Yes), confidence, conflict, evidence, reason and clause.

    A null text is empty and gives Yes. Repeated rows are judged alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int32() if c in ("start", "end") else pa.string()) for c in FOUND]))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            judged = [occurrences(t, terms) for t in texts]
            rows = [[dict(zip(FOUND, (*x, quote(t, x[3], x[4])), strict=True)) for x in found] for t, (found, _) in zip(texts, judged, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, kind), pa.array([c for _, c in judged], pa.bool_())], ["key", "found", "conflict"])

    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, found array<struct<term:string,strength:string,context:string,start:int,end:int,quote:string>>, conflict boolean")
    hits = lambda strength: F.filter("found", lambda m: (m["strength"] == strength) & (m["context"] == "prohibitive"))
    strong, weak, unclear = F.size(hits("strong")), F.size(hits("weak")), F.exists("found", lambda m: m["context"] == "ambiguous")
    named = lambda strength: F.array_join(F.slice(F.transform(hits(strength), lambda m: m["term"]), 1, 3), ", ")
    ladder = [
        (strong >= 2, "No", 0.95, F.concat(F.lit("explicit prohibitive language: "), named("strong"))), (strong == 1, "No", 0.8, F.concat(F.lit("explicit prohibitive language: "), named("strong"))),
        (weak >= 2, "No", 0.7, F.concat(F.lit("several terms in restrictive context: "), named("weak"))), (weak == 1, "Maybe", 0.4, F.lit("a single restrictive term")), (unclear, "Maybe", 0.35, F.lit("terms in unclear context")),
    ]
    verdict, confidence, reason = F.lit("Yes"), F.lit(0.9), F.lit("no prohibitive language")
    for when, v, c, why in reversed(ladder):
        verdict, confidence, reason = F.when(when, v).otherwise(verdict), F.when(when, c).otherwise(confidence), F.when(when, why).otherwise(reason)
    first = F.try_element_at(F.filter("found", lambda m: m["context"] == "prohibitive"), F.lit(1))["quote"]
    return found.select(F.col("key").alias(key), "found", verdict.alias("verdict"), confidence.alias("confidence"), "conflict", evidence(F.col("found")).alias("evidence"), reason.alias("reason"), short_clause(F.coalesce(first, F.lit(""))).alias("clause"))


def evidence(found: Column, shown: int = 3, most: int = 500) -> Column:
    """The number of matches, the first ones with context and a piece of their quote, and how many more there are."""
    show = lambda m: F.concat(m["term"], F.lit(" ("), m["context"], F.lit(", '"), F.translate(F.substring(m["quote"], 1, 80), "'", "\u02bc"), F.lit("')"))
    n = F.size(found)
    out = F.concat(n.cast("string"), F.lit(" matches: "), F.array_join(F.transform(F.slice(found, 1, shown), show), "; "), F.when(n > shown, F.concat(F.lit(" ...and "), (n - shown).cast("string"), F.lit(" more"))).otherwise(""))
    cut = F.concat(F.rtrim(F.substring(out, 1, most - 3)), F.lit("..."))
    return F.when(n == 0, "No restrictive keywords found").when(F.length(out) > most, cut).otherwise(out)
