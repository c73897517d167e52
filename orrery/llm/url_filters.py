"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path with the literal tokens (runs of ASCII letters and digits) that
every URL it fits must hold as whole tokens. The index keeps each rule under that one of its tokens that is
rarest among the URLs at hand; a URL's tokens fetch the candidate rules, and only those run their expression.

Up to MAX_INLINE rules travel inside the plan, and all URL work is local to a row: one narrow projection, no shuffle,
no Python. Longer lists are tables (rule_table reads lines of a published syntax): their index meets the tokens of
the distinct URLs by an equi join, and whatever fits is carried back to the rows.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ascii_lower, stored

TOKEN = "[A-Za-z0-9]+"
ENTRY = "struct<token:string,regex:string,rank:int,name:string,verdict:string,kind:string>"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    kind: str  # "rule": host and path prefix; "pattern": glob, asked only where no rule fits
    regex: str
    tokens: tuple[str, ...]

    @property
    def rank(self) -> int:
        return len(self.name) + (1 << 20) * (self.kind == "rule")


def host_path_rule(name: str, verdict: str) -> Rule:
    """`example.net/en/`: the host and its subdomains, and paths that start with `/en/`."""
    host, slash, path = name.partition("/")
    return Rule(name, verdict, "rule", rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", _whole(f".{host}/{path}", not path or not path[-1:].isalnum()))


def glob_rule(glob: str, verdict: str) -> Rule:
    """`*` stands for any run of characters, `^` for the start, the end or anything but a letter or digit."""
    parts = {"*": "[^\\x00]*", "^": "(?:^|$|[^A-Za-z0-9])"}
    # a token beside a star, or at an open end, may be part of a longer one
    tokens = tuple(m[0] for m in re.finditer(TOKEN, glob) if glob[m.start() - 1 : m.start()] not in ("", "*") and glob[m.end() : m.end() + 1] not in ("", "*"))
    return Rule(glob, verdict, "pattern", "".join(parts.get(c, re.escape(c)) for c in glob), tokens)


def _whole(literal: str, closed: bool) -> tuple[str, ...]:
    runs = list(re.finditer(TOKEN, literal))
    return tuple(m[0] for m in runs if closed or m.end() < len(literal))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def token_counts(df: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """Number of rows whose URL holds each token of the rules: at most as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    host, path = split_url(F.col(url))
    tokens = F.array_intersect(F.regexp_extract_all(F.concat(host, path), F.lit(TOKEN), F.lit(0)), F.lit(wanted))
    return {r["t"]: r["n"] for r in df.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, Column, int]:
    """Buckets of rules by their rarest token, the rules that have none, and the number of buckets."""
    size = max(1, len(rules))
    buckets: list[list[dict]] = [[] for _ in range(size)]
    loose = []
    for r in rules:
        entry = {"regex": r.regex, "rank": r.rank, "name": r.name, "verdict": r.verdict, "kind": r.kind}
        if r.tokens:
            t = min(r.tokens, key=lambda x: (counts.get(x, 0), x))
            buckets[zlib.crc32(t.encode()) % size].append({"token": t} | entry)
        else:
            loose.append({"token": ""} | entry)
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  folded to a constant by the optimizer
    return literal(buckets, f"array<array<{ENTRY}>>"), literal(loose, f"array<{ENTRY}>"), size


def filter_urls(df: DataFrame, rules: list[Rule], *, url: str = "url", default: str = "allow") -> DataFrame:
    """df's rows with host, path, rule, pattern and verdict.

    The longest fitting host-and-path rule decides; where none fits, the longest fitting glob; else `default`.
    Equal lengths: the name that is last by code point. A null URL or one without `://` has empty host and path,
    no token, and so gets `default` unless a rule without tokens fits the empty string. Repeated rows are judged
    alike; columns of df that are named like a result are replaced. An empty table gives no rows.
    """
    index, loose, size = rule_index(rules, token_counts(df, url, rules))
    host, path = split_url(F.col(url))
    subject = F.concat(host, path)
    tokens = F.array_distinct(F.regexp_extract_all(subject, F.lit(TOKEN), F.lit(0)))
    at = lambda t: F.element_at(index, (F.crc32(t.cast("binary")) % size + 1).cast("int"))
    fetched = F.flatten(F.transform(tokens, lambda t: F.filter(at(t), lambda e: e["token"] == t)))
    fits = F.filter(F.concat(fetched, loose), lambda e: F.rlike(subject, e["regex"]))
    best = F.array_max(F.transform(fits, lambda e: F.struct(e["rank"].alias("rank"), e["name"].alias("name"), e["verdict"].alias("verdict"), e["kind"].alias("kind"))))
    rest = [c for c in df.columns if c not in ("host", "path", "rule", "pattern", "verdict")]
    return df.select(*[F.col(f"`{c}`") for c in rest], host.alias("host"), path.alias("path"), best.alias("__best")).select(
        *[F.col(f"`{c}`") for c in rest], "host", "path",
        F.when(F.col("__best.kind") == "rule", F.col("__best.name")).alias("rule"),
        F.when(F.col("__best.kind") == "pattern", F.col("__best.name")).alias("pattern"),
        F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"),
    )


#: Fixed by the contract.
HOST_RULES = [host_path_rule("net/", "block"), host_path_rule("example.net/en/", "allow"), host_path_rule("example.com/de/", "block"), host_path_rule("org/fr/", "allow")]
#: What the method adds where no rule fits: link farms and shops that spam names in a host or path.
SPAM_GLOBS = [glob_rule(g, "block") for g in ("^cheap-pills^", "^spam-farm^", "^casino^", "^free-money^", "^xxx^")]


MAX_INLINE = 2_000
BOUNDARY = "(?:^|$|[^A-Za-z0-9_.%-])"


def rule_table(lines: DataFrame, *, line: str = "line") -> DataFrame:
    """name, verdict, rank, regex and tokens of the rules in lines of a filter list, as ad blockers and hosts files have them.

    `||host^` and `||host/path` stand for a host, its subdomains and paths that start so; `*` for any run, `^` for an
    end or anything but a letter, digit or one of `_.%-`; `|` at the start or end for the URL's; `@@` allows. Lines
    such as `0.0.0.0 host` block the host. Options after `$` are left off. Comments, headers, empty and null lines
    and repeated rules go. Longer rules win, and of equally long ones the last by name; an allowing rule wins over
    any that blocks.
    """
    text = F.trim(F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\s+#.*$|\$[^/$]*$", ""))
    host = F.regexp_extract(text, r"^(?:0\.0\.0\.0|127\.0\.0\.1)\s+(\S+)$", 1)
    rows = lines.select(F.when(host != "", F.concat(F.lit("||"), host, F.lit("^"))).otherwise(text).alias("name"))
    rows = rows.filter((F.col("name") != "") & ~F.col("name").rlike(r"^[!#\[]") & ~F.col("name").rlike(r"\s")).distinct()
    allow = F.col("name").startswith("@@")
    body = F.when(allow, F.expr("substring(name, 3)")).otherwise(F.col("name"))
    rows = rows.select("name", F.when(allow, "allow").otherwise("block").alias("verdict"), (F.length("name") + F.when(allow, 1 << 20).otherwise(0)).alias("rank"), body.alias("body"))
    # the whole tokens: none at an open end or beside a star
    closed = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", r"^(?![|])", "*"), r"(?<![\^|])$", "*"), r"^\|+", ".")
    tokens = F.array_distinct(F.regexp_extract_all(closed, F.lit(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])"), F.lit(0)))
    escaped = F.regexp_replace("body", r"([.+?{}()\[\]\\$])", r"\\$1")
    regex = F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"(?<!^)\^|^\^", BOUNDARY.replace("$", r"\$"))
    regex = F.regexp_replace(F.regexp_replace(F.regexp_replace(regex, r"^\|\|", r"^(?:[^/]*\\.)?"), r"^\|", "^"), r"\|$", r"\$")
    return rows.select("name", "verdict", "rank", regex.alias("regex"), tokens.alias("tokens"))


def filter_by_table(df: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", most_loose: int = MAX_INLINE) -> DataFrame:
    """df's rows with host, path, pattern (the deciding rule's name, or null) and verdict, by a rule_table().

    Each rule stands in the index under that one of its tokens that fewest distinct URLs have. Rules without a token
    are asked of every URL; more than `most_loose` of them are an error. A null URL or one without `://` has empty
    host and path. Repeated rows are judged alike; columns named like a result are replaced. Empty tables of rows or
    rules give no rows, or the default for all.
    """
    host, path = split_url(F.col(url))
    urls = stored(df.select(F.concat(host, path).alias("subject")).distinct(), "urls")
    tokens = urls.select("subject", F.explode(F.array_distinct(F.regexp_extract_all("subject", F.lit(TOKEN), F.lit(0)))).alias("token"))
    wanted = rules.select("name", F.explode("tokens").alias("token"))
    counts = tokens.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = rules.join(rarest, "name").select("token", "name", "verdict", "rank", "regex")
    loose = rules.filter(F.size("tokens") == 0).select("name", "verdict", "rank", "regex")
    alone = loose.limit(most_loose + 1).collect()
    if len(alone) > most_loose:
        raise ValueError(f"more than {most_loose} rules have no token")
    candidates = tokens.join(index, "token").select("subject", "name", "verdict", "rank", "regex")
    if alone:
        given = F.from_json(F.lit(json.dumps([x.asDict() for x in alone])), "array<struct<name:string,verdict:string,rank:int,regex:string>>")
        candidates = candidates.unionByName(urls.select("subject", F.inline(given)))
    fits = candidates.filter(F.rlike("subject", F.col("regex")))
    best = fits.groupBy("subject").agg(F.max(F.struct("rank", "name", "verdict")).alias("__best"))
    rest = [c for c in df.columns if c not in ("host", "path", "pattern", "verdict")]
    keyed = df.select(*[F.col(f"`{c}`") for c in rest], host.alias("host"), path.alias("path"), F.concat(host, path).alias("__subject"))
    out = keyed.join(best.withColumnRenamed("subject", "__subject"), "__subject", "left")
    return out.select(*[F.col(f"`{c}`") for c in rest], "host", "path", F.col("__best.name").alias("pattern"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))
