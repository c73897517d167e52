"""Secret scans with corpus-wide ownership.

Candidates are found by patterns in whole texts. Their hashes are then aggregated over the corpus by distinct
repositories and owners: a value that many owners or many repositories hold is a copied example, one that few hold
looks live. Base patterns always report; the wider pattern reports a span only if its value is live. Where tables
name no repositories, distinct texts stand for them, so an example that is copied within one owner counts too, and
exact copies of one text count once.

Positions come from built-in functions: the pieces between matches and the matches alternate, so their lengths,
summed up, are the offsets in code points. No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import stored

#: Base patterns, fixed by the contract: kind, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: What the method adds: prefixes of token issuers, signed web tokens and long mixed strings.
WIDE = ("owned", r"(?:gh[pousr]_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*|[A-Za-z0-9+/_-]{32,})", 0, 1)
#: As BASE and WIDE, but without matches that are dropped anyway, and long runs are only tried where they begin: at a
#: character that follows none of its class, or at the end of the last match.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}", "owned": WIDE[1].replace("|[A-Za-z0-9+/_-]{32,}", r"|(?:(?<![A-Za-z0-9+/_-])|\G)[A-Za-z0-9+/_-]{32,}")}
MAX_OWNERS, MAX_REPOSITORIES = 5, 20  # that hold a live value
SALTS = 16  # tasks that share the rows of one value
LIVE_CHARS = 8  # a live value has at least so many different characters, a digit and a letter
SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"


def matches(text: Column, kind: str, pattern: str, group: int, least: int, ord_: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has `least` characters, as array<SPAN>."""
    pattern = FAST.get(kind, pattern)
    whole, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("len"), inner.alias("value"))
    empty = F.from_json(F.lit("[]"), f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(empty)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind as listed; the fields of spans begin with start and ord."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(df: DataFrame, doc_id: str | None, text: str, owner: str, repository: Column) -> DataFrame:
    """A row per document: its id (null if it isn't asked for), owner, repository, base spans and wider candidates that touch no base span."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[matches(F.col("t"), kind, pattern, group, least, k) for k, (kind, pattern, group, least) in enumerate(BASE)])
    wide = matches(F.col("t"), *WIDE, len(BASE))
    rows = df.select((F.col(doc_id) if doc_id else F.lit(None)).alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), repository.alias("repository"), t.alias("t"))
    rows = rows.select("doc_id", "owner", "repository", F.md5("t").alias("text_key"), base.alias("base"), wide.alias("wide"))
    free = F.filter("wide", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    live = lambda w: w["value"].rlike("[0-9]") & w["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(w["value"], ""))) >= LIVE_CHARS)
    rows = rows.select("doc_id", "owner", "repository", "text_key", "base", F.filter(free, live).alias("wide"))
    hashed = lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash"))
    return rows.select("doc_id", "owner", "repository", "text_key", F.transform("base", hashed).alias("base"), F.transform("wide", hashed).alias("wide"), F.monotonically_increasing_id().alias("row"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories over the corpus; distinct pairs are formed before a hash's rows meet."""
    pairs = found.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, ownership for each row of df.

    n_live and n_example divide the reported spans: live if at most `max_owners` owners in at most
    `max_repositories` repositories hold the value (the secret's group 2 for assignments), else an example.
    ownership lists, in the order of spans, how many owners and repositories hold each value, as `2/5`.
    A null text is empty: no spans, the hash of the empty string. Null owners count as one owner, named by the
    empty string; null ids stay. Repeated rows are reported each, and count once for ownership. An empty table
    gives no rows. Columns of df beside those named aren't read. Without `repository`, distinct texts stand for it.
    Finding the spans of one text takes time in the square of their number.
    """
    out = _judged(df, doc_id, text, owner, repository, max_owners, max_repositories)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = _reported()
    held = F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws("/", s["owners"], s["repositories"])), ",")
    n_live = F.size(F.filter(spans, lambda s: s["live"])).cast("long")
    base = F.transform("base", lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"]))
    return out.select(
        "doc_id", *[n(kind) for kind, *_ in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"),
        n_live.alias("n_live"), (F.size(spans).cast("long") - n_live).alias("n_example"), held.alias("ownership"),
    )


def _reported() -> Column:
    """The base spans, and those of the wider pattern whose value is live."""
    return F.filter("spans", lambda s: (s["kind"] != WIDE[0]) | s["live"])


def _judged(df: DataFrame, doc_id: str | None, text: str, owner: str, repository: Column | None, max_owners: int, max_repositories: int) -> DataFrame:
    """A row per document: base spans, and all spans with the ownership of their values."""
    if repository is None:
        repository = F.md5(F.coalesce(F.col(text), F.lit("")))
    rows = stored(candidates(df, doc_id, text, owner, repository), "secrets")  # small: no texts, and row numbers stay
    some = F.size("base") + F.size("wide") > 0
    each = rows.filter(some).select("row", "owner", "repository", F.explode(F.concat("base", "wide")).alias("s")).select("row", "owner", "repository", "s", F.col("s.hash").alias("hash"))
    # a value may stand in any number of rows, so each meets one of SALTS copies of what is known of it
    known = ownership(each).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = each.select("row", "s", "hash", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")).join(known, ["hash", "salt"])
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    span = F.struct(*[F.col(f"s.{c}").alias(c) for c in ("start", "ord", "end", "kind")], F.col("n_owners").alias("owners"), F.col("n_repositories").alias("repositories"), live.alias("live"))
    found = salted.groupBy("row").agg(F.collect_list(span).alias("spans"))
    out = rows.filter(some).join(found, "row").select("doc_id", "text_key", "base", "spans")
    none = F.from_json(F.lit("[]"), out.schema["spans"].dataType)
    return out.unionByName(rows.filter(~some).select("doc_id", "text_key", "base", none.alias("spans")))


def redact(df: DataFrame, *, text: str = "text", owner: str = "source", repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, mask_copied: bool = False) -> DataFrame:
    """df with the reported spans of its texts replaced: `[secret]` for live values, `[example]` for copied ones.

    With `mask_copied`, copied values of the wider pattern, which aren't reported, become `[example]` too.

    Spans that touch become one, live if one of them is. All other texts, and all other columns, stay as they are,
    null texts too; no row goes. A column n_chars is set to the new length where a text changes. Any other column
    of df is carried, whatever its name.
    """
    any_of = "|".join(f"(?:{FAST.get(kind, pattern)})" for kind, pattern, *_ in [*BASE, WIDE])
    suspect = F.coalesce(F.rlike(F.col(text), F.lit(any_of)), F.lit(False))
    flagged = df.filter(suspect)
    spans = _judged(flagged, None, text, owner, repository, max_owners, max_repositories)
    masked_spans = F.col("spans") if mask_copied else _reported()
    marked = F.array_sort(F.transform(masked_spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["live"].alias("live"))))
    spans = spans.select(F.col("text_key").alias("__key"), marked.alias("__marked")).groupBy("__key").agg(F.first("__marked").alias("__spans"))
    joined = flagged.withColumn("__key", F.md5(text)).join(spans, "__key", "left")

    def step(acc: Column, s: Column) -> Column:  # out: finished text; at: end of the open span, whose mark is pending
        apart = s["start"] > acc["at"]
        closed = F.concat(acc["out"], acc["mark"], F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]))
        mark = F.when(s["live"] | (~apart & (acc["mark"] == "[secret]")), "[secret]").otherwise("[example]")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart | (acc["mark"] == ""), closed).otherwise(acc["out"]).alias("out"), mark.alias("mark"))

    end = lambda acc: F.concat(acc["out"], acc["mark"], F.substr(F.col(text), acc["at"] + 1, F.length(text)))
    masked = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit("").alias("mark")), step, end)
    joined = joined.withColumn("__masked", F.when(F.size("__spans") > 0, masked).otherwise(F.col(text)))
    new = {text: F.col("__masked")}
    if "n_chars" in df.columns:
        new["n_chars"] = F.when(F.size("__spans") > 0, F.length("__masked")).otherwise(F.col("n_chars")).cast(df.schema["n_chars"].dataType)
    changed = joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
    return changed.unionByName(df.filter(~suspect))
