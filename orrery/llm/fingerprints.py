"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the k smallest distinct 64-bit hashes of a text's shingles (five words), ascending, as 16 hex
digits each, so that string order is number order. Sketches of parts merge into the sketch of the whole; two of
them estimate resemblance and containment, one estimates the number of distinct shingles.

All of it is built from DataFrame functions on one row; no Python runs on executors.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import SPACE, stored

K = 128
WORDS = 5


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, n: int = WORDS) -> Column:
    """Hashes of the runs of n word hashes; of the whole sequence if it is shorter; none without words."""
    shifted = [F.slice(hashes, i + 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0))).alias(f"w{i}") for i in range(n)]
    runs = F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(n)]))
    return F.when(F.size(hashes) >= n, runs).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.slice(hashes, 1, 0))


SIGN = 1 << 63


def least_hashes(shingles: Column, k: int = K) -> Column:
    """The k smallest distinct hashes as unsigned numbers; the sign bit is flipped, so that signed order is theirs."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(shingles, lambda h: h.bitwiseXOR(F.lit(-SIGN))))), 1, k)


def digits(least: Column) -> Column:
    """A fingerprint: 16 hex digits for each hash, ascending."""
    return F.array_join(F.transform(least, lambda h: F.lower(F.lpad(F.hex(h.bitwiseXOR(F.lit(-SIGN))), 16, "0"))), "")


def values(fingerprint: Column) -> Column:
    """The hashes of a fingerprint as strings of 16 digits, ascending."""
    return F.regexp_extract_all(fingerprint, F.lit("[0-9a-f]{16}"), F.lit(0))


def _merged(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts together, from the fingerprints of both."""
    return F.array_join(_merged(values(a), values(b), k), "")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the merged sketch that is in both. Two empty ones: 1; one: 0."""
    both = F.array_intersect(a, b)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.size(F.array_intersect(_merged(a, b, k), both)) / F.greatest(F.size(_merged(a, b, k)), F.lit(1)))


def distinct_shingles(fingerprint: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) over the k-th hash as a share of the range."""
    n = (F.length(fingerprint) / 16).cast("long")
    kth = F.conv(F.substring(fingerprint, 16 * (k - 1) + 1, 13), 16, 10).cast("double") / float(1 << 52)
    return F.when(n < k, n.cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds, both fingerprints; 1 for an empty a."""
    j, n_a, n_b = resemblance(values(a), values(b), k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(n_a == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (n_a + n_b) / (1 + j) / n_a))


MAX_BUCKETS = 250_000
PARTS = 200  # tasks that sort the keys
KEY = ["doc_id", "tie", "nth"]  # a row's place: descending id, null ids last; ties by a hash of the text, then as read


def _cuts(docs: DataFrame, rows_per_bucket: int) -> list[tuple]:
    """The first key of each bucket of at most rows_per_bucket rows in order (more where that were over MAX_BUCKETS buckets).

    Only keys are sorted, in ranges that a sample sets; the ranks of the ranges' rows come from their sizes.
    """
    keys = docs.select(F.col("doc_id").isNull().alias("last"), *KEY)
    order = [F.col("last"), F.col("doc_id").desc(), F.col("tie"), F.col("nth")]
    keys = keys.repartitionByRange(PARTS, *order).sortWithinPartitions(*order)
    keys = stored(keys.withColumn("at", F.monotonically_increasing_id()), "keys")  # range in the upper bits, place in the lower
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in keys.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # at most PARTS rows
    total = sum(sizes.values())
    each, before, offset = max(rows_per_bucket, -(-total // MAX_BUCKETS)), 0, {}
    for k in sorted(sizes):
        offset[k], before = before, before + sizes[k]
    if not offset:
        return []
    rank = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in offset.items() for x in pair]), part) + place
    return [tuple(r) for r in keys.filter(rank % each == 0).orderBy(rank).select(*[F.col(c) for c in KEY]).collect()]  # at most MAX_BUCKETS rows


def _before(c: Column) -> Column:
    """Whether a cut is the row's key or stands before it."""
    same = c["doc_id"].eqNullSafe(F.col("doc_id"))
    ahead = F.coalesce(c["doc_id"] > F.col("doc_id"), c["doc_id"].isNotNull() & F.col("doc_id").isNull())
    return ahead | (same & ((c["tie"] < F.col("tie")) | ((c["tie"] == F.col("tie")) & (c["nth"] <= F.col("nth")))))


def _bucket(docs: DataFrame, cuts: list[tuple]) -> tuple[Column, Column]:
    """A row's bucket, from 0 on, and whether it is the bucket's first: cuts are found in two steps of their number's root."""
    kind = f"array<{docs.select(F.struct(*KEY).alias('key')).schema['key'].dataType.simpleString()}>"
    width = max(1, math.isqrt(len(cuts)))
    groups = [[dict(zip(KEY, c, strict=True)) for c in cuts[i : i + width]] for i in range(0, len(cuts), width)]
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x, default=str)), kind)  # noqa: E731  folded to a constant by the optimizer
    heads, nested = literal([g[0] for g in groups], kind), literal(groups, f"array<{kind}>")
    group = F.size(F.filter(heads, _before))
    own = F.element_at(nested, group)
    within = F.size(F.filter(own, _before))
    cut = F.element_at(own, within)
    return (group - 1) * width + within - 1, (cut["tie"] == F.col("tie")) & (cut["nth"] == F.col("nth")) & cut["doc_id"].eqNullSafe(F.col("doc_id"))


def neighbours(df: DataFrame, rows_per_bucket: int) -> DataFrame:
    """df (doc_id, text) dealt by bucket, with a guest row at the end of each: the row that follows its last.

    Rows go in descending doc_id, null ids last, ties by a hash of the text; after the last row comes the first.
    Buckets are even runs of that order, whatever the ids; rows that share an id, or have none, are spread like others.
    The first row of each bucket is copied to the bucket before. Texts move once. df must give the same rows in the
    same partitions when it is read again, as a table does.
    """
    docs = df.withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    cuts = _cuts(docs, rows_per_bucket)
    if not cuts:
        return docs.select("doc_id", "text", "tie", "nth", F.lit(0).alias("bucket"), F.lit(0).alias("guest"))
    bucket, first = _bucket(docs, cuts)
    d = docs.withColumns({"__bucket": bucket, "__first": first})
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.when(F.col("__bucket") == 0, len(cuts) - 1).otherwise(F.col("__bucket") - 1).alias("bucket"), F.lit(1).alias("guest"))
    places = F.when(F.col("__first"), F.array(own, guest)).otherwise(F.array(own))
    return d.select("doc_id", "text", "tie", "nth", F.explode(places).alias("p")).select("doc_id", "text", "tie", "nth", "p.bucket", "p.guest")


def fingerprint_documents(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, words_in_shingle: int = WORDS, rows_per_bucket: int = 1_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_shingles for each row.

    The edited text is the text with its last half replaced by as much of the next document's start, in descending
    id (after the last: the first; a lone document follows itself). n_shingles estimates the distinct shingles.
    A null text is empty: an empty fingerprint, alike (1) to another empty one and unlike (0) to any other. Texts
    of fewer words than a shingle have one shingle, the whole. Repeated rows follow one another and are all
    returned. Null ids come last; ids may be of any type that has an order. An empty table gives no rows. Other
    columns of df aren't read. df is read twice, and must give the same rows in the same partitions, as a table does.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie", "nth")
    d = neighbours(docs, rows_per_bucket).withColumn("next", F.lead("text").over(order))
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n_chars - half), F.substr(F.coalesce("next", F.lit("")), F.lit(1), half))
    d = d.select("doc_id", "bucket", "guest", "tie", "nth", "text", n_chars.cast("long").alias("n_chars"), edited.alias("edited"))
    d = d.select("doc_id", "bucket", "guest", "tie", "nth", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), word_hashes(F.col("text")).alias("h"), word_hashes(F.col("edited")).alias("e"))
    shingles = lambda c: shingle_hashes(F.col(c), words_in_shingle)
    d = d.select("doc_id", "bucket", "guest", "tie", "nth", "n_chars", "edited_sha256", least_hashes(shingles("h"), k).alias("h"), least_hashes(shingles("e"), k).alias("e"))
    d = d.withColumn("next", F.lead("h").over(order)).filter("guest = 0")
    d = d.select("doc_id", "n_chars", "edited_sha256", digits(F.col("h")).alias("fingerprint"), digits(F.col("e")).alias("edited_fingerprint"), resemblance(F.col("h"), F.col("e"), k).alias("near_edited"), resemblance(F.col("h"), F.col("next"), k).alias("near_next"))
    return d.withColumn("n_shingles", distinct_shingles(F.col("fingerprint"), k))
