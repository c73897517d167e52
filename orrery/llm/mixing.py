"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u) / w, where u is a hash of its id and text and w its quality weight; ascending
keys are a weighted order without replacement. Within a source that order is prefix-summed to the source's token
budget. Complete epochs of a source come before the fractional selection.

No source is ever gathered into one task: keys fall into ordered buckets of about `rows_per_bucket` documents, the
buckets' sums give each bucket its offset, and only rows of one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orrery.llm.common import n_words, stored

SYMBOLS = "[#$%&*|!]"
WIDE = T.DecimalType(38, 0)


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain words, less the more symbol characters there are per word; 1 without words."""
    noise = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return F.when(size == 0, 1.0).otherwise(size.cast("double") / (size + 4 * noise))


def unit_hash(*cols: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5; nulls count as empty."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """source, source_size, target, epochs, rest: one row per source.

    Sources by code point, null last, weigh `weights` in turn; they share `share` (a fraction) of all sizes. A
    target stops at `cap` times the size and the excess is shared again by weight. That fixed point is found
    without iterating: in order of cap per weight, the first source that fits its part sets the level.
    """
    nth = Window.orderBy(F.col("source").isNull(), "source")
    up = Window.orderBy(F.col("ceiling") / F.col("weight"), "nth")
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.avg("quality").alias("mean_quality"))
    s = s.withColumn("nth", F.row_number().over(nth) - 1)
    s = s.withColumn("weight", F.element_at(F.lit(list(weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("ceiling", F.col("source_size") * cap)
    s = s.withColumns({
        "below": (F.sum("ceiling").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ceiling")).cast(WIDE),
        "open": (F.sum("weight").over(all_rows) - F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight")).cast("long"),
        "all": F.sum("source_size").over(all_rows).cast(WIDE),
    })
    s = s.withColumn("left", (F.col("all") * share[0] - F.col("below") * share[1]).cast(WIDE))  # in units of 1 / share[1]
    s = s.withColumn("fits", F.col("ceiling").cast(WIDE) * F.col("open") * share[1] >= F.col("weight") * F.col("left"))
    level = F.struct(F.col("left").alias("left"), F.col("open").alias("open"))
    at = F.min_by(F.when(F.col("fits"), level), F.when(F.col("fits"), F.col("ceiling") / F.col("weight"))).over(all_rows)
    s = s.withColumn("level", at)
    part = (F.col("weight") * F.col("level.left")).cast("double") / (F.col("level.open") * share[1]).cast("double")
    s = s.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(part, F.col("ceiling").cast("double"))))
    epochs = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    s = s.withColumn("epochs", epochs)
    s = s.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    return s.select("source", "source_size", "n_docs", "mean_quality", "target", "epochs", "rest")


def mix(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: dict[str, Column] | None = None, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2, seed: str = "mix", rows_per_bucket: int = 10_000) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of df, and the columns of `carry`.

    taken counts words: the epochs of its source times the size, plus what the fractional selection takes; the
    document at the edge of the budget gives only the words that are still missing, so a source's sum is its
    rounded target. A null or empty text has size 0 and takes 0; a null source is a source of its own, the last;
    a null id hashes as empty. Keys are of id and text, so rows that share an id are spread like others. Repeated rows
    have equal keys and stand side by side in the order: which of two rows that are equal in all columns gives the
    words doesn't change the result. An empty table gives no rows.
    Other columns of df aren't read. Reruns agree: the keys depend on ids, texts and `seed` only.
    """
    carry, size = carry or {}, n_words(F.col(text))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.col(text).alias("text"), *[c.alias(f"__{k}") for k, c in carry.items()])
    docs = docs.withColumn("quality", quality_weight(F.col("text"), F.col("size")))
    docs = docs.withColumn("key", -F.log(unit_hash(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))) / F.col("quality")).drop("text")
    docs = stored(docs, "mixing")
    targets = source_targets(docs, weights, share, cap)
    d = docs.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left").drop(F.col("s.source"))
    n = F.ceil(F.col("n_docs") / rows_per_bucket)
    d = d.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * F.col("mean_quality"))) * n).cast("long"))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("words").over(before) - F.col("words"))
    d = d.alias("d").join(sums.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")), "left")
    d = d.select("d.*", "b.before")
    run = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(run) - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return d.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"__{k}").alias(k) for k in carry])


def take(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix as rows of df: each document as often as mix() takes words of it, in whole documents, rounded up.

    A source so exceeds its target by less than one document. Rows equal in id, text and source stand for one
    another. Documents without words go.
    """
    key = F.md5(F.to_json(F.struct(F.col(doc_id).cast("string").alias("a"), F.col(source).cast("string").alias("b"), F.md5(F.col(text)).alias("c"))).cast("binary"))
    mixed = mix(df, doc_id=doc_id, text=text, source=source, carry={"__key": key}, **how)
    times = mixed.filter("taken > 0").groupBy("__key").agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("__times"))
    kept = df.withColumn("__key", key).join(times, "__key").dropDuplicates(["__key"])
    return kept.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__key", "__times", "__nth")
