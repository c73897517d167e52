"""Near-duplicate groups by bottom-k sketches of one hash function.

1. A document's set: the hashes of its distinct word shingles. Equal sets are one class, named by a 128-bit digest;
   only classes go on, so exact copies cost nothing more.
2. Inverted lists: each class posts its LISTED smallest hashes. A linked pair shares at least 12 of 32, but for a
   chance below MISS at the threshold of 80 % (small sets are their own sketch; there the bound is exact). So in the order of
   the lists' lengths it also shares one outside the 11 longest lists of either, and those postings go.
3. Overlaps in the lists give candidate pairs. Only connectivity is asked for, so a list first proposes its members
   against one pivot; a list whose members have come together in one component is done. Lists of up to SMALL
   members then propose all pairs across components; longer ones propose a second pivot. What is left are long
   lists with several components, of texts that share passages. Their classes post their full sets, each without
   its longest lists as before, which leaves the rarest fifth; those lists propose PIVOTS members each, then all
   pairs across components whose overlap can still be large enough, given the place of the rarest
   shared value. No list is capped or dropped.
4. Each pair passes the union-sketch estimate, then the exact Jaccard test on full sets.
5. Components by alternating large-star and small-star steps, and later links on the graph of components so far;
   nothing is collected to the driver.

All joined tables grow with the corpus, so each join is asked to merge: none is collected for a broadcast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import limit_batches, stored

LISTED = 32  # values of a class that enter the inverted lists
SKETCH = 64  # values for the union-sketch estimate
MISS = 1e-7  # chance that a linked pair at the threshold shares fewer of LISTED values than asked for
SMALL = 32  # members of a list that are paired outright
SLACK = 0.3  # the estimate may fall so far below the threshold: over six standard errors at SKETCH values
PART = 512  # members of a list that are worked on in one task
PIVOTS = 16  # of a list of full sets, before what is left is paired
SLICE = 2_000_000  # bytes of text taken together in a task


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts of 1 to n - 1 words have one, of all words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    doc, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    doc, coded = doc[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    w = known[coded.indices.to_numpy()]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        runs, p = np.full(max(0, len(w) - n + 1), n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
        for i in range(n):
            runs = runs * p + w[i : len(w) - n + 1 + i]
        runs = _mixed(runs)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a >= n:
                s = np.sort(runs[a : b - n + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                h = np.uint64(b - a)
                for x in w[a:b]:
                    h = h * p + x
                yield _mixed(np.array([h], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + SLICE)))
        yield batch.slice(start, end - start)
        start = end


def _sketcher(n: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), n))
                ids = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                if full:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_id", "members"])
                else:
                    sizes = pa.array([len(s) for s in sets], pa.int64())
                    least = pa.array([s[:LISTED].view(np.int64) for s in sets], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), sizes, ids, least], ["doc_id", "row_key", "n_shingles", "set_id", "least"])

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = (c.values.to_numpy().view(np.uint64) for c in (x, y))
                union = np.union1d(a[:SKETCH], b[:SKETCH])[:SKETCH]
                near = np.isin(union, a[:SKETCH], assume_unique=True) & np.isin(union, b[:SKETCH], assume_unique=True)
                likely = near.sum() >= (percent / 100 - SLACK) * len(union)
                both = len(np.intersect1d(a, b, assume_unique=True)) if likely else 0
                keep.append(bool(likely) and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _needed(n: Column, percent: int) -> Column:
    """Values of a class's posted sketch that a link needs to share with its partner's, at least."""
    p, low, k = percent / 100, 0.0, 0
    while low + (now := math.comb(LISTED, k) * p**k * (1 - p) ** (LISTED - k)) <= MISS:
        low, k = low + now, k + 1
    return F.when(n * 100 <= LISTED * percent, F.ceil(n * percent / 100)).otherwise(F.lit(max(1, k)))


def _rarest(posted: DataFrame, needed: Column) -> DataFrame:
    """posted (v, set_id, n, ...) without values that one class alone holds, and without each class's longest lists.

    Whoever shares `needed` values shares one that is not among the needed - 1 longest lists of either class. nth is
    a value's place from the longest list on, so it also says how many values of the class are not rarer.

    A list of more than PART members is dealt to parts (`part` of `parts`), which tasks work on apart.
    """
    shared = posted.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1")
    nth = F.row_number().over(Window.partitionBy("set_id").orderBy(F.col("m").desc(), "v"))
    parts = F.ceil(F.col("m") / PART).cast("int")
    dealt = posted.join(shared.hint("merge"), "v").withColumns({"nth": nth, "parts": parts, "part": F.pmod(F.xxhash64("set_id"), parts).cast("int")})
    return dealt.filter(F.col("nth") >= needed).drop("m")


def _to_parts(lists: DataFrame) -> DataFrame:
    """A row per list (v, parts, ...) for each of its parts."""
    return lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _comparable(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (u, v)."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    x = sets.select(F.col("set_id").alias("u"), F.col("members").alias("x"))
    y = sets.select(F.col("set_id").alias("v"), F.col("members").alias("y"))
    return stored(pairs.join(x.hint("merge"), "u").join(y.hint("merge"), "v").select("u", "v", "x", "y").mapInArrow(_verifier(percent), "u binary, v binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of undirected edges (u, v)."""

    def written(x: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        e = stored(x.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")), "edges")
        return e, (seen.get["n"], seen.get["mark"])

    e, now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        before = now
        e, now = written(small.distinct())
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, component) after more edges (u, v): only the graph of components is worked on."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_is")).hint("merge")
    between = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_is", "u").alias("u"), F.coalesce("v_is", "v").alias("v")).filter("u <> v")
    new = stored(components(between), "components")
    moved = new.select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = labels.join(moved.hint("merge"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return stored(old.unionByName(new.join(labels.select("node").hint("merge"), "node", "left_anti")), "components")


def _linked(lists: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node and component of the classes that links connect. lists: v (value), part, parts, set_id, n, nth; sketches: set_id, least."""
    columns = ["v", "part", "parts", "set_id", "n", "nth"]

    def star(x: DataFrame, rank: Column) -> DataFrame:
        """Each member of a part of a list and its pivot, the first by rank; and each part's pivot and the list's."""
        p = x.groupBy("v", "part").agg(F.min(F.struct(rank.alias("rank"), "set_id", "n")).alias("p"), F.count("*").alias("m"), F.max("parts").alias("parts"))
        out = x.drop("parts").join(p.filter("m > 1").hint("merge"), ["v", "part"]).select("set_id", "n", "p")
        heads = p.filter("parts > 1").select("v", "p")
        tops = heads.groupBy("v").agg(F.min("p").alias("top"))
        heads = heads.join(tops.hint("merge"), "v").select(F.col("p.set_id").alias("set_id"), F.col("p.n").alias("n"), F.col("top").alias("p"))
        out = out.unionByName(heads).filter(F.col("set_id") != F.col("p.set_id"))
        return out.filter(_comparable(F.col("n"), F.col("p.n"), percent)).select(F.col("p.set_id").alias("u"), F.col("set_id").alias("v"))

    def unsettled(x: DataFrame, labels: DataFrame) -> DataFrame:
        x = x.join(labels.hint("merge"), x["set_id"] == labels["node"], "left").select(*columns, F.coalesce("component", "set_id").alias("c"))
        lists = x.groupBy("v").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("parts").alias("parts")).filter("low < high")
        return stored(x.join(_to_parts(lists.select("v", "m", "parts")).hint("merge"), ["v", "part"]), "lists")

    def across(x: DataFrame, alike) -> DataFrame:
        """Pairs of different components that share a value; each once, at the rarest value they share."""
        own = x.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("nth", "v")), asc=False)["v"].alias("own"))
        x = stored(x.join(own.hint("merge"), "set_id"), "postings")
        a, b = x.alias("a"), x.alias("b")
        on = (F.col("a.v") == F.col("b.v")) & (F.col("a.set_id") < F.col("b.set_id")) & (F.col("a.c") != F.col("b.c")) & _comparable(F.col("a.n"), F.col("b.n"), percent)
        on = on & alike & (F.array_intersect("a.own", "b.own")[0] == F.col("a.v"))
        return a.join(b.hint("merge"), on).select(F.col("a.set_id").alias("u"), F.col("b.set_id").alias("v"))

    labels = stored(components(_verified(star(lists, F.col("set_id")), sets, percent)), "components")
    rest = unsettled(lists, labels)
    long = rest.filter(F.col("m") > SMALL)
    shared = F.size(F.array_intersect("a.least", "b.least")) >= F.least(_needed(F.col("a.n"), percent), _needed(F.col("b.n"), percent))
    pairs = across(rest.filter(F.col("m") <= SMALL).join(sketches.hint("merge"), "set_id"), shared).unionByName(star(long, F.xxhash64("set_id")))
    labels = joined_components(labels, _verified(pairs, sets, percent))
    if long.isEmpty():
        return labels
    left = unsettled(long.select(*columns), labels).select("set_id", "n").distinct()
    whole = stored(left.hint("merge").join(sets, "set_id").select("set_id", "n", F.explode("members").alias("v")), "whole")
    last = stored(_rarest(whole, F.ceil(F.col("n") * percent / 100)), "lists")
    # of both classes, the values that are not rarer than the rarest shared one bound the overlap
    enough = lambda x, y: F.least(x["nth"], y["nth"]) * (100 + percent) >= (x["n"] + y["n"]) * percent
    last = unsettled(last, labels)
    if last.isEmpty():
        return labels
    # pivots are of the list's largest component if it has as many, and others in each list; a task hands on at most
    # PIVOTS rows of each list to the one that ranks them
    sizes = last.groupBy("v", "c").agg(F.count("*").alias("size"), F.max("parts").alias("parts")).groupBy("v").agg(F.max_by("c", F.struct("size", "c")).alias("largest"), F.max("parts").alias("parts"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.col("c") != F.col("largest"), F.xxhash64("set_id", "v")))
    p = last.join(_to_parts(sizes).hint("merge"), ["v", "part"]).withColumn("place", nth).filter(F.col("place") <= PIVOTS).select("v", "parts", F.struct("set_id", "n", "nth", "c").alias("p"))
    pairs = last.drop("parts").join(_to_parts(p).hint("merge"), ["v", "part"]).filter((F.col("c") != F.col("p.c")) & _comparable(F.col("n"), F.col("p.n"), percent) & enough({"nth": F.col("nth"), "n": F.col("n")}, F.col("p")))
    labels = joined_components(labels, _verified(pairs.select(F.col("p.set_id").alias("u"), F.col("set_id").alias("v")), sets, percent))
    last = unsettled(last, labels)
    if last.isEmpty():
        return labels
    a, b = ({k: F.col(f"{x}.{k}") for k in ("n", "nth")} for x in ("a", "b"))
    return joined_components(labels, _verified(across(last, enough(a, b)), sets, percent))


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of df.

    Words are runs of non-white-space with A-Z lower-cased; the set of a document is its distinct runs of `words`
    words (of all words, if fewer). Two documents are linked if 100 * intersection >= percent * union of their sets.
    component_id is the least id that links reach, null ids apart; kept marks doc_id = component_id, and rows of
    null id in a component that has no id. A null or empty text, or one of white space, has the empty set and is
    linked with nothing. Repeated rows are all returned, and kept alike. An empty table gives no rows. Ids are whole
    numbers, or text that holds them. Other columns of df aren't read.
    """
    return _grouped(df, doc_id, text, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of df, unchanged, for each group of near_duplicates(): that of the least id.

    Rows equal in id and text are one document. Of a group without ids, and of rows with one id and different
    texts in a group, the one of the least hash stays. Texts without words are all different, but for equal rows.
    """
    found = _grouped(df, doc_id, text, words, percent).filter("kept")
    least = found.filter("n_shingles > 0").groupBy("component").agg(F.min("row_key").alias("__row_key")).select("__row_key")
    least = least.unionByName(found.filter("n_shingles = 0").select(F.col("row_key").alias("__row_key")).distinct())
    keyed = df.withColumn("__row_key", _row_key(F.col(doc_id), F.col(text)))
    return keyed.join(least.hint("merge"), "__row_key", "left_semi").dropDuplicates(["__row_key"]).drop("__row_key")


def _row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for an id and a text."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))


def _grouped(df: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    limit_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("row_key", _row_key(F.col("doc_id"), F.col("text")))
    kinds = "doc_id long, row_key string, n_shingles long, set_id binary"
    rows = stored(docs.mapInArrow(_sketcher(words, False), f"{kinds}, least array<bigint>"), "sketches")

    # a set of up to 3 (at 80 %: of less than 4) members has no other set that is alike enough
    classes = rows.filter(F.col("n_shingles") * (100 - percent) >= percent).groupBy("set_id").agg(F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"), F.first("least").alias("least"))
    posted = classes.select("set_id", "row_key", "n", F.explode("least").alias("v"))
    lists = stored(_rarest(posted, _needed(F.col("n"), percent)), "lists")
    able = stored(lists.select("set_id", "row_key").distinct(), "candidates")
    lists = lists.select("v", "part", "parts", "set_id", "n", "nth")
    sketches = stored(classes.join(able.select("set_id").hint("merge"), "set_id", "left_semi").select("set_id", "least"), "sketches")
    texts = docs.select("row_key", "text").join(able.select("row_key").hint("merge"), "row_key", "left_semi").dropDuplicates(["row_key"])
    sets = stored(texts.select("text").mapInArrow(_sketcher(words, True), "set_id binary, members array<bigint>"), "sets")

    labels = _linked(lists, sketches, sets, percent)
    of_class = rows.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least_id"))
    of_class = of_class.join(labels.hint("merge"), of_class["set_id"] == labels["node"], "left").select("set_id", "least_id", "component")
    joined = of_class.filter("component IS NOT NULL")
    of_component = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    joined = joined.join(of_component.hint("merge"), "component").select("set_id", "component", "component_id")
    of_class = joined.unionByName(of_class.filter("component IS NULL").select("set_id", F.col("set_id").alias("component"), F.col("least_id").alias("component_id")))
    columns = ["doc_id", "row_key", "n_shingles", "component", "component_id"]
    out = rows.filter("n_shingles > 0").select("doc_id", "row_key", "n_shingles", "set_id").join(of_class.hint("merge"), "set_id").select(*columns)
    out = out.unionByName(rows.filter("n_shingles = 0").withColumns({"component": F.lit(None).cast("binary"), "component_id": F.col("doc_id")}).select(*columns))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
