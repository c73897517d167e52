"""Many substrings or LIKE patterns against many texts in one job, by the grams that they must share.

A pattern's literal runs are cut into grams of three characters (of two or one, where no run is longer). Whoever
matches holds all of them, so each pattern is looked for only where its rarest gram is: the grams of patterns are
counted over all texts, each pattern is kept under its rarest one, the texts' grams meet the patterns by an equi join, and
the text is verified. A pattern with a gram that no text holds is done. Patterns without a literal are few
(SCANNED at most) and are held against each row.

A gram is a number of its code points, and texts are read twice, by numpy in the tasks that read them: once to count how
often each gram occurs, and once for where the rarest ones are. A bitmap of 2 MB of the grams that are asked for lets the others
stay there, so neither texts nor their grams are kept. The texts meet the candidate
pairs once, by the columns `keep`, which should tell rows apart. A gram that many rows hold is a hot key of the join; Spark splits its rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.sources.tables import scratch

SIZE = 3
WIDTH = 21  # bits of a code point
BITS = 24  # of a place in the bitmap: of letters of one byte, each gram has its own
CHARS = 1 << 17  # characters of texts that are cut together
SCANNED = 100  # distinct patterns without a literal, as `%` or `__%`
_MARKS = {"\\\\": "\x01", "\\%": "\x02", "\\_": "\x03"}  # escaped characters while a pattern is taken apart


def escaped(c: Column) -> Column:
    """A text as a LIKE pattern that matches it alone."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def _runs(pattern: Column, like: bool) -> Column:
    """The literal runs of a pattern."""
    if not like:
        return F.filter(F.array(pattern), lambda r: r != "")
    c = pattern
    for mark, stand in _MARKS.items():
        c = F.replace(c, F.lit(mark), F.lit(stand))
    runs = F.filter(F.split(c, "[%_]+"), lambda r: r != "")
    for mark, stand in _MARKS.items():
        runs = _restored(runs, stand, mark[1:])
    return runs


def _restored(runs: Column, stand: str, mark: str) -> Column:
    return F.transform(runs, lambda r: F.replace(r, F.lit(stand), F.lit(mark)))


def _place(gram, shifted):
    """A gram's place in the bitmap, of numbers and of columns alike."""
    return (gram ^ shifted(gram, WIDTH - 8) ^ shifted(gram, 2 * WIDTH - 16)) & ((1 << BITS) - 1)


def _bitmap(grams: DataFrame) -> bytes:
    """2 MB for grams of any number."""
    place = F.expr(f"(gram ^ shiftright(gram, {WIDTH - 8}) ^ shiftright(gram, {2 * WIDTH - 16})) & {(1 << BITS) - 1}")
    found = grams.select(place.alias("at")).groupBy(F.expr("CAST(at >> 3 AS INT)").alias("byte")).agg(F.expr("bit_or(1 << CAST(at & 7 AS INT))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    out[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def _cut(texts: list[str], sizes: list[int], asked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The grams of texts that are asked for, overlapping ones too, each time they occur: numbers of texts, and grams."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    found = [np.zeros((2, 0), dtype=np.int64)]
    for size in sizes:
        n = max(len(codes) - size + 1, 0)
        gram = codes[:n]
        for i in range(1, size):
            gram = (gram << WIDTH) | codes[i : i + n]
        at = np.arange(n) if asked is None else np.flatnonzero(asked[_place(gram, np.right_shift)])
        of = np.searchsorted(ends, at, side="right")
        whole = at + size <= ends[of]
        found.append(np.stack([of[whole], gram[at[whole]]]))
    return tuple(np.concatenate(found, axis=1))


def _once(of: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((gram, of))
    of, gram = of[order], gram[order]
    first = np.ones(len(of), dtype=bool)
    first[1:] = (of[1:] != of[:-1]) | (gram[1:] != gram[:-1])
    return of[first], gram[first]


def _grams(df: DataFrame, text: str, sizes: list[int], *, key: str | None, bitmap: bytes | None = None) -> DataFrame:
    """key and gram, once for each text; without a key, how often each gram occurs, in several rows n. The grams are those of the bitmap, and a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            texts, start, chars = batch.column(text).to_pylist(), 0, 0
            for end, t in enumerate(texts, 1):
                chars += len(t)
                if chars >= CHARS or end == len(texts):
                    of, gram = _cut(texts[start:end], sizes, asked)
                    if key:
                        of, gram = _once(of, gram)
                        yield pa.RecordBatch.from_arrays([batch.column(key).slice(start).take(pa.array(of)), pa.array(gram)], [key, "gram"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(gram, return_counts=True)], ["gram", "n"])
                    start, chars = end, 0

    fields = [df.schema[key], T.StructField("gram", T.LongType())] if key else [T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())]
    return df.select(*([key] if key else []), text).mapInArrow(run, T.StructType(fields))


def _stored(df: DataFrame, name: str) -> DataFrame:
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def matches(df: DataFrame, patterns: DataFrame, *, text: str, keep: list[str], pattern: str = "pattern", like: bool = False) -> DataFrame:
    """The columns `keep` of each row of df with each distinct pattern that its text holds, or is LIKE with backslash escapes.

    Nulls match nothing; an empty substring is in every text, an empty LIKE pattern matches empty texts. Case counts. Repeated rows of
    df stay, repeated patterns count once. Where several texts have equal `keep`, each is verified by itself.
    """
    key = F.struct(*keep)  # equal to itself with nulls in it, unlike its columns
    rows = df.filter(F.col(text).isNotNull()).select(key.alias("__key"), *keep, F.col(text).alias("__text"))
    wanted = patterns.select(F.col(pattern).alias("pattern")).filter("pattern IS NOT NULL").distinct().withColumn("runs", _runs(F.col("pattern"), like))
    wanted = wanted.withColumn("size", F.least(F.lit(SIZE), F.coalesce(F.array_max(F.transform("runs", F.length)), F.lit(0))))
    wanted = _stored(wanted, "patterns")
    bare = [r["pattern"] for r in wanted.filter("size = 0").select("pattern").limit(SCANNED + 1).collect()]
    if len(bare) > SCANNED:
        raise ValueError(f"more than {SCANNED} patterns without a literal")
    sizes = sorted(r["size"] for r in wanted.filter("size > 0").select("size").distinct().collect())  # up to SIZE numbers
    verified = (lambda c: F.expr(f"__text LIKE {c}")) if like else (lambda c: F.contains(F.col("__text"), F.col(c)))
    scan = rows.withColumn("pattern", F.explode(F.lit(bare) if bare else F.array().cast("array<string>"))).filter(verified("pattern")).select(*keep, "pattern")
    if not sizes:
        return scan
    of_size = wanted.select("pattern", "size", F.explode("runs").alias("run"))
    posted = [_grams(of_size.filter(F.col("size") == s), "run", [s], key="pattern") for s in sizes]
    posted = _stored(functools.reduce(DataFrame.unionByName, posted).distinct(), "posted")
    counts = _grams(rows, "__text", sizes, key=None, bitmap=_bitmap(posted)).groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = posted.join(counts, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a"))
    kept = _stored(rarest.filter("a.n > 0").select("pattern", F.col("a.gram").alias("gram")), "kept")
    held = _grams(rows, "__text", sizes, key="__key", bitmap=_bitmap(kept))
    pairs = held.join(kept, "gram").select("__key", "pattern").distinct()
    found = pairs.join(rows, "__key").filter(verified("pattern")).select(*keep, "pattern")
    return found.unionByName(scan) if bare else found


def first_match(df: DataFrame, signatures: DataFrame, *, text: str, key: str, pattern: str = "pattern", order: str = "nth") -> DataFrame:
    """key and the first signature, by `order` (unique), that each row's text holds; rows without one are left out. Keys are unique."""
    found = matches(df, signatures, text=text, keep=[key], pattern=pattern)
    best = found.join(signatures.select(F.col(pattern).alias("pattern"), order), "pattern")
    return best.groupBy(key).agg(F.min_by("pattern", order).alias("pattern"))
