"""Token counts of a SentencePiece BPE model without materialising a document's ids.

No piece of the model crosses from a letter to a following space mark (checked when the model is loaded), so merges
never do: a text's tokens are those of its pre-tokens, taken apart before each run of spaces.

1. Tasks count how many texts hold each pre-token; the counts, summed over the corpus, leave each pre-token once.
2. The pieces of each distinct pre-token are counted once.
3. The table of pre-tokens meets the documents' frequencies and the products are summed. Its most frequent
   pre-tokens, at most HOT, are broadcast and met within the tasks that read the texts, so no hot key is
   ever shuffled; only the frequencies of the others go through a join.

Pre-tokens of more than LONG characters would be most of what is shuffled and are hardly ever met twice; they are
counted where they stand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import limit_batches, stored

MARK = "▁"  # stands for a space in pieces
BETWEEN = re.compile("(?<=[^ ]) ")  # the first space of each run but a leading one; the library puts it back as a prefix
HOT = 200_000  # pre-tokens that are broadcast
FLUSH = 400_000  # pre-tokens whose counts a task holds before it hands them on
LONG = 64


def pre_tokens(text: str) -> list[str]:
    return BETWEEN.split(text.replace(MARK, " ")) if text else []


def load(model_file: str):
    """The library's processor; refuses a model for which counts by pre-token would be wrong."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(len(model))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or len(model.encode(f"a{MARK}  a")) != len(model.encode("a   a")) or model.encode("a ") == model.encode("a"):
        raise ValueError(f"{model_file}: pieces cross spaces, or the model trims white space")
    return model


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens with the number of a task's texts that hold them."""

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            held.update({t for t in pre_tokens(text.as_py()) if len(t) <= LONG})
            if len(held) > FLUSH:
                yield rows(held)
                held = Counter()
    if held:
        yield rows(held)


def _pieces(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            # a lone space mark at the end of a text is one piece
            pieces = [len(ids) if t else 1 for t, ids in zip(tokens, model.encode(tokens, num_threads=1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(pieces, pa.int32())], ["token", "n", "pieces"])

    return run


def _summed(model_file: str, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(model_file), hot.value
        for batch in batches:
            sums, tokens, counts = [], [], []
            for text in batch.column("text"):
                frequencies = Counter(pre_tokens(text.as_py()))
                others = [t for t in frequencies if t not in known]
                total = sum(n * known[t] for t, n in frequencies.items() if t in known)
                total += sum(frequencies[t] * len(model.encode(t)) for t in others if len(t) > LONG)
                others = [t for t in others if len(t) <= LONG]
                sums.append(total)
                tokens.append(others)
                counts.append([frequencies[t] for t in others])
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64()), pa.array(tokens, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_bytes", "known", "tokens", "counts"])

    return run


def _frequent(pieces: DataFrame, most: int) -> DataFrame:
    """The pre-tokens of the highest counts, at most `most`: down to the step of counts, of two percent each, that still fits."""
    step = F.floor(F.log(F.col("n").cast("double")) * 50)
    sizes = {r["step"]: r["size"] for r in pieces.groupBy(step.alias("step")).agg(F.count("*").alias("size")).collect()}  # some hundred rows
    least, total = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    return pieces.filter(step >= least)


def count_tokens(df: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of df.

    Counts equal the library's encode() of the whole text, without begin, end or added special tokens; strings such
    as `</s>` inside texts are ordinary text, as is its default. A null text is empty and has 0 tokens. Null ids and
    repeated rows stay. An empty table gives no rows. Other columns of df aren't read. model_file is a path that
    every executor can open. `hot` pre-tokens are broadcast; it changes no count.
    """
    spark = df.sparkSession
    limit_batches(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    distinct = docs.select("text").mapInArrow(_distinct, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pieces = stored(distinct.mapInArrow(_pieces(model_file), "token string, n long, pieces int"), "pieces")
    top = _frequent(pieces, hot).select("token", "pieces").toArrow()  # at most `hot` rows of LONG characters
    known = spark.sparkContext.broadcast(dict(zip(top.column("token").to_pylist(), top.column("pieces").to_pylist(), strict=True)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    summed = stored(docs.mapInArrow(_summed(model_file, known), f"row long, doc_id {kind}, n_bytes long, known long, tokens array<string>, counts array<int>"), "frequencies")
    rest = summed.select("row", F.explode(F.arrays_zip("tokens", "counts")).alias("t")).select("row", F.col("t.tokens").alias("token"), F.col("t.counts").alias("k"))
    sums = rest.join(pieces, "token").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("rest"))
    out = summed.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left")
    n = F.col("known") + F.coalesce("rest", F.lit(0))
    return out.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
