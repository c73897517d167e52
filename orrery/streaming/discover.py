"""Candidates as a stream: each micro-batch is cleaned with the batch operators and appended to a table.

Seen keys are looked up in the table itself, so a restart continues where the last finished batch ended. The table is
dealt by a hash of the key, and a batch reads only the parts that its own keys fall into, so a small batch costs the
same however long the history is. A batch that runs again after a failure overwrites its own folder, so nothing is
appended twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import urls
from orrery.operators import dedup, feedback

KEPT = "page_id long, key string, host string, action string, pattern string, batch long, part int"
PARTS = 64


def cleaned(batch: DataFrame, rules: DataFrame, disputed: DataFrame) -> DataFrame:
    """First page of each key, without disputed ones, with the rule that fits; denied ones go."""
    df = batch.select("page_id", "url", urls.dedup_key(F.col("url")).alias("key"), urls.host(F.col("url")).alias("host"))
    df = dedup.not_in(dedup.top(df, ["key"], [F.col("page_id")]), disputed, ["key"])
    return feedback.apply_rules(df, rules, host="host", url="url", keys=["page_id"]).filter("action <> 'deny'").select("page_id", "key", "host", "action", "pattern")


def discover(stream: DataFrame, rules: DataFrame, disputed: DataFrame, *, table: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what its source has; returns the table of kept candidates."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kept = cleaned(batch, rules, disputed).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).persist()
        if epoch:
            parts = [r["part"] for r in kept.select("part").distinct().collect()]  # at most PARTS numbers
            earlier = spark.read.schema(KEPT).parquet(table).filter(F.col("part").isin(parts) & (F.col("batch") != epoch))
            fresh = dedup.not_in(kept, earlier, ["key"])
        else:
            fresh = kept
        fresh.write.partitionBy("part").mode("overwrite").parquet(f"{table}/batch={epoch}")
        kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(KEPT).parquet(table)
