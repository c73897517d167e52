"""Runs of equal observations: a host that answers with one body size again and again.

In a table, runs are gaps and islands in a stated order. In a stream, each micro-batch finds its runs with the same
window functions and is folded into a table of one row per key: the value and length of the run at the key's end, and
the number of runs so far. No key's rows are gathered anywhere but in Spark's sorted, spillable windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """A row per maximal run of equal values of a key: its number, value, length and first position."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    numbered = df.withColumn("run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run", value).agg(F.count("*").alias("length"), F.min(F.struct(*order))[order[0]].alias("first"))


def folded(state: DataFrame, batch: DataFrame, key: str, value: str, order: list[str], least: int) -> DataFrame:
    """state (key, last, n, n_runs) after a batch of rows: a run that goes on from the state isn't counted twice."""
    found = runs(batch, key, value, order)
    ends = found.groupBy(key).agg(
        F.min_by(F.struct(F.col(value).alias("v"), F.col("length").alias("n")), "run").alias("head"), F.max_by(F.struct(F.col(value).alias("v"), F.col("length").alias("n")), "run").alias("tail"),
        F.count("*").alias("n_found"), F.count_if(F.col("length") >= least).alias("n_long"),
    )
    both = state.join(ends.withColumnRenamed(key, "key"), "key", "full")
    goes_on = F.col("n_runs").isNotNull() & F.col("n_found").isNotNull() & F.col("last").eqNullSafe(F.col("head.v"))
    begun = F.when(goes_on, F.col("n")).otherwise(0)
    # the first run of the batch counts if the whole of it is long enough, unless the state has counted it
    head_now = ((F.col("head.n") + begun) >= least).cast("long") - (F.col("head.n") >= least).cast("long") - (begun >= least).cast("long")
    total = F.coalesce("n_runs", F.lit(0)) + F.coalesce(F.col("n_long") + head_now, F.lit(0))
    length = F.when(F.col("n_found").isNull(), F.col("n")).when(F.col("n_found") == 1, F.col("tail.n") + begun).otherwise(F.col("tail.n"))
    last = F.when(F.col("n_found").isNull(), F.col("last")).otherwise(F.col("tail.v"))
    return both.select("key", last.alias("last"), length.cast("long").alias("n"), total.cast("long").alias("n_runs"))


def tracked(stream: DataFrame, key: str, value: str, order: list[str], *, table: str, checkpoint: str, least: int = 3) -> DataFrame:
    """Runs a stream over what its source has: key, last, n and n_runs, the runs of at least `least` so far.

    Rows of a micro-batch are ordered; across batches the order is that of arrival. The state of batch i is in the
    folder of that number below `table`, so a batch that runs again after a failure starts from the same state.
    """
    spark = stream.sparkSession
    kind = f"key {stream.schema[key].dataType.simpleString()}, last {stream.schema[value].dataType.simpleString()}, n long, n_runs long"

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(kind).parquet(f"{table}/{epoch - 1}") if epoch else session.createDataFrame([], kind)
        folded(before, batch, key, value, order, least).write.mode("overwrite").parquet(f"{table}/{epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = max(batches(spark, table), default=None)
    return spark.createDataFrame([], kind) if last is None else spark.read.schema(kind).parquet(f"{table}/{last}")


def batches(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the finished batches below a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return [int(n) for n in names if n.isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))]


def drained(totals: DataFrame, *, table: str, checkpoint: str) -> DataFrame:
    """Runs a streaming aggregation over what its source has and returns its last totals, read from files."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table)  # complete mode: each batch has all totals

    totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return totals.sparkSession.read.schema(totals.schema).parquet(table)
