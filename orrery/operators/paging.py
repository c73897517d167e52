"""Pages by position over a table that is written in its order once: a page reads the ranges that it lies in.

    <path>/rows/range=<k>/...   the rows of range k, sorted; ranges are in the order of the table
    <path>/counts               how many rows each range has

A page at any offset is found from the counts alone (a number for each range) and read from one range, or a few where it
crosses their ends. after() goes on from the last row of a page and needs no offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, order: list[str], ranges: int = 200) -> None:
    """Writes df in ascending order (nulls first) of columns that tell its rows apart, in at most `ranges` ranges."""
    dealt = df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    dealt.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(_schema(df)).parquet(f"{path}/rows")
    rows.groupBy("range").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def _schema(df: DataFrame):
    return df.withColumn("range", F.lit(0)).schema


class Pages:
    """Pages of a table that write() wrote."""

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.spark, self.path, self.order = spark, path, order
        self.counts = sorted((r["range"], r["n"]) for r in spark.read.schema("range int, n long").parquet(f"{path}/counts").collect())  # a row for each range

    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def ranges_of(self, offset: int, limit: int) -> tuple[list[int], int]:
        """The ranges that a page lies in, and its offset in the first of them."""
        found, skip, before = [], 0, 0
        for k, n in self.counts:
            if before < offset + limit and before + n > offset:
                if not found:
                    skip = offset - before
                found.append(k)
            before += n
        return found, max(0, skip)

    def _rows(self, ranges: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/range={k}" for k in ranges]).drop("range")

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit of the order, sorted."""
        found, skip = self.ranges_of(offset, limit)
        if not found or limit <= 0:
            return self._rows([k for k, _ in self.counts[:1]]).limit(0)
        return self._rows(found).orderBy(*self.order).offset(skip).limit(limit)

    def after(self, last: dict, limit: int) -> DataFrame:
        """The next rows after the one whose order columns are `last` (not null); only files that may hold such rows are read."""
        beyond: Column = F.lit(False)
        for c in reversed(self.order):
            beyond = (F.col(c) > F.lit(last[c])) | ((F.col(c) == F.lit(last[c])) & beyond)
        whole = self.spark.read.parquet(f"{self.path}/rows").drop("range")
        return whole.filter((F.col(self.order[0]) >= F.lit(last[self.order[0]])) & beyond).orderBy(*self.order).limit(limit)
