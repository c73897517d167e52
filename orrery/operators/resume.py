"""Work that goes on where an earlier run stopped: items dealt to parts, a part's result written at once or not at all.

    <path>/items/part=<k>/...   the items, dealt once by hash of their key
    <path>/done/<k>/...         what the work made of part k; finished when its _SUCCESS is there
    <path>/failed/<k>           the error of the last attempt at part k

A run passes over finished parts and does the others, failed ones too. A part whose work fails doesn't stop the rest.
The driver holds the numbers of parts, no items.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Report:
    finished: list[int]  # parts that this run has done
    skipped: list[int]  # that earlier runs had done
    failed: dict[int, str]  # that failed in this run, with their error


class Resumable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._file(name))

    def deal(self, items: DataFrame, key: str, parts: int = 16) -> None:
        """Fixes the items of the work, once; a second call changes nothing. Null keys are one key."""
        if not self._there("items/_SUCCESS"):
            dealt = items.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
            dealt.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/items")

    def parts(self) -> list[int]:
        """The numbers of the parts that have items."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._file("items"))] if self._there("items") else []
        return sorted(int(n.removeprefix("part=")) for n in names if n.startswith("part="))

    def finished(self) -> list[int]:
        return [k for k in self.parts() if self._there(f"done/{k}/_SUCCESS")]

    def run(self, work: Callable[[DataFrame], DataFrame], most: int | None = None) -> Report:
        """Does the work for at most `most` parts that aren't finished. work: the items of a part to rows, of one schema."""
        skipped, done, failed = self.finished(), [], {}
        for k in [k for k in self.parts() if k not in set(skipped)][:most]:
            try:
                work(self.spark.read.parquet(f"{self.path}/items/part={k}")).write.mode("overwrite").parquet(f"{self.path}/done/{k}")
            except Exception as e:  # the next parts are no worse for it; the report and the folder keep the error
                failed[k] = str(e).splitlines()[0]
                out = self._fs.create(self._file(f"failed/{k}"), True)
                out.write(bytearray(failed[k].encode()))
                out.close()
            else:
                done.append(k)
                self._fs.delete(self._file(f"failed/{k}"), False)
        return Report(done, skipped, failed)

    def results(self) -> DataFrame:
        """What finished parts have made."""
        found = self.finished()
        if not found:
            raise ValueError(f"{self.path} has no finished part")
        return self.spark.read.parquet(*[f"{self.path}/done/{k}" for k in found])
