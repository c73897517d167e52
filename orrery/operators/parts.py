"""A keyed table dealt to parts by hash of its key, so that an upsert rewrites only the parts that its keys fall into.

    <table>/data/<version>/part=<k>/...   what a version wrote
    <table>/manifests/<version>           a line for each part: its number and the version that holds it

A version becomes the table's when its manifest is renamed into place, which the file system does at once; until
then readers see the version before, and whatever a failed run has written is in no manifest and written over by
the next. One writer at a time: a second one that publishes the same version fails. The number of parts is fixed when the table is made; the list of touched
parts, and no rows, goes through the driver. Old versions can be read until vacuum() deletes what no manifest that is left names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part"


class PartedTable:
    """The table of one folder. keys: the columns of its key; null is a key like any other."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts
        self._jvm = spark.sparkContext._jvm
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._file(path)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """The numbers of the published versions, ascending."""
        return sorted(int(n) for n in self._names(f"{self.path}/manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Part and the version that holds it; empty before the first version."""
        known = self.versions()
        if version is None and not known:
            return {}
        stream = self._fs.open(self._file(f"{self.path}/manifests/{known[-1] if version is None else version}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(a): int(b) for a, b in (line.split() for line in text.splitlines()[1:])}

    def schema(self) -> str:
        stream = self._fs.open(self._file(f"{self.path}/manifests/{self.versions()[-1]}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()[0]
        finally:
            stream.close()

    def _publish(self, version: int, schema: str, held: dict[int, int]) -> None:
        tmp, final = (self._file(f"{self.path}/manifests/{n}") for n in (f"_{version}", str(version)))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(tmp, True)
        try:
            out.write(bytearray("\n".join([schema, *(f"{p} {v}" for p, v in sorted(held.items()))]).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            raise RuntimeError(f"version {version} of {self.path} was published by another writer")

    def read(self, version: int | None = None, parts: set[int] | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named; of some parts alone, if they are."""
        held = self.manifest(version)
        if not held and version is None and not self.versions():
            raise ValueError(f"{self.path} has no version yet")
        paths = [f"{self.path}/data/{v}/{PART}={p}" for p, v in held.items() if parts is None or p in parts]
        empty = self.spark.createDataFrame([], self.schema())
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def _write(self, rows: DataFrame, version: int) -> set[int]:
        """Writes dealt rows; a part of many rows may become several files. Returns the parts that have rows."""
        at = f"{self.path}/data/{version}"
        self._fs.delete(self._file(at), True)  # left by a run that failed
        rows.hint("rebalance", PART).write.partitionBy(PART).parquet(at)
        return {int(n.split("=")[1]) for n in self._names(at) if n.startswith(f"{PART}=")}

    def create(self, df: DataFrame) -> None:
        """The first version: rows of unique keys."""
        if self.versions():
            raise ValueError(f"{self.path} has versions already")
        parts = self._write(self._dealt(df), 1)
        self._publish(1, _ddl(df), {p: 1 for p in parts})

    def upsert(self, batch: DataFrame, merged: dict[str, Callable[[Column, Column], Column]] | None = None, delete: Column | None = None) -> set[int]:
        """Rows of unique keys put in, in place of those of their key; a new version. Returns the parts that were rewritten.

        merged: for columns of keys that are there already, the value from the old and the new one, else the new one
        counts. delete: a condition on the batch (its own columns may be more than the table's); such keys go. An empty batch
        makes no version.
        """
        held, version, columns = self.manifest(), self.versions()[-1] + 1, self.read().columns
        new = self._dealt(batch.withColumn("__delete", F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)))
        touched = {r[PART] for r in new.select(PART).distinct().collect()}  # at most `parts` numbers
        if not touched:
            return touched
        old = self._dealt(self.read(parts=touched))
        o, n = old.select(*[F.col(f"`{c}`").alias(f"o_{c}") for c in [*columns, PART]]).withColumn("o_", F.lit(True)), new.select(*[F.col(f"`{c}`").alias(f"n_{c}") for c in [*columns, PART]], F.col("__delete").alias("n_delete")).withColumn("n_", F.lit(True))
        on = F.lit(True)
        for c in [PART, *self.keys]:
            on = on & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
        both = o.join(n, on, "full").filter(~F.coalesce("n_delete", F.lit(False)))
        there, came = F.col("o_").isNotNull(), F.col("n_").isNotNull()
        merged = merged or {}
        pick = lambda c: F.when(came & there, merged[c](F.col(f"o_{c}"), F.col(f"n_{c}")) if c in merged else F.col(f"n_{c}")).when(came, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        rows = both.select(*[pick(c).alias(c) for c in columns], F.coalesce(f"o_{PART}", f"n_{PART}").alias(PART))
        written = self._write(rows, version)
        self._publish(version, self.schema(), {p: v for p, v in held.items() if p not in touched} | {p: version for p in written})
        return touched

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last `keep` versions: their manifests, and the parts that no manifest that is left names. Returns how many folders went."""
        known, gone = self.versions(), 0
        kept = known[-keep:] if keep else []
        used = {(v, p) for m in kept for p, v in self.manifest(m).items()}
        for m in known:
            if m not in kept:
                self._fs.delete(self._file(f"{self.path}/manifests/{m}"), False)
        for v in [int(n) for n in self._names(f"{self.path}/data") if n.isdigit() and int(n) <= known[-1]]:
            for name in self._names(f"{self.path}/data/{v}"):
                if name.startswith(f"{PART}=") and (v, int(name.split("=")[1])) not in used:
                    gone += self._fs.delete(self._file(f"{self.path}/data/{v}/{name}"), True)
        return gone


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
