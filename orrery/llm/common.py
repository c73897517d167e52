"""What several operators of this subpackage share: places for intermediate tables and text expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; a word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}  # by application: tables that stored() wrote and nobody discarded


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder of this machine serves if the session is local; a cluster without it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="orrery-")
        at = _own_dirs[app]
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that discard() deletes."""
    at = f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut and any executor can be lost."""
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the tables that stored() wrote for this application, once the results that read them are written.

    The first `since` and the last `keep` of them stay. Returns how many tables went.
    """
    jvm, conf, written = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _written.get(spark.sparkContext.applicationId, [])
    gone = written[since : len(written) - keep]
    for at in gone:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)
    written[since : len(written) - keep] = []
    return len(gone)


def n_stored(spark: SparkSession) -> int:
    """How many tables of this application are there."""
    return len(_written.get(spark.sparkContext.applicationId, []))


BATCH_ROWS = 1_000


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on in this session, unless it has less.

    Rows with whole texts or sets are long, and the default of ten thousand of them is in memory on both sides.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs within."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs within."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
