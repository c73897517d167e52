"""Sources and sinks: Parquet, CSV, JSON lines and JDBC tables, and the schemas of a catalogue."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a catalogue of organisations, as DDL.
SCHEMAS = {
    "portals": "id long, orgid string, university string, domain string, portal_url string, category string, source string, affiliated_from string, country string, state string, city string, org_type string, status string",
    "universities": "orgid string, name string, city string, state string, org_type string, website string, country string, source string",
    "feedback": "id long, orgid string, url string, verdict string, reason string, created_at timestamp, category string, source string, host string, reasoning string",
    "learned_rules": "id long, rule_type string, pattern string, action string, status string, support int, orgs int, confirms int, examples string, created_at timestamp, updated_at timestamp",
    "verified_orgs": "orgid string, name string, name_norm string, login_urls string, provider_ids string, terms_urls string, notes string, source string",
    "learned_patterns": "country string, label string, category string, hits int, last_seen timestamp",
    "login_log": "id long, email string, created_at timestamp",
    "search_log": "id long, email string, query_url string, orgid string, result_count int, results string, created_at timestamp",
    "metrics": "host string, opr_domain string, opr_authority double, opr_rank int, cf_bucket string, cf_rank int, fetched_at timestamp",
    "orgid_status": "orgid string, stage string, status string, last_error string, updated_at double, completed_at double, portals_found int",
    "stage_results": "orgid string, stage string, result_json string, updated_at double",
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves if the session is local; a cluster without it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="orrery-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream; the table is one file or a folder of them.

    The path is a pattern, as Spark takes a plain path for the base of partitions, which a file can't be.
    """
    return spark.readStream.schema(parquet(spark, sf_dir, name).schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export of a sheet: a header, all cells strings, missing ones empty."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').na.fill("")


def jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 1, **options: str) -> DataFrame:
    """A database table, read in `parts` ranges of a numeric column; filters and columns are asked of the database."""
    split = {"partitionColumn": column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts} if column else {}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **split, **options).load()


def into_database(df: DataFrame, url: str, table: str, keys: list[str], *, batch: int = 1000, connections: int = 8, columns: list[str] | None = None, **options: str) -> int:
    """Appends the rows of df whose keys the database's table lacks, and returns how many; a repeated run adds nothing.

    Written in batches, by at most `connections` tasks. A table that isn't there is made. `columns` leaves out others, as an identity
    that the database gives. Of rows with equal keys one is written; rows with a null key are written each time, as
    null equals nothing there. A failed task may have committed batches: the next run passes over them.
    """
    spark, rows = df.sparkSession, (df.select(*columns) if columns else df).dropDuplicates(keys)
    if _has_table(spark, url, table, options):
        have = jdbc(spark, url, table, **options).select(*keys)
        rows = rows.join(have.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in keys]), keys, "left_anti")
    at = scratch(spark, "to-database")  # fixed before the table that it was held against changes
    rows.write.parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    n = rows.count()
    if n:
        rows.coalesce(connections).write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode("append").save()
    return n


def _has_table(spark: SparkSession, url: str, table: str, options: dict) -> bool:
    try:
        jdbc(spark, url, table, **options)
    except Exception as e:
        if re.search("(?i)does not exist|doesn.t exist|not found|no such table|unknown table", str(e)):
            return False
        raise
    return True


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema, cast; missing ones are null. Tables grow columns this way."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([], schema).schema
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def pick(df: DataFrame, *names: str, default: str = "") -> Column:
    """The first column of df whose name, lower-cased and trimmed, is in the list of aliases."""
    by_name = {c.strip().lower(): c for c in df.columns}
    found = next((by_name[n.lower()] for n in names if n.lower() in by_name), None)
    return F.lit(default) if found is None else F.coalesce(F.col(f"`{found}`"), F.lit(default))


def backfilled(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isNull() | (F.col(column) == ""), value).otherwise(F.col(column)))


def write_sheet(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and a fixed order of columns; nulls are empty cells. The number of files follows the data."""
    df.select(*columns).na.fill("").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def append(df: DataFrame, path: str, schema: str) -> None:
    conform(df, schema).write.mode("append").parquet(path)
