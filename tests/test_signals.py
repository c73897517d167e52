"""Streams with state in the state store: many batches, out of order, late rows, a restart, bounded state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orrery.streaming import signals

DAY = datetime(2024, 5, 1)
SCHEMA = "host string, size string, at timestamp"


def runs_of(rows, least, idle):
    out = []
    for key in {k for k, _, _ in rows if k is not None}:
        run = None
        for at, value in sorted(((a, v) for k, v, a in rows if k == key and a is not None), key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            if run is None or run[0] != value or at - run[3] > idle:
                run = (value, 0, at, at)
            run = (value, run[1] + 1, run[2], at)
            if run[1] == least:
                out.append((key, value, run[2], at))
    return sorted(out, key=str)


def stream(spark, at):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)


def put(spark, rows, at):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)


@pytest.fixture()
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_batches_restart_and_late_rows(few, tmp_path):
    rnd = random.Random(5)
    hours = lambda h: DAY + timedelta(hours=h)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice(["1", "1", "2", None]), hours(i // 3) + timedelta(seconds=i)) for i in range(150)]
    parts = [rows[i : i + 50] for i in range(0, 150, 50)]
    for p in parts:  # out of order within a batch, and by less than the delay between batches
        rnd.shuffle(p)
    parts[0][-1], parts[1][0] = (parts[1][0] if parts[1][0][2] < hours(20) else parts[0][-1]), parts[1][0]
    given, table, log = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/log"
    run = lambda: signals.landed(signals.signals(stream(few, given), key="host", value="size", at="at", delay="30 hours", idle=timedelta(hours=40)), table=table, checkpoint=log)
    put(few, parts[0], given)
    run()
    for p in parts[1:]:
        put(few, p, given)
        run()  # a restart from the checkpoint
    late = ("a", "9", DAY - timedelta(days=9))
    put(few, [late, late, late, ("z", "end", hours(1000))], given)  # the last row moves the watermark past all others
    got = sorted(map(tuple, run().select("key", "value", "since", "at").collect()), key=str)
    kept = [r for p in parts for r in p]
    assert got == runs_of(kept, 3, timedelta(hours=40)) and len(got) > 5
    assert run().count() == len(got)  # nothing new, nothing twice


def test_state_is_bounded(few, tmp_path):
    given, log = f"{tmp_path}/in", f"{tmp_path}/log"
    sizes = []
    for day in range(4):
        put(few, [(f"h{day}-{i % 40}", "x", DAY + timedelta(days=day, minutes=i)) for i in range(200)], given)
        found = signals.signals(stream(few, given), key="host", value="size", at="at", delay="1 hour", idle=timedelta(hours=5))
        with signals.rocksdb(few):
            q = found.writeStream.format("noop").option("checkpointLocation", log).trigger(availableNow=True).start()
            q.awaitTermination()
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert sizes[-1] <= 2 * sizes[0]  # the keys of earlier days are gone
    assert few.conf.get("spark.sql.streaming.stateStore.providerClass") != signals.ROCKSDB


def test_null_keys_and_empty_streams(few, tmp_path):
    put(few, [(None, "x", DAY), ("a", "x", None)], f"{tmp_path}/in")
    found = signals.signals(stream(few, f"{tmp_path}/in"), key="host", value="size", at="at", delay="1 hour", idle=timedelta(hours=5))
    assert signals.landed(found, table=f"{tmp_path}/out", checkpoint=f"{tmp_path}/log").filter(F.lit(True)).count() == 0
