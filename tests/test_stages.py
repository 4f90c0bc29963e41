"""Stages as a stream of many batches with late entries, stale papers and a restart from the checkpoint."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmesh.streaming import stages, states

SCHEMA = "paper bigint, stage string, status string, at timestamp, seq bigint"
START = datetime(2024, 1, 1)


def batches(n=10):
    """Each batch covers two days; a third of its entries are up to ten hours late, some rows repeat or lack something."""
    rng, seq, out = random.Random(7), 0, []
    for b in range(n):
        rows = []
        for _ in range(40):
            seq += 1
            paper = rng.choice([rng.randrange(6), 6 + b])
            at = START + timedelta(days=2 * b, hours=rng.randrange(12, 48)) - timedelta(hours=rng.choice([0, 0, 10]))
            rows.append((paper, rng.choice("abc"), rng.choice(["done", "failed"]), at, seq))
        out.append(rows + rows[:3] + [(None, "a", "done", START, 1), (1, None, "done", START, 1), (1, "a", "done", None, 1)])
    return out


def run(spark, log, out, checkpoint, stop_after=None):
    """Run over what is there, one file a batch; fail at a batch, after it is written, if asked to."""
    changes = stages.stage_changes(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(log))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == stop_after:
            raise RuntimeError("lost")

    changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, states.STORE)
    yield
    spark.conf.set(key, before)


def test_ten_batches_and_a_restart_equal_the_whole_log(spark, tmp_path, rocks):
    log, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    whole = batches()
    for i, rows in enumerate(whole):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        if i == 4:  # five batches, lost in the middle after the write of the third
            with pytest.raises(Exception, match="lost"):
                run(spark, log, out, checkpoint, 2)
            run(spark, log, out, checkpoint)
    run(spark, log, out, checkpoint)
    written = spark.read.parquet(out)
    assert written.select("batch").distinct().count() >= 10
    top = max(r[3] for rows in whole for r in rows if r[3])
    got = {tuple(r) for r in stages.stage_states(written.drop("batch")).collect()}
    log_rows = spark.createDataFrame([r for rows in whole for r in rows], SCHEMA)
    until = str(top - timedelta(days=1))
    expected = {tuple(r) for r in stages.stage_totals(log_rows, until).collect()}
    assert got == expected
    assert {r[5] for r in got} == {True, False}
    by = {}
    for p, s, status, at, seq in (r for rows in whole for r in rows if None not in r):
        by[p, s] = max(by.get((p, s), (START, 0, "")), (at, seq, status))
    assert {(r[0], r[1]): (r[3], r[4], r[2]) for r in got} == by
    assert written.filter("stale").groupBy("paper", "at").count().filter(F.col("count") > 1).count() == 0


def test_entries_behind_the_watermark_are_dropped(spark, tmp_path, rocks):
    log, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "checkpoint"))
    for rows in ([(1, "a", "done", START, 1)], [(2, "a", "done", START + timedelta(days=30), 2)], [(1, "a", "failed", START + timedelta(days=1), 3)], [(1, "b", "done", START + timedelta(days=30), 4)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        run(spark, log, out, checkpoint)
    got = sorted((r.paper, r.stage, r.status, r.stale) for r in stages.stage_states(spark.read.parquet(out)).collect())
    assert got == [(1, "a", "done", False), (1, "b", "done", False), (2, "a", "done", False)]
    assert spark.read.parquet(out).filter("stale").count() == 1


class Calls:
    """A state and its handle in one that counts what goes to the JVM."""

    def __init__(self):
        self.n, self.value, self.timers = 0, None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n, self.value = self.n + 1, value

    def clear(self):
        self.n, self.value = self.n + 1, None

    def registerTimer(self, at):
        self.n += 1
        self.timers.append(at)

    def getExpiryTimeInMs(self):
        return self.timers[-1]

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_batch_reads_and_writes_the_state_of_a_paper_once():
    entry, calls, stream = Row("stage", "status", "us", "seq"), Calls(), stages._Stages(10)
    stream.init(calls)
    put = lambda us: [r.stage for r in stream.handleInputRows((1,), iter([entry(f"s{i}", "done", us, i) for i in range(50)]), calls)]
    assert len(put(1000)) == 50 and calls.n == 3 and calls.timers == [11]
    assert len(put(5000)) == 50 and calls.n == 5 and calls.timers == [11]
    assert put(2000) == [] and calls.n == 6  # older entries change nothing
    calls.watermark = 13  # the timer runs out, but the paper is due at 15
    assert list(stream.handleExpiredTimer((1,), calls, calls)) == [] and calls.timers == [11, 15] and calls.value is not None
    calls.watermark = 16
    assert [tuple(r) for r in stream.handleExpiredTimer((1,), calls, calls)] == [(1, None, None, 5000, None, True)] and calls.value is None
