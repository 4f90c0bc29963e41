"""SK6, SC10: the stages of papers and the age of their last entry, as a stream with state and timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


_Change = Row("paper", "stage", "status", "us", "seq", "stale")


class _Stages(StatefulProcessor):
    """Of each paper the place of the newest entry of each stage, and the newest time of all; a paper whose newest time is older than `keep_ms` goes stale.

    Each call of the state is a round trip to the JVM, so a paper's state is one value, read and written once a batch, and its
    timer is set once: one that runs out while the paper has newer entries is set again.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paper = handle.getValueState("paper", "last bigint, stages array<string>, us array<bigint>, seqs array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best: dict[str, tuple] = {}
        for row in rows:
            if row.stage not in best or best[row.stage][:2] <= (row.us, row.seq):
                best[row.stage] = (row.us, row.seq, row.status)
        held = self.paper.get()
        newest = dict(zip(held[1], zip(held[2], held[3]))) if held else {}
        changed = {stage: b for stage, b in best.items() if stage not in newest or newest[stage] < b[:2]}
        before, last = held[0] if held else None, max(b[0] for b in best.values())
        if held is None:
            self.handle.registerTimer(last // 1000 + self.keep_ms)
        if changed or last > before:
            newest.update({stage: b[:2] for stage, b in changed.items()})
            self.paper.update((last if before is None else max(last, before), list(newest), [p[0] for p in newest.values()], [p[1] for p in newest.values()]))
        for stage, (us, seq, status) in changed.items():
            yield _Change(key[0], stage, status, us, seq, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.paper.get()[0]
        due = last // 1000 + self.keep_ms
        if due > expiredTimerInfo.getExpiryTimeInMs() and due >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            self.paper.clear()
            yield _Change(key[0], None, None, last, None, True)

    def close(self) -> None:
        pass


def stage_changes(log: DataFrame, keep: str = "7 days", late: str = "1 day") -> DataFrame:
    """SK6: what changes in a stream log(paper, stage, status, at, seq): entries that are the newest of their paper and stage, and papers that go stale.

    Entries count in the order of (at, seq), not of arrival; those that come more than `late` behind are dropped. A paper without
    an entry for `keep` gives a row without a stage, at its last entry, and leaves the state; a later entry brings it back. Rows without
    a paper, stage or time are left out; equal entries count once. Two entries that differ in nothing but the status have no
    defined order: seq has to tell them apart.
    """
    key = dict(log.dtypes)["paper"]
    keep_ms = int(log.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00' + INTERVAL {keep}) - unix_millis(timestamp'1970-01-01 00:00:00') AS ms").first()["ms"])
    rows = log.filter("paper is not null and stage is not null and at is not null").select("paper", "stage", "status", F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("seq"))
    timed = rows.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    schema = f"paper {key}, stage string, status string, us bigint, seq bigint, stale boolean"
    changes = timed.groupBy("paper").transformWithState(_Stages(keep_ms), schema, "Update", "EventTime")
    return changes.select("paper", "stage", "status", F.timestamp_micros("us").alias("at"), "seq", "stale")


def stage_states(written: DataFrame) -> DataFrame:
    """(paper, stage, status, at, seq, stale) out of all changes that were written: the newest entry of each stage, and whether its paper is stale.

    A change that a repeated or later batch brings again changes nothing.
    """
    stages = written.filter(~F.col("stale")).groupBy("paper", "stage").agg(F.max(F.struct("at", "seq", "status")).alias("e"))
    stales = written.filter("stale").groupBy("paper").agg(F.max("at").alias("stale_at"))
    found = stages.select("paper", "stage", "e.status", "e.at", "e.seq").join(stales, "paper", "left")
    last = F.max("at").over(Window.partitionBy("paper"))
    return found.withColumn("stale", F.coalesce(F.col("stale_at") >= last, F.lit(False))).drop("stale_at")


def stage_totals(log: DataFrame, until: str, keep: str = "7 days") -> DataFrame:
    """The same states out of a whole log at once, as they are when the watermark has come to the time `until`."""
    rows = log.filter("paper is not null and stage is not null and at is not null")
    stages = rows.groupBy("paper", "stage").agg(F.max(F.struct("at", F.coalesce("seq", F.lit(0)).alias("seq"), "status")).alias("e"))
    found = stages.select("paper", "stage", "e.status", "e.at", F.col("e.seq").cast("bigint").alias("seq"))
    return found.withColumn("stale", F.max("at").over(Window.partitionBy("paper")) + F.expr(f"INTERVAL {keep}") < F.expr(f"timestamp'{until}'"))
