"""Structured Streaming forms of logs with a last word: the state of each key as entries arrive, written once a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The state store that streams with state of their own and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """SK4, SK6: the last entry of each key of a stream; its state is one entry a key."""
    rest = [c for c in log.columns if c != key and c not in order]
    return log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("entry")).select(key, "entry.*")


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of a stream by time window and column; entries later than `late` are dropped and their windows leave the state."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"))


def into_batches(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is available of a stream, one folder a batch; a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def last_of_batches(written: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each key after the last batch that changed it."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("entry")).select(*keys, *[F.col(f"entry.{c}") for c in rest])
