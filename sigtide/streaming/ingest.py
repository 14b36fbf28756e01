"""Streaming jobs over landed message files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sigtide.operators.extract import count_signals, extract_incidents
from sigtide.operators.gazetteer import Dictionary
from sigtide.rules import RulePack
from sigtide.sources.sinks import upsert_signals


#: The only state store that keeps several state variables a key, which the matcher needs.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store of keyed processors, for the queries that start inside; the session's own setting comes back after."""
    name, provider = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def land_distinct(messages: DataFrame, out: str, checkpoint: str) -> None:
    """Append the messages whose id has not landed yet, however late they are; replays and repeats drop.

    Each batch is reduced to one row per id and anti-joined with the landed ids, so there is no watermark
    behind which a first message could be lost, and no state but the table itself. A batch that is retried
    after a failed write finds what it wrote and adds the rest.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates(["msg_id"])
        try:
            landed = spark.read.schema(batch.schema).parquet(out).select("msg_id")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            fresh = fresh.join(landed, "msg_id", "left_anti")
        fresh.write.mode("append").parquet(out)

    run_batches(messages, write, checkpoint, "append")


def run_available(df: DataFrame, out: str, checkpoint: str, partition: str | None = None) -> None:
    """Process what has landed, append it to a Parquet table, stop. A restart goes on from the checkpoint."""
    w = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    (w.partitionBy(partition) if partition else w).start(out).awaitTermination()


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    (df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode)
     .trigger(availableNow=True).start().awaitTermination())


def ingest_incidents(messages: DataFrame, pack: RulePack, out: str, checkpoint: str, dictionary: Dictionary | None = None) -> None:
    """Parse a message stream into incident candidates. The plan is the batch plan: no state, no shuffle."""
    run_available(extract_incidents(messages, pack, dictionary=dictionary), out, checkpoint)


def ingest_signals(spark: SparkSession, messages: DataFrame, pack: RulePack, path: str, checkpoint: str) -> None:
    """Daily counters of a message stream, kept as running state and upserted batch by batch.

    Update mode re-sends the complete counts of every day that changed, so a replayed batch
    overwrites its rows with the same values. Messages may be late by any time: state is one row of
    counters per day and channel, bounded by the calendar, so nothing is evicted and nothing is lost.
    """
    counts = count_signals(messages, pack, extra_keys=("channel",))

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()  # the upsert reads it twice
        upsert_signals(batch.sparkSession, path, batch)
        batch.unpersist()

    run_batches(counts, write, checkpoint)
