"""Message scans: batch and streaming, half-open time ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.functions.dates import utc_bounds

MESSAGE_SCHEMA = "msg_id bigint, channel string, ts timestamp_ntz, text string"


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(MESSAGE_SCHEMA).format(fmt).load(path)


def stream_messages(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Landed message files as a stream; the batch size is the back-pressure."""
    return (spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
            .format(fmt).load(path))


def in_range(messages: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Messages of [start, end); undated ones never match."""
    return messages.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def local_days(messages: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Messages of the local days first..last."""
    return in_range(messages, *utc_bounds(first, last))
