"""Report datasets in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import scoring

INCIDENT_SERIES = ["inc_count", "rolling_7d", "fire_count", "hits", "shutdowns", "defended_count", "combined_count"]


def timeline(daily: DataFrame, intense: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """Seven incident series and nine signal series as rows (keys, date, series, axis, value, band, bucket)."""
    marked = (
        daily.join(intense.select(*keys, "date", "intense"), [*keys, "date"], "left")
        .withColumn("band", F.when(F.col("intense"), "intense").otherwise("any"))
        .withColumn("bucket", scoring.severity_bucket(F.col("avg_severity")))
    )
    left = marked.select(*keys, "date", "band", "bucket", *[F.col(c).cast("double").alias(c) for c in INCIDENT_SERIES])
    left = left.unpivot([*keys, "date", "band", "bucket"], INCIDENT_SERIES, "series", "value").withColumn("axis", F.lit("incidents"))
    right = signals.select(*keys, "date", *[F.col(c).cast("double").alias(c) for c in K.SIGNALS])
    right = right.unpivot([*keys, "date"], K.SIGNALS, "series", "value").withColumn("axis", F.lit("signals"))
    return left.unionByName(right, allowMissingColumns=True)
