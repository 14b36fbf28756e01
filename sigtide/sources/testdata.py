"""Logical inputs derived from the fixture tables (messages, signals, incidents, sites)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.operators.areas import reach_table
from sigtide.session import spread


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One fixture table; footers and listing are read once per session."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_messages(documents: DataFrame) -> DataFrame:
    """Documents as a message stream: one message per document, 30 days, channel = source."""
    minutes = F.col("doc_id") % 1440
    ts = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
          + F.make_dt_interval(days=(F.col("doc_id") % 30).cast("int"), mins=minutes.cast("int")))
    return documents.select(
        F.col("doc_id").alias("msg_id"), F.col("source").alias("channel"), ts.alias("ts"), "text")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return as_messages(table(spark, sf, "documents"))


def _channel() -> F.Column:
    return F.concat(F.lit("ch"), (F.col("user_id") % 4).cast("string"))


def event_flags(events: DataFrame) -> DataFrame:
    """One row per event with its nine signal flags."""
    kind, value = F.col("event_type"), F.col("value")
    live = kind != "error"
    report = kind.isin("click", "view") & (value >= 20)
    return events.select(
        "event_id", "ts", F.to_date("ts").alias("date"), _channel().alias("channel"),
        (kind == "click").alias("s_mention"), (kind == "view").alias("s_defence"),
        (kind == "signup").alias("s_transit"), (kind == "purchase").alias("s_uncertain"),
        report.alias("s_report"), (report & (value >= 50)).alias("s_confirmed"),
        (kind.isin("signup", "purchase") & (value >= 20)).alias("s_site"),
        live.alias("s_broad"), (live & (F.col("user_id") % 3 == 0)).alias("s_cross"),
    )


def incidents_short(spark: SparkSession, sf: str) -> DataFrame:
    """Events of type error as incidents on the same 30 days as the signals."""
    e = table(spark, sf, "events").filter(F.col("event_type") == "error")
    value, eid = F.col("value"), F.col("event_id")
    area = F.col("user_id") % 10
    return e.select(
        eid.alias("incident_id"), F.to_date("ts").alias("date"),
        F.concat(F.lit("area"), area.cast("string")).alias("area"), _channel().alias("channel"),
        F.concat(F.lit("M"), (area % 5).cast("string")).alias("macro_area"),
        F.when(value >= 100, "high").when(value >= 30, "medium").otherwise("low").alias("severity"),
        (value >= 50).alias("confirmed"), (eid % 3 == 0).alias("fire"), (eid % 7 == 0).alias("shutdown"),
        (eid % 5 == 0).alias("defended"), (eid % 11 == 0).alias("combined"),
        (eid % 4).cast("int").alias("explosions"),
        F.when(eid % 13 == 0, "merged").otherwise("active").alias("status"),
        F.col("ts").alias("created_at"),
    )


def incidents_long(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as incidents over several years: area = nation, macro area = region."""
    o = table(spark, sf, "orders")
    places = (
        table(spark, sf, "customer").select("c_custkey", "c_nationkey")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("n_name").alias("area"), F.col("r_name").alias("macro_area"))
    )
    key, prio, status = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    return o.join(places, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("incident_id"), F.to_date("o_orderdate").alias("date"), "area", "macro_area",
        F.col("o_custkey").alias("place_id"),
        F.when(prio == "1-URGENT", "high").when(prio.isin("2-HIGH", "3-MEDIUM"), "medium").otherwise("low").alias("severity"),
        (status == "F").alias("confirmed"), (key % 3 == 0).alias("fire"), (key % 7 == 0).alias("shutdown"),
        (key % 5 == 0).alias("defended"), (key % 11 == 0).alias("combined"),
        (key % 4).cast("int").alias("explosions"),
        F.when(status == "P", "merged").otherwise("active").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"),
    )


def signals_long(spark: SparkSession, sf: str) -> DataFrame:
    """Nine daily counters per macro area over the whole order history."""
    i = incidents_long(spark, sf)
    live = F.col("status") == "active"
    n = lambda cond: F.count_if(cond)
    return i.groupBy("macro_area", "date").agg(
        n(F.col("severity") == "high").alias("s_mention"), n(F.col("severity") == "medium").alias("s_defence"),
        n(F.col("severity") == "low").alias("s_transit"), n(~live).alias("s_uncertain"),
        n(F.col("price") >= 150000).alias("s_report"),
        n((F.col("price") >= 150000) & F.col("confirmed")).alias("s_confirmed"),
        n(F.col("price") < 50000).alias("s_site"), F.count("*").alias("s_broad"), n(F.col("defended")).alias("s_cross"),
        F.count("*").alias("msg_count"),
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("site_id"), F.col("p_type").alias("site_type"))


def incident_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Bridge rows as delivered; duplicates are still in."""
    return spread(table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("incident_id"), F.col("l_partkey").alias("site_id")))


def reach_short(spark: SparkSession) -> DataFrame:
    return reach_table(spark, [(f"M{i}", i + 1) for i in range(4)])


def reach_long(spark: SparkSession, sf: str) -> DataFrame:
    """Reach score 1..5 per macro area, from the region table."""
    return table(spark, sf, "region").select(
        F.col("r_name").alias("macro_area"), (F.col("r_regionkey") + 1).alias("reach_score"))
