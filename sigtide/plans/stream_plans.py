"""Sinks and streams, run over the fixture tables and read back: the same oracles as the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.operators import merge
from sigtide.plans import oracle as o
from sigtide.plans.common import PACK, signals_short
from sigtide.plans.eval_plans import _GRID, grid_table
from sigtide.plans.incident_plans import _arrivals
from sigtide.plans.registry import query
from sigtide.plans.text_plans import INCIDENTS_SQL, MESSAGE_SIGNALS_SQL, flat_incidents
from sigtide.session import work_dir
from sigtide.sources import sinks
from sigtide.sources import testdata as td
from sigtide.streaming import ingest
from sigtide.streaming.matcher import match_stream


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One fixture table, a file or a folder of files, as a file stream."""
    table = td.table(spark, sf, name)
    stream, file = spark.readStream.schema(table.schema), f"{name}.parquet"
    if all(f.rsplit("/", 1)[-1] == file for f in table.inputFiles()):  # a stream's path must be a folder
        return stream.option("pathGlobFilter", file).parquet(sf)
    return stream.parquet(f"{sf}/{file}")


@query("ST1 X24", INCIDENTS_SQL)
def stream_incidents(spark, sf):
    out, checkpoint = work_dir(spark, "incidents"), work_dir(spark, "incidents-cp")
    ingest.ingest_incidents(td.as_messages(stream_table(spark, sf, "documents")), PACK, out, checkpoint)
    return flat_incidents(spark.read.parquet(out))


@query("ST2 M1 X26", MESSAGE_SIGNALS_SQL)
def stream_signals(spark, sf):
    out, checkpoint = work_dir(spark, "signals"), work_dir(spark, "signals-cp")
    ingest.ingest_signals(spark, td.as_messages(stream_table(spark, sf, "documents")), PACK, out, checkpoint)
    return spark.read.parquet(out)


@query("ST4", f"WITH {o.MESSAGES} SELECT msg_id, channel, CAST(ts AS DATE) AS date FROM messages")
def stream_distinct(spark, sf):
    """Every message twice in the stream, once in the output."""
    out, checkpoint = work_dir(spark, "distinct"), work_dir(spark, "distinct-cp")
    m = td.as_messages(stream_table(spark, sf, "documents")).select("msg_id", "channel", "ts")
    ingest.land_distinct(m.unionByName(m), out, checkpoint)
    return spark.read.parquet(out).select("msg_id", "channel", F.to_date("ts").alias("date"))


@query("ST3")
def stream_matches(spark, sf):
    """Arrival-order matching as a keyed stateful stream over landed candidates."""
    landed, out, checkpoint = work_dir(spark, "cands"), work_dir(spark, "matches"), work_dir(spark, "matches-cp")
    cands = _arrivals(spark, sf).select("cand_id", "area", "incident_date", "site_types", "ts", "seg")
    cands.write.mode("overwrite").parquet(landed)
    stream = spark.readStream.schema(cands.schema).option("maxFilesPerTrigger", 1000).parquet(landed)
    with ingest.keyed_state(spark):
        ingest.run_available(match_stream(stream), out, checkpoint)
    return spark.read.parquet(out)


@query("S7 S8", f"WITH {_GRID} SELECT * FROM grid")
def csv_round_trip(spark, sf):
    path, grid = work_dir(spark, "grid"), grid_table(spark, sf)
    sinks.write_csv(grid, path)
    return sinks.read_csv(spark, path, grid.schema)


@query("S9 D6", f"WITH {_GRID} SELECT * FROM grid")
def json_round_trip(spark, sf):
    path, grid = work_dir(spark, "grid-json"), grid_table(spark, sf)
    sinks.write_json(grid, path)
    return spark.read.schema(grid.schema).json(path)


@query("S10", f"WITH {_GRID} SELECT *, 'a' AS run_date FROM grid UNION ALL SELECT *, 'b' FROM grid")
def appended_log(spark, sf):
    path, grid = work_dir(spark, "log"), grid_table(spark, sf)
    for run in ("a", "b"):
        sinks.append_log(grid.withColumn("run_date", F.lit(run)), path)
    return spark.read.parquet(path)


@query("S13", f"WITH {_GRID} SELECT target, lookback, horizon, auc FROM grid WHERE auc > 0.5")
def saved_bank(spark, sf):
    """Two versions of a bank saved, the latest loaded."""
    path, grid = work_dir(spark, "bank"), grid_table(spark, sf).select("target", "lookback", "horizon", "auc")
    sinks.save_bank(grid, path, "v1")
    sinks.save_bank(grid.filter(F.col("auc") > 0.5), path, "v2")
    return sinks.load_bank(spark, path)


@query("M1 ST2", f"""WITH {o.SIG_SHORT} SELECT date, channel, CASE WHEN date >= DATE '2024-01-20' THEN s_mention + 1 ELSE s_mention END AS s_mention, msg_count FROM sig_short""")
def upserted_table(spark, sf):
    """A date-partitioned table written, then upserted for its last days."""
    path = work_dir(spark, "signals-table")
    s = signals_short(spark, sf).select("date", "channel", "s_mention", "msg_count")
    sinks.upsert_signals(spark, path, s)
    late = s.filter(F.col("date") >= F.lit("2024-01-20").cast("date")).withColumn("s_mention", F.col("s_mention") + 1)
    sinks.upsert_signals(spark, path, late)
    return spark.read.parquet(path)
