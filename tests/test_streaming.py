import datetime as dt

from pyspark.sql import functions as F

from sigtide.operators import merge
from sigtide.operators.extract import count_signals, extract_incidents
from sigtide.rules import RulePack, demo_pack
from sigtide.session import work_dir
from sigtide.sources import messages as src
from sigtide.sources import sinks
from sigtide.sources import testdata as td
from sigtide.streaming import ingest
from sigtide.streaming.matcher import match_stream
from tests.test_incidents import CAND, candidates

PACK = demo_pack()


def landed(spark, sf, parts=3):
    """Messages landed as several files."""
    path = work_dir(spark, "landed")
    for k in range(parts):
        td.messages(spark, sf).filter(F.col("msg_id") % parts == k).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_equals_batch(spark, sf):
    path = landed(spark, sf)
    out = work_dir(spark, "out")
    stream = src.stream_messages(spark, path, files_per_batch=1)
    ingest.ingest_incidents(stream, PACK, out, work_dir(spark, "cp"))
    cols = ["msg_id", "seg", "area", "confidence", "score"]
    batch = extract_incidents(td.messages(spark, sf), PACK).select(*cols)
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == sorted(map(tuple, batch.collect()))


def test_stream_counters_over_batches_equal_batch(spark, sf):
    path, out = landed(spark, sf), work_dir(spark, "sig")
    ingest.ingest_signals(spark, src.stream_messages(spark, path, files_per_batch=1), PACK, out, work_dir(spark, "cp"))
    want = count_signals(td.messages(spark, sf), PACK)
    cols = want.columns
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == sorted(map(tuple, want.collect()))


def test_replayed_messages_drop(spark, sf):
    path, out = landed(spark, sf, 2), work_dir(spark, "dedup")
    m = src.stream_messages(spark, path)
    ingest.land_distinct(m.unionByName(m), out, work_dir(spark, "cp"))
    assert spark.read.parquet(out).count() == td.messages(spark, sf).count()


def test_late_first_messages_land(spark):
    """Unique messages years late are kept; only their replays drop."""
    path, out, cp = work_dir(spark, "late"), work_dir(spark, "late-out"), work_dir(spark, "late-cp")
    schema = "msg_id long, ts string"
    for rows in ([(1, "2024-06-01"), (2, "2024-06-02")], [(3, "2020-01-01"), (1, "2024-06-01")], [(4, "2019-01-01"), (3, "2020-01-01"), (4, "2019-01-01")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        ingest.land_distinct(spark.readStream.schema(schema).parquet(path), out, cp)
    assert sorted(r.msg_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_upsert_stops_at_a_table_it_cannot_read(spark):
    import pathlib

    import pytest
    path = work_dir(spark, "broken")
    pathlib.Path(f"{path}/date=2024-01-01").mkdir(parents=True)
    pathlib.Path(f"{path}/date=2024-01-01/part-0.parquet").write_bytes(b"no table")
    with pytest.raises(Exception):
        sinks.upsert_signals(spark, path, spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1)], "date date, channel string, n int"))
    assert pathlib.Path(f"{path}/date=2024-01-01/part-0.parquet").read_bytes() == b"no table"


def test_matcher_stream_equals_batch_fold(spark):
    rows = sorted(candidates(11, 200), key=lambda r: (r[4], r[5], r[0]))
    path, out = work_dir(spark, "cands"), work_dir(spark, "match")
    for k in range(4):   # four files in arrival order, one micro-batch each
        spark.createDataFrame(rows[k * 50:(k + 1) * 50], CAND).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    before = spark.conf.get(ingest.STATE_STORE[0], None)
    with ingest.keyed_state(spark):
        ingest.run_available(match_stream(stream, "365 days"), out, work_dir(spark, "cp"))
    assert spark.conf.get(ingest.STATE_STORE[0], None) == before
    got = {r["cand_id"]: r["incident_id"] for r in spark.read.parquet(out).collect()}
    want = {r["cand_id"]: r["incident_id"] for r in merge.assign_incidents(spark.createDataFrame(rows, CAND)).collect()}
    assert got == want


def test_upsert_rewrites_only_touched_dates(spark):
    path = work_dir(spark, "table")
    d = dt.date(2024, 1, 1)
    first = spark.createDataFrame([(d, "a", 1), (d, "b", 2), (d + dt.timedelta(1), "a", 3)], "date date, channel string, n int")
    sinks.upsert_signals(spark, path, first)
    sinks.upsert_signals(spark, path, spark.createDataFrame([(d, "a", 10), (d, "c", 7)], "date date, channel string, n int"))
    got = sorted((r["date"].day, r["channel"], r["n"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a", 10), (1, "b", 2), (1, "c", 7), (2, "a", 3)]


def test_rule_tables_build_a_pack(spark):
    rules = spark.createDataFrame([("fire", "burn", None, 1), ("facility", "depot", "depot", 2), ("site:plant", "beta", "Beta", 3)],
                                  "rule_group string, pattern string, label string, prio int")
    gaz = spark.createDataFrame([("north", "N", 1)], "alias string, area string, prio int")
    areas = spark.createDataFrame([("N", "Top", 2)], "area string, macro_area string, reach_score int")
    p = RulePack.from_tables(rules, gaz, areas)
    assert p.groups == {"fire": ["burn"]} and p.facility == [("depot", "depot")] and p.sites == [("Beta", "plant", ["beta"])]


def test_message_range_is_half_open(spark):
    df = spark.createDataFrame([(1, "2024-01-04 21:00:00"), (2, "2024-01-05 21:00:00"), (3, None)], "msg_id int, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert [r["msg_id"] for r in src.local_days(df, dt.date(2024, 1, 5), dt.date(2024, 1, 5)).collect()] == [1]


def test_registered_matcher_runs_in_a_session_without_settings(spark, sf):
    from sigtide.plans.incident_plans import _arrivals
    from sigtide.plans.stream_plans import stream_matches

    assert stream_matches(spark, sf).count() == _arrivals(spark, sf).count() > 0


def test_stream_of_a_table_that_is_a_folder(spark, sf, tmp_path):
    """A table is one file or a folder of files; a stream reads all rows of both."""
    from sigtide.plans import stream_plans

    docs = td.table(spark, sf, "documents")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(map(tuple, td.as_messages(docs).selectExpr("msg_id", "channel", "CAST(ts AS DATE)").collect()))
    for folder in (sf, str(tmp_path)):
        assert sorted(map(tuple, stream_plans.stream_distinct(spark, folder).collect())) == want
