"""Registered queries against their oracle SQL. SIGTIDE_ALL=1 runs every one of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from sigtide.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["text_clean", "detector_flags", "event_segments", "parsed_incidents", "incidents_with_sites", "repeated_incidents", "matched_incidents",
         "audit_rows", "full_daily", "features_all", "auc_overall", "selected_configs", "warning_levels", "prediction_log", "nearest_vectors",
         "feature_outcome_correlation", "regime_labels"]
SQL = entry_module.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("SIGTIDE_ALL") else QUICK


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sf, duck, name):
    df = QUERIES[name].plan(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_returns_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_incident_scan_prunes_and_pushes(spark, sf):
    from pyspark.sql import functions as F

    from sigtide.sources import testdata as td
    df = td.table(spark, sf, "events").filter(F.col("event_type") == "error").select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "props" not in plan


def test_parsing_plan_has_no_shuffle(spark, sf):
    from sigtide.operators.extract import extract_incidents
    from sigtide.rules import demo_pack
    from sigtide.sources import testdata as td
    many = td.messages(spark, sf).repartition(64)   # as a large table comes: more partitions than cores
    plan = extract_incidents(many, demo_pack())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1   # the one above
