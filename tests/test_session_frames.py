"""Model queries read the incidents and links behind a session's daily frame once, however many passes they make over it."""

import datetime as dt

import pytest

from sigtide.operators import boosting, clusters, correlate
from sigtide.plans import model_plans as mp
from sigtide.plans.common import long_daily
from sigtide.plans.daily_plans import type_outcomes

LARGE = ("orders.parquet", "lineitem.parquet", "customer.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, d0 = str(tmp_path_factory.mktemp("tables")), dt.datetime(1995, 1, 1)
    rows = {
        "region": ([(0, "R0"), (1, "R1")], "r_regionkey int, r_name string"),
        "nation": ([(i, f"N{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, i % 4) for i in range(8)], "c_custkey long, c_nationkey int"),
        "orders": ([(i, i * 5 % 8, "OFP"[i % 3], 1000.0 * (i * 7 % 200), d0 + dt.timedelta(days=i * 3 % 45), f"{i % 5 + 1}-URGENT") for i in range(160)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i * 3 % 160, i % 6) for i in range(400)], "l_orderkey long, l_partkey long"),
        "part": ([(i, ["LARGE", "Small", None][i % 3]) for i in range(6)], "p_partkey long, p_type string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def large(df):
    return [f for f in df.inputFiles() if any(name in f for name in LARGE)]


class Stop(Exception):
    pass


def handed(monkeypatch, module, name):
    """What a call is given, instead of the call."""
    seen = []

    def spy(*given, **named):
        seen.extend([*given, *named.values()])
        raise Stop

    monkeypatch.setattr(module, name, spy)
    return seen


def frames(seen):
    return [x for x in seen if hasattr(x, "inputFiles")]


def test_kept_frames_hold_the_same_rows(spark, tables):
    for kept, made in ((mp.days, long_daily), (mp.types, type_outcomes)):
        a, b = kept(spark, tables), made(spark, tables)
        assert a.schema.names == b.schema.names and a.count() and not large(a)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_boosted_folds_get_kept_frames(spark, tables, monkeypatch):
    seen = handed(monkeypatch, boosting, "train_boosted")
    with pytest.raises(Stop):
        mp.boosted_folds(spark, tables)
    assert len(frames(seen)) == 3 and not any(large(f) for f in frames(seen))


def test_boosted_influence_reads_kept_frames(spark, tables, monkeypatch):
    days = mp.days(spark, tables)
    grid = handed(monkeypatch, mp.models, "grid_search")
    with pytest.raises(Stop):
        mp.boosted_influence(spark, tables)
    monkeypatch.setattr(mp, "boosted_latest", lambda *_: days)
    monkeypatch.setattr(mp.summary, "forecast_signals", lambda *_: days)
    corr = handed(monkeypatch, correlate, "feature_outcome_corr")
    with pytest.raises(Stop):
        mp.boosted_influence(spark, tables)
    assert len(frames(grid)) == 2 and len(frames(corr)) == 1
    assert not any(large(f) for f in [*frames(grid), *frames(corr)])


def test_profiles_scale_and_cluster_stored_rows(spark, tables, monkeypatch):
    seen = handed(monkeypatch, clusters, "find_profiles")
    with pytest.raises(Stop):
        mp.signal_profiles(spark, tables)
    stored = frames(seen)[0]
    assert stored.count() and stored.inputFiles() and not any("days-" in f for f in stored.inputFiles()) and not large(stored)
