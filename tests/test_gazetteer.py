import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from sigtide.functions.detect import Detector
from sigtide.operators.extract import extract_incidents
from sigtide.operators.gazetteer import PART_ROWS, _to_arrow, known, split_rules, write_dictionary
from sigtide.rules import RulePack, demo_pack
from sigtide.streaming.ingest import ingest_incidents

ALIASES = "alias string, area string, prio long"
SITES = "label string, type string, pattern string, prio long"
PACK = demo_pack()


def random_words(n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices("abcde", k=rng.randint(3, 9))) for _ in range(2 * n)})[:n]


def demo_dictionary(spark, folder, more=()):
    rows = [(label, kind, p, i) for i, (label, kind, ps) in enumerate(PACK.sites) for p in ps]
    return write_dictionary(str(folder), spark.createDataFrame([*PACK.gazetteer, *more], ALIASES), spark.createDataFrame(rows, SITES))


def bare():
    return RulePack(gazetteer=[], areas=[], groups=PACK.groups, facility=PACK.facility, sites=[], type_labels=PACK.type_labels,
                    months=PACK.months, number_words=PACK.number_words)


@pytest.mark.parametrize("file_rows", [1_000_000, 3000])
def test_20_000_aliases_equal_brute_force(spark, tmp_path, file_rows):
    words = random_words(20_000, 1)
    rng = random.Random(2)
    rows = [(w, f"A{rng.randrange(50)}", rng.randrange(5)) for w in words]
    texts = [(i, "".join(rng.choices("abcdefg ", k=rng.randint(0, 60)))) for i in range(300)] + [(300, None), (301, "")]
    d = write_dictionary(str(tmp_path / "d"), spark.createDataFrame([*rows, *rows[:10], ("", "no", 0), (None, "no", 0)], ALIASES), file_rows=file_rows)
    df = spark.createDataFrame(texts, "id long, low string").repartition(3).withColumn("_known", known(d, F.col("low")))
    got = {r["id"]: r for r in df.select("id", Detector(bare(), F.col("_known")).area(F.col("low")).alias("area"), F.size("_known.areas").alias("n")).collect()}
    for i, t in texts:
        held = sorted((-len(w), prio, w, area) for w, area, prio in rows if w in (t or ""))
        assert got[i]["n"] == len(held) and got[i]["area"] == (held[0][3] if held else None)


def test_plan_does_not_grow_and_has_no_shuffle(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "x")], "msg_id long, channel string, text string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz")).repartition(64)
    many = [(w, "A", 9) for w in random_words(20_000, 3)]
    plans = [extract_incidents(df, bare(), dictionary=demo_dictionary(spark, tmp_path / n, more))._jdf.queryExecution().executedPlan().toString()
             for n, more in (("few", []), ("many", many))]
    assert abs(len(plans[0]) - len(plans[1])) < 500 and plans[1].count("Exchange") == 1


def test_a_message_is_split_once_and_facilities_are_looked_up_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "x")], "msg_id long, channel string, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    plan = extract_incidents(df, bare(), dictionary=demo_dictionary(spark, tmp_path / "d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert plan.count(" THEN depot") == 1 and "eaule|euxle" not in plan


def test_incidents_equal_those_of_the_pack(spark, sf, tmp_path):
    from sigtide.sources import testdata as td
    d = demo_dictionary(spark, tmp_path / "d")
    msgs = td.messages(spark, sf)
    want, got = extract_incidents(msgs, PACK), extract_incidents(msgs, bare(), dictionary=d)
    assert want.count() == got.count() > 0 and want.exceptAll(got).isEmpty()


def test_a_stream_uses_the_dictionary(spark, sf, tmp_path):
    from sigtide.sources import testdata as td
    msgs = td.messages(spark, sf)
    msgs.write.parquet(str(tmp_path / "in"))
    d = demo_dictionary(spark, tmp_path / "d")
    ingest_incidents(spark.readStream.schema(msgs.schema).parquet(str(tmp_path / "in")), bare(), str(tmp_path / "out"), str(tmp_path / "cp"), d)
    assert spark.read.parquet(str(tmp_path / "out")).count() == extract_incidents(msgs, PACK).count()


def test_alias_over_the_joint_of_two_sentences(spark, tmp_path):
    """A segment joins its sentences by a space; the message has a dash there."""
    d = write_dictionary(str(tmp_path / "d"), spark.createDataFrame([("east port", "E", 1)], ALIASES), spark.createDataFrame([], SITES))
    plain = RulePack(**{**vars(bare()), "gazetteer": [("east port", "E", 1)]})
    df = spark.createDataFrame([(1, "c", "Erth ndst blest east — port.")], "msg_id long, channel string, text string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = lambda x: x.select("area", "site_types", "score").collect()
    assert rows(extract_incidents(df, plain)) == rows(extract_incidents(df, bare(), dictionary=d))


def test_split_rules(spark, tmp_path):
    rules = [(1, "site:plant", "erth", "Beta"), (0, "site:depot", "ingth", "Alpha"), (2, "site:grid", "adoci", "Beta"), (0, "fire", "blest", ""),
             (0, "facility", "thing", "depot")]
    schema = "prio long, rule_group string, pattern string, label string"
    areas = spark.createDataFrame([("E", "M", 1)], "area string, macro_area string, reach_score int")
    names = spark.createDataFrame([("east", "E", 1)], ALIASES)
    pack, d = split_rules(str(tmp_path / "d"), spark.createDataFrame(rules, schema), names, areas)
    assert pack.groups == {"fire": ["blest"]} and pack.facility == [("thing", "depot")] and not pack.gazetteer and not pack.sites
    df = spark.createDataFrame([("ingth erth east",), ("adoci",), ("nothing",)], "low string").withColumn("_known", known(d, F.col("low")))
    det = Detector(pack, F.col("_known"))
    got = {r["low"]: r for r in df.select("low", det.targets(F.col("low")).alias("t"), det.has_target(F.col("low")).alias("has"), det.in_scope(F.col("low")).alias("in")).collect()}
    assert [tuple(t) for t in got["ingth erth east"]["t"]] == [("Alpha", "depot"), ("Beta", "plant")]
    assert got["adoci"]["t"] == [] and got["adoci"]["has"] and got["nothing"]["has"] and got["nothing"]["t"][0]["type"] == "depot"
    with pytest.raises(ValueError):
        split_rules(str(tmp_path / "e"), spark.createDataFrame([(0, "site:x", "a.b", "L")], schema), names, areas)


def test_empty_dictionary_and_empty_table(spark, tmp_path):
    d = write_dictionary(str(tmp_path / "d"), spark.createDataFrame([], ALIASES))
    df = spark.createDataFrame([("some text",), (None,)], "low string")
    assert [r["n"] for r in df.select(F.size(known(d, F.col("low"))["areas"]).alias("n")).collect()] == [0, 0]
    assert df.limit(0).select(known(d, F.col("low"))).count() == 0


def test_hits_of_a_batch_are_not_all_python_objects_at_once():
    row = [(f"word{i}", (True, 0, "wor", None, True)) for i in range(100)]
    hits = [row[: k % 101] for k in range(20 * PART_ROWS + 7)]
    tracemalloc.start()
    got = _to_arrow(hits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(g["areas"]) for g in got.to_pylist()] == [k % 101 for k in range(len(hits))]
    assert peak < 10_000_000  # all at once: over 20 MB
    assert len(_to_arrow([])) == 0
