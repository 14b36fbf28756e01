import random

from pyspark.sql import functions as F

from sigtide.functions.detect import Detector
from sigtide.operators import segments
from sigtide.operators.extract import extract_incidents
from sigtide.rules import demo_pack
from tests.test_text import DET, PACK

WORDS = ["north", "south", "attack", "depot", "fire", "calm", "also", "shield", "alpha", "beta", "words", "go"]
PACK.groups["transition"] = ["also"]


def messages(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 4))).capitalize() + "." for _ in range(rng.randint(1, 7))))
            for i in range(n)]


def area(s):
    return "N" if "north" in s else "S" if "south" in s else None


def has(s, *words):
    return any(w in s for w in words)


def segment_loop(text):
    sents = [s.strip() for s in text.replace(". ", ".\n").split("\n") if s.strip()]
    if len(sents) <= 1:
        return [text]
    out, cur, last = [], [], None
    for s in sents:
        low = s.lower()
        target = has(low, "depot", "alpha", "beta")
        event = target or has(low, "attack", "fire")
        a = area(low)
        changed = a is not None and last is not None and a != last
        if cur and event and (changed or ("also" in low and target)):
            out.append(cur)
            cur = []
        last = a or last
        cur.append(s)
    out.append(cur)
    texts = [" ".join(c) for c in out]
    good = [t for t in texts if has(t.lower(), "depot", "alpha", "beta") and has(t.lower(), "attack", "fire", "shield")]
    return good or [text]


def test_segments_equal_sequential_loop(spark):
    data = messages(300)
    df = spark.createDataFrame(data, "msg_id long, clean string")
    got = {r["msg_id"]: r["segments"] for r in segments.split_events(df, Detector(PACK)).collect()}
    assert got == {i: segment_loop(t) for i, t in data}


def test_windows_equal_loop(spark):
    data = messages(100, seed=5)
    df = spark.createDataFrame(data, "msg_id long, clean string")
    got = {r["msg_id"]: r["windows"] for r in segments.anchored_windows(df, DET).collect()}
    for i, text in data:
        sents = [s.strip() for s in text.replace(". ", ".\n").split("\n") if s.strip()]
        wins = [" ".join(sents[max(0, k - 1):k + 3]) for k, s in enumerate(sents) if has(s.lower(), "attack", "fire", "depot")]
        want = list({w.lower(): w for w in reversed(wins)}.values())[::-1] if wins else [text]
        assert got[i] == want


def test_two_areas_and_no_target(spark):
    rows = [(1, "Attack on north depot. Attack on south depot. A calm day."), (2, "Attack north. Attack south.")]
    df = spark.createDataFrame(rows, "msg_id long, clean string")
    got = {r["msg_id"]: r["segments"] for r in segments.split_events(df, DET).collect()}
    assert got[1] == ["Attack on north depot.", "Attack on south depot. A calm day."]
    assert got[2] == [rows[1][1]]


def test_dedup_keeps_best_then_first(spark):
    text = "Attack depot north. Calm. Fire depot south. Also depot fire south attack. Also depot attack south fire."
    df = spark.createDataFrame([(1, "c", text)], "msg_id long, channel string, text string").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    rows = extract_incidents(df, PACK).orderBy("seg").collect()
    assert [(r["area"], r["seg"]) for r in rows] == [("N", 0), ("S", 2)]
    assert all(r["combined"] for r in rows)


def test_undated_and_rejected_messages(spark):
    df = spark.createDataFrame([(1, "c", "x !! thing ndst"), (2, "c", "thing ndst"), (3, "c", None), (4, "c", "")],
                               "msg_id long, channel string, text string")
    df = df.withColumn("ts", F.when(F.col("msg_id") < 9, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    assert [r["msg_id"] for r in extract_incidents(df, demo_pack()).collect()] == [2]


def test_very_long_message(spark):
    text = " ".join(["Thing ndst thatin. Erth blest hehely."] * 2000)
    df = spark.createDataFrame([(1, "c", text)], "msg_id long, channel string, text string").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert extract_incidents(df, demo_pack()).count() == 2
