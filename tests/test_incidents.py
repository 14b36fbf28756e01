import datetime as dt
import random

from pyspark.sql import functions as F

from sigtide.operators import incidents as inc
from sigtide.operators import merge
from sigtide.operators.matching import OpenIncidents

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def test_repeat_flag_golden(spark):
    rows = [(1, "a", day(0), "active"), (2, "a", day(1), "active"), (3, "a", day(31), "active"), (4, "a", day(62), "active"), (5, "a", day(61), "merged")]
    df = spark.createDataFrame(rows, "incident_id long, area string, date date, status string")
    got = {r["incident_id"]: r["repeated"] for r in inc.with_repeat_flag(df).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_repeat_flag_with_hot_area(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"a{i % 7}", day(rng.randint(0, 200)), rng.choice(["active", "active", "merged"])) for i in range(600)]
    df = spark.createDataFrame(rows, "incident_id long, area string, date date, status string")
    got = {r["incident_id"]: r["repeated"] for r in inc.with_repeat_flag(df).collect()}
    act = [r for r in rows if r[3] == "active"]
    assert got == {i: any(b[1] == a and 1 <= (d - b[2]).days <= 30 for b in act) for i, a, d, _ in act}


def _records(seed, n, types):
    rng = random.Random(seed)
    return [(i, rng.choice(["x", "y"]), day(rng.randint(0, 12)), rng.choice(types), dt.datetime(2024, 2, 1) + dt.timedelta(minutes=rng.randint(0, 20)))
            for i in range(n)]


def unknown(ts):
    s = " | ".join(ts).lower()
    return s in ("", "unknown") or s.startswith("unknown ")


def test_match_equals_brute_force(spark):
    types = [["a"], ["b"], ["a", "c"], ["unknown"], [], ["Unknown area 1"], ["B", "d"]]
    old = _records(1, 60, types)
    new = _records(2, 80, types)
    e = spark.createDataFrame(old, "incident_id long, area string, date date, site_types array<string>, updated_at timestamp_ntz").withColumn("status", F.lit("active"))
    c = spark.createDataFrame([r[:4] for r in new], "cand_id long, area string, incident_date date, site_types array<string>")
    got = {r["cand_id"]: (r["match_id"], r["match_class"]) for r in inc.match_candidates(c, e).collect()}
    assert len(got) == len(new)
    for i, a, d, ts, _ in new:
        near = sorted((r for r in old if r[1] == a and 0 <= (d - r[2]).days <= 2), key=lambda r: (r[2], r[4], r[0]), reverse=True)
        low = {t.lower() for t in ts}
        hit = next(((r[0], 0) for r in near if low & {t.lower() for t in r[3]}), None)
        hit = hit or next(((r[0], 1) for r in near if unknown(ts) or unknown(r[3])), (None, None))
        assert got[i] == hit


def test_get_or_create_is_case_folded(spark):
    old = spark.createDataFrame([(1, "Depot", "North", True)], "site_id long, site_type string, area string, is_canonical boolean")
    want = spark.createDataFrame([("depot", "NORTH"), ("plant", None), ("Plant", ""), ("hub", "Unknown Area")], "site_type string, area string")
    rows = inc.get_or_create_sites(old, want).collect()
    assert sorted(r["site_type"].lower() for r in rows) == ["depot", "hub", "plant"]
    assert {r["site_type"].lower(): r["is_canonical"] for r in rows} == {"depot": True, "plant": False, "hub": False}


CAND = ("cand_id long, area string, incident_date date, site_types array<string>, ts timestamp_ntz, seg int, severity string, confirmed boolean, "
        "fire boolean, shutdown boolean, defended boolean, combined boolean, explosions int, report_type string, scale string")


def candidates(seed, n, span=20):
    rng = random.Random(seed)
    flag = lambda: rng.random() < 0.4
    out = []
    for i in range(n):
        types = rng.choice([["a"], ["b"], ["a", "b"], ["c"], ["unknown"], ["c", "d"]])
        out.append((i, "hot" if rng.random() < 0.6 else rng.choice("pq"), day(rng.choice([rng.randint(0, span), rng.randint(0, span) * 3])), types,
                    dt.datetime(2024, 3, 1) + dt.timedelta(minutes=rng.randint(0, 40)), rng.randint(0, 2), rng.choice(["low", "medium", "high"]),
                    flag(), flag(), flag(), flag(), flag(), rng.randint(0, 5), rng.choice(["official", "hearsay", "correction"]),
                    rng.choice([None, "few", "swarm"])))
    return out


def conf(r):
    s = 50 + {"official": 25, "hearsay": -5, "correction": 5}[r[13]] + 8 * r[7] + 5 * r[8] + 8 * r[9] + min(2 * r[12], 8)
    return max(5, min(95, s + {"high": 8, "medium": 4, "low": 0}[r[6]]))


def replay(rows):
    """Every candidate against the whole store, one by one, in arrival order."""
    store, where, clock = [], {}, 0
    for r in sorted(rows, key=lambda r: (r[4], r[5], r[0])):
        clock += 1
        near = sorted((s for s in store if s["area"] == r[1] and 0 <= (r[2] - s["date"]).days <= 2), key=lambda s: (s["date"], s["clock"]), reverse=True)
        hit = next((s for s in near if set(s["types"]) & set(r[3])), None) or next((s for s in near if unknown(s["types"]) or unknown(r[3])), None)
        if hit is None:
            hit = {"id": r[0], "area": r[1], "date": r[2], "types": list(r[3]), "clock": clock, "conf": conf(r), "exp": r[12], "sev": r[6], "fire": r[8],
                   "scale": r[14], "n": 1}
            store.append(hit)
        else:
            union = [t for t in dict.fromkeys(hit["types"] + r[3]) if t not in ("unknown", "other")]
            rank = {"low": 1, "medium": 2, "high": 3}
            hit.update(types=union or hit["types"], clock=clock, conf=max(hit["conf"], conf(r)), exp=max(hit["exp"], r[12]),
                       sev=max(hit["sev"], r[6], key=rank.get), fire=hit["fire"] or r[8], scale=hit["scale"] or r[14], n=hit["n"] + 1)
        where[r[0]] = hit["id"]
    return where, {s["id"]: s for s in store}


def test_arrival_order_merge_equals_replay(spark):
    rows = candidates(4, 400)
    df = spark.createDataFrame(rows, CAND)
    where, store = replay(rows)
    placed = df.join(merge.assign_incidents(df), "cand_id")
    assert {r["cand_id"]: r["incident_id"] for r in placed.collect()} == where
    folded = {r["incident_id"]: r for r in merge.fold_candidates(placed, "incident_id", ["ts", "seg", "cand_id"]).collect()}
    assert set(folded) == set(store)
    for i, s in store.items():
        f = folded[i]
        assert (f["n_site_types"], f["n_confidence"], f["n_explosions"], f["n_severity"], f["n_fire"], f["n_scale"], f["n_merged"]) == (
            s["types"], s["conf"], s["exp"], s["sev"], s["fire"], s["scale"], s["n"])


def test_hot_day_keeps_one_incident_per_type():
    """Matching with bounded state equals a search of all incidents, over soft, mixed-case and empty types."""
    from sigtide.operators.matching import SOFT, OpenIncidents, _unknown
    rng = random.Random(3)
    for _ in range(60):
        store, every, clock = OpenIncidents(2), [], 0
        for i in range(300):
            d = rng.randint(0, 6)
            types = rng.choice([["a"], ["B"], ["b", "c"], ["unknown"], ["other"], ["unknown", "a"], ["a", "unknown"], [], ["c", "other"], ["d", "A"]])
            clock += 1
            near = sorted((r for r in every if 0 <= d - r["day"] <= 2), key=lambda r: (r["day"], r["updated"]), reverse=True)
            hit = next((r for r in near if {t.lower() for t in types} & {t.lower() for t in r["types"]}), None) or next((r for r in near if _unknown(types) or _unknown(r["types"])), None)
            if hit is None:
                hit = {"id": i, "day": d, "types": list(types), "updated": clock}
                every.append(hit)
            else:
                union = [t for t in dict.fromkeys([*hit["types"], *types]) if t not in SOFT]
                hit.update(types=union or hit["types"] or types or ["other"], updated=clock)
            assert store.place(i, d, list(types)) == (hit["id"], hit["id"] == i)
            if i % 50 == 49:   # as a stream does between batches
                store = OpenIncidents(2, [dict(r) for r in store.rows()], store.clock)
        assert len(store.rows()) <= 7 * 12


def test_running_audit_counts_changes(spark):
    rows = candidates(9, 150)
    df = spark.createDataFrame(rows, CAND)
    placed = df.join(merge.assign_incidents(df), "cand_id").withColumn("confidence", merge.candidate_confidence())
    got = {(r["cand_id"], r["field"]): (r["old_value"], r["new_value"]) for r in merge.running_audit(placed).collect()}
    where, _ = replay(rows)
    state, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[4], r[5], r[0])):
        new = {"explosions": r[12], "confidence": conf(r), "confirmed": r[7], "fire": r[8], "shutdown": r[9], "defended": r[10], "combined": r[11],
               "severity": r[6], "scale": r[14], "site_types": r[3]}
        if where[r[0]] in state:
            held = state[where[r[0]]]
            for f, v in new.items():
                old = held[f]
                if f == "severity":
                    after = max(old, v, key=["low", "medium", "high"].index)
                elif f == "scale":
                    after = old or v
                elif f == "site_types":
                    after = [t for t in dict.fromkeys(old + v) if t not in ("unknown", "other")] or old
                else:
                    after = max(old, v)
                show = lambda x: x if x is None or isinstance(x, str) else " | ".join(sorted(x)) if isinstance(x, list) else str(x).lower()
                if show(old) != show(after):
                    want[r[0], f] = (show(old), show(after))
                held[f] = after
        else:
            state[where[r[0]]] = new
    assert got == want


def test_merge_with_itself_has_no_diffs(spark):
    rows = [r for r in candidates(5, 40) if r[3] != ["unknown"]]
    df = spark.createDataFrame(rows, CAND).withColumnRenamed("cand_id", "incident_id").withColumn("confidence", merge.candidate_confidence())
    folded = merge.fold_candidates(df, "incident_id", ["ts", "seg"])
    assert merge.audit_rows(merge.merge_into(df, folded)).count() == 0


def test_unknown_area_is_filled_and_lone_soft_type_kept(spark):
    base = candidates(5, 1)[0]
    old = spark.createDataFrame([(1, "Unknown Area", base[2], ["unknown"], *base[4:])], CAND).withColumnRenamed("cand_id", "incident_id").withColumn("confidence", F.lit(50))
    new = spark.createDataFrame([(1, "North", base[2], ["unknown"], *base[4:])], CAND).withColumnRenamed("cand_id", "incident_id")
    r = merge.merge_into(old, merge.fold_candidates(new, "incident_id", ["ts", "seg"])).first()
    assert (r["area"], r["site_types"]) == ("North", ["unknown"])


def test_upsert_and_corrections(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(2, 20), (3, 30)], "k int, v int")
    assert sorted(map(tuple, merge.upsert(a, b, ["k"]).collect())) == [(1, 1), (2, 20), (3, 30)]
    edits = spark.createDataFrame([(1, None, True), (2, 5, None)], "k int, v int, skip boolean")
    assert [tuple(r) for r in merge.apply_corrections(a, edits, ["k"]).collect()] == [(2, 5)]


def test_links_ignore_conflicts(spark):
    old = spark.createDataFrame([(1, 1, "old")], "incident_id int, site_id int, o string")
    new = spark.createDataFrame([(1, 1, "new"), (1, 2, "new"), (1, 2, "new")], "incident_id int, site_id int, o string")
    assert sorted(map(tuple, inc.insert_links(old, new).collect())) == [(1, 1, "old"), (1, 2, "new")]


def test_open_incidents_expire():
    s = OpenIncidents(2)
    s.place(1, 10, ["a"])
    s.place(2, 13, ["a"])
    s.expire(13)
    assert [r["id"] for r in s.rows()] == [2]


def test_running_aggregates_over_blocks(spark):
    from sigtide.operators.prefix import running_before
    rng = random.Random(2)
    rows = [("hot" if i % 3 else "cold", i, rng.randint(-5, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running_before(df, ["k"], F.floor(F.col("i") / 17), ["i"], {"s": (F.sum, F.col("v")), "m": (F.max, F.col("v"))}).collect()
    for r in got:
        before = [v for k, i, v in rows if k == r["k"] and i < r["i"]]
        assert (r["s"], r["m"]) == ((sum(before), max(before)) if before else (None, None))
