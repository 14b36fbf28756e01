"""Incident store plans: joins, matching, merging, upserts, lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide.functions import text as tx
from sigtide.operators import daily, merge
from sigtide.operators import incidents as inc
from sigtide.plans import oracle as o
from sigtide.plans.common import signals_short
from sigtide.plans.registry import query
from sigtide.session import materialise
from sigtide.sources import testdata as td

_LINKS = "links AS (SELECT DISTINCT l_orderkey AS incident_id, l_partkey AS site_id FROM lineitem)"


def links(spark: SparkSession, sf: str) -> DataFrame:
    return td.incident_sites(spark, sf).distinct()


@query("S3 P1 P2 P3 P6 D6", f"""WITH {o.INC_LONG} SELECT incident_id, date, macro_area, CAST(fire AS INTEGER) AS fire,
  CAST(confirmed AS INTEGER) AS hit, CAST(shutdown AS INTEGER) AS shutdown_flag,
  CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS severity_rank,
  CAST(confirmed OR fire OR severity IN ('high', 'medium') AS INTEGER) AS significant
  FROM inc_long WHERE status = 'active' AND lower(trim(severity)) NOT IN ('unknown', '') AND severity IS NOT NULL""")
def active_incidents(spark, sf):
    from sigtide.functions import scoring
    i = inc.active(td.incidents_long(spark, sf))
    i = i.filter(F.col("severity").isNotNull() & ~F.lower(F.trim("severity")).isin("unknown", ""))
    return i.select(
        "incident_id", "date", "macro_area", F.col("fire").cast("int").alias("fire"), F.col("confirmed").cast("int").alias("hit"),
        F.col("shutdown").cast("int").alias("shutdown_flag"), scoring.severity_rank(F.col("severity")).alias("severity_rank"),
        scoring.significant(F.col("confirmed"), F.col("fire"), F.col("severity")).cast("int").alias("significant"))


@query("S4 J1 A1", f"""WITH {o.INC_LONG}, {_LINKS}, t AS (SELECT incident_id, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS site_type
  FROM links JOIN part ON site_id = p_partkey GROUP BY 1)
SELECT incident_id, date, area, severity, coalesce(site_type, 'unknown') AS site_type FROM inc_long LEFT JOIN t USING (incident_id) WHERE status = 'active'""")
def incidents_with_sites(spark, sf):
    i = inc.active(td.incidents_long(spark, sf)).select("incident_id", "date", "area", "severity")
    return inc.with_site_types(i, td.incident_sites(spark, sf), td.sites(spark, sf))


@query("J2", f"""WITH {o.INC_LONG}, {_LINKS} SELECT date, lower(trim(p_type)) AS site_type, count(*) AS n
FROM inc_long JOIN links USING (incident_id) JOIN part ON site_id = p_partkey WHERE status = 'active' GROUP BY ALL""")
def incident_site_days(spark, sf):
    i = inc.active(td.incidents_long(spark, sf)).select("incident_id", "date")
    joined = daily.typed(inc.link_sites(i, links(spark, sf), td.sites(spark, sf), "inner"))
    return joined.groupBy("date", "site_type").agg(F.count("*").alias("n"))


@query("J3", f"""WITH {o.INC_LONG}, a AS (SELECT incident_id, place_id, date FROM inc_long WHERE status = 'active')
SELECT incident_id, EXISTS (SELECT 1 FROM a b WHERE b.place_id = a.place_id AND b.incident_id <> a.incident_id
  AND b.date BETWEEN a.date - 30 AND a.date - 1) AS repeated FROM a""")
def repeated_incidents(spark, sf):
    i = td.incidents_long(spark, sf).select("incident_id", "place_id", "date", "status")
    return inc.with_repeat_flag(i, "place_id").select("incident_id", "repeated")


@query("J3", f"""WITH {o.INC_SHORT}, a AS (SELECT DISTINCT area, date FROM inc_short WHERE status = 'active')
SELECT area, date, EXISTS (SELECT 1 FROM a b WHERE b.area = a.area AND b.date BETWEEN a.date - 30 AND a.date - 1) AS repeated FROM a""")
def repeated_area_days(spark, sf):
    return inc.repeat_days(td.incidents_short(spark, sf))


# ── matching: existing = even keys, candidates = odd keys, by customer ────────

_MATCH = f"""{o.INC_LONG}, {_LINKS}, t AS (SELECT incident_id, list(DISTINCT p_type ORDER BY p_type) AS types FROM links JOIN part ON site_id = p_partkey GROUP BY 1),
typed AS (SELECT incident_id, place_id % 50 AS pid, date, status, created_at, severity, confirmed, fire, shutdown, defended, combined, explosions,
  CASE WHEN incident_id % 10 = 3 OR incident_id % 10 = 4 THEN ['unknown'] ELSE coalesce(types, ['unknown']) END AS site_types
  FROM inc_long LEFT JOIN t USING (incident_id)),
existing AS (SELECT * FROM typed WHERE incident_id % 2 = 0 AND status = 'active'),
cands AS (SELECT * FROM typed WHERE incident_id % 2 = 1)"""

_MATCHED = f"""{_MATCH}, pairs AS (SELECT c.incident_id AS cand_id, e.incident_id AS match_id, e.date AS ed, e.created_at AS eu,
  CASE WHEN list_has_any(e.site_types, c.site_types) THEN 0 WHEN e.site_types = ['unknown'] OR c.site_types = ['unknown'] THEN 1 END AS match_class
  FROM cands c JOIN existing e ON e.pid = c.pid AND e.date BETWEEN c.date - 2 AND c.date),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY match_class, ed DESC, eu DESC, match_id DESC) AS rn FROM pairs WHERE match_class IS NOT NULL)"""


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    i = inc.with_site_types(td.incidents_long(spark, sf), td.incident_sites(spark, sf), td.sites(spark, sf))
    untyped = (F.col("incident_id") % 10).isin(3, 4)
    types = F.when(untyped, F.array(F.lit("unknown"))).otherwise(tx.split_pipe(F.col("site_type")))
    return i.select("incident_id", (F.col("place_id") % 50).cast("string").alias("area"), "date", "status", types.alias("site_types"),
                    F.col("created_at").alias("updated_at"), "severity", "confirmed", "fire", "shutdown", "defended", "combined", "explosions")


def _existing(t: DataFrame) -> DataFrame:
    return t.filter(F.col("incident_id") % 2 == 0)


def _candidates(t: DataFrame) -> DataFrame:
    return (t.filter(F.col("incident_id") % 2 == 1)
            .withColumnRenamed("incident_id", "cand_id").withColumnRenamed("date", "incident_date"))


@query("J5", f"""WITH {_MATCHED} SELECT c.incident_id AS cand_id, r.match_id, CAST(r.match_class AS INTEGER) AS match_class
FROM cands c LEFT JOIN ranked r ON r.cand_id = c.incident_id AND rn = 1""")
def matched_incidents(spark, sf):
    t = _typed(spark, sf)
    c = _candidates(t).select("cand_id", "area", "incident_date", "site_types")
    return inc.match_candidates(c, _existing(t)).select("cand_id", "match_id", "match_class")


def _merged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = _typed(spark, sf).withColumn("report_type", F.when(F.col("explosions") == 3, "official").otherwise("hearsay"))
    t = t.withColumn("scale", F.when(F.col("incident_id") % 5 == 0, "few").when(F.col("incident_id") % 5 == 1, "swarm"))
    c = _candidates(t)
    m = inc.match_candidates(c, _existing(t)).filter(F.col("match_id").isNotNull())
    m = m.withColumn("ts", F.col("updated_at")).withColumn("seg", F.lit(0))
    folded = merge.fold_candidates(m, "match_id", ["ts", "cand_id"]).withColumnRenamed("match_id", "incident_id")
    ex = inc.active(_existing(t)).withColumn("confidence", merge.candidate_confidence())
    return ex, merge.merge_into(ex, folded)


_CONF = o.confidence_sql("CASE WHEN explosions = 3 THEN 'official' ELSE 'hearsay' END", "confirmed", "fire", "shutdown", "explosions", "severity")
_FOLD = f"""{_MATCHED},
hits AS (SELECT r.match_id, c.*, {_CONF} AS conf, CASE c.incident_id % 5 WHEN 0 THEN 'few' WHEN 1 THEN 'swarm' END AS scale
         FROM ranked r JOIN cands c ON c.incident_id = r.cand_id WHERE rn = 1),
flat AS (SELECT match_id, bool_or(combined) AS combined, bool_or(defended) AS defended, bool_or(fire) AS fire, bool_or(shutdown) AS shutdown,
  bool_or(confirmed) AS confirmed, max(explosions) AS explosions, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS sev,
  max(conf) AS conf, first(scale ORDER BY created_at, incident_id) FILTER (scale IS NOT NULL) AS scale,
  flatten(list(site_types ORDER BY created_at, incident_id)) AS types FROM hits GROUP BY 1),
old AS (SELECT *, {_CONF} AS confidence, CASE incident_id % 5 WHEN 0 THEN 'few' WHEN 1 THEN 'swarm' END AS scale FROM existing),
joint AS (SELECT e.incident_id, e.pid, list_filter(list_concat(e.site_types, f.types), lambda t: t NOT IN ('unknown', 'other')) AS cat,
  e.site_types AS old_types, f.types AS new_types, e.combined AS o_combined, e.combined OR f.combined AS combined, e.defended AS o_defended,
  e.defended OR f.defended AS defended, e.fire AS o_fire, e.fire OR f.fire AS fire, e.shutdown AS o_shutdown, e.shutdown OR f.shutdown AS shutdown,
  e.confirmed AS o_confirmed, e.confirmed OR f.confirmed AS confirmed, e.explosions AS o_explosions, greatest(e.explosions, f.explosions) AS explosions,
  e.severity AS o_severity, CASE WHEN f.sev > CASE e.severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END
    THEN CASE f.sev WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END ELSE e.severity END AS severity,
  e.confidence AS o_confidence, greatest(e.confidence, f.conf) AS confidence, e.scale AS o_scale, coalesce(e.scale, f.scale) AS scale
  FROM old e JOIN flat f ON f.match_id = e.incident_id),
done AS (SELECT *, CASE WHEN len(cat) > 0 THEN list_filter(cat, lambda t, i: list_position(cat, t) = i) ELSE old_types END AS types FROM joint)"""


@query("M3", f"""WITH {_FOLD} SELECT incident_id, array_to_string(types, ' | ') AS site_type, combined, defended, fire, shutdown, confirmed,
  CAST(explosions AS INTEGER) AS explosions, severity, CAST(confidence AS INTEGER) AS confidence, scale FROM done""")
def merged_records(spark, sf):
    _, m = _merged(spark, sf)
    return m.select("incident_id", tx.join_pipe(F.col("site_types")).alias("site_type"), *merge.FLAGS, "explosions", "severity", "confidence", "scale")


def _diff(field: str, old: str, new: str) -> str:
    return f"SELECT incident_id, '{field}' AS field, CAST({old} AS VARCHAR) AS old_value, CAST({new} AS VARCHAR) AS new_value FROM done WHERE {old} IS DISTINCT FROM {new}"


_DIFFS = " UNION ALL ".join(
    [_diff(f, f"o_{f}", f) for f in ("combined", "defended", "fire", "shutdown", "confirmed", "explosions", "severity", "confidence", "scale")]
    + [_diff("site_types", "array_to_string(list_sort(old_types), ' | ')", "array_to_string(list_sort(types), ' | ')")])


@query("M4 M5", f"WITH {_FOLD} {_DIFFS}")
def audit_rows(spark, sf):
    _, m = _merged(spark, sf)
    return merge.audit_rows(m)


@query("M5 M2", f"""WITH {_FOLD}, changed AS (SELECT DISTINCT incident_id FROM ({_DIFFS}))
SELECT e.incident_id, CASE WHEN c.incident_id IS NULL THEN e.severity ELSE d.severity END AS severity,
  CAST(CASE WHEN c.incident_id IS NULL THEN e.confidence ELSE d.confidence END AS INTEGER) AS confidence,
  CASE WHEN c.incident_id IS NULL THEN CAST(e.created_at AS DATE) ELSE DATE '2030-01-01' END AS updated_date
FROM old e LEFT JOIN done d USING (incident_id) LEFT JOIN changed c USING (incident_id)""")
def updated_store(spark, sf):
    ex, m = _merged(spark, sf)
    out = merge.apply_updates(ex, m, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("incident_id", "severity", "confidence", F.to_date("updated_at").alias("updated_date"))


@query("M1", f"""WITH {o.SIG_SHORT}, old AS (SELECT * FROM sig_short WHERE date <= DATE '2024-01-20'),
new AS (SELECT date, channel, s_mention + 1 AS s_mention, s_broad, msg_count FROM sig_short WHERE date >= DATE '2024-01-15')
SELECT * FROM new UNION ALL SELECT date, channel, s_mention, s_broad, msg_count FROM old WHERE (date, channel) NOT IN (SELECT (date, channel) FROM new)""")
def upserted_signals(spark, sf):
    s = signals_short(spark, sf).select("date", "channel", "s_mention", "s_broad", "msg_count")
    old = s.filter(F.col("date") <= dt.date(2024, 1, 20))
    new = s.filter(F.col("date") >= dt.date(2024, 1, 15)).withColumn("s_mention", F.col("s_mention") + 1)
    return merge.upsert(old, new, ["date", "channel"])


@query("M2", f"""WITH old AS (SELECT DISTINCT l_orderkey AS incident_id, l_partkey AS site_id FROM lineitem WHERE l_linenumber <= 2),
new AS (SELECT DISTINCT l_orderkey AS incident_id, l_partkey AS site_id FROM lineitem WHERE l_linenumber > 1)
SELECT incident_id, site_id, 'old' AS origin FROM old UNION ALL SELECT incident_id, site_id, 'new' FROM new
WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.incident_id = new.incident_id AND old.site_id = new.site_id)""")
def inserted_links(spark, sf):
    li = td.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("incident_id"), F.col("l_partkey").alias("site_id"), "l_linenumber")
    old = li.filter(F.col("l_linenumber") <= 2).select("incident_id", "site_id").distinct().withColumn("origin", F.lit("old"))
    new = li.filter(F.col("l_linenumber") > 1).select("incident_id", "site_id").withColumn("origin", F.lit("new"))
    return inc.insert_links(old, new)


@query("J9", """WITH old AS (SELECT DISTINCT p_type AS site_type, p_brand AS area FROM part WHERE p_size <= 20),
wanted AS (SELECT DISTINCT lower(p_type) AS t, lower(p_brand) AS a FROM part),
new AS (SELECT w.* FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM old WHERE lower(old.site_type) = w.t AND lower(old.area) = w.a))
SELECT site_type, area, NULL::BOOLEAN AS is_canonical FROM old UNION ALL SELECT t, a, true FROM new""")
def site_dimension(spark, sf):
    p = td.table(spark, sf, "part")
    old = p.filter(F.col("p_size") <= 20).select(F.col("p_type").alias("site_type"), F.col("p_brand").alias("area")).distinct()
    wanted = p.select(F.lower("p_type").alias("site_type"), F.lower("p_brand").alias("area"))
    return inc.get_or_create_sites(old, wanted).select("site_type", "area", "is_canonical")


@query("O1", f"""WITH {o.INC_LONG} SELECT incident_id, date, area, severity FROM inc_long WHERE status = 'active' AND date <= DATE '1999-06-30'
ORDER BY date DESC NULLS LAST, created_at DESC, incident_id DESC LIMIT 25""")
def recent_incidents(spark, sf):
    return inc.recent(td.incidents_long(spark, sf), 25, dt.date(1999, 6, 30)).select("incident_id", "date", "area", "severity")


@query("O2", f"""WITH {o.INC_LONG}, {_LINKS} SELECT i.incident_id, i.date, i.area, (SELECT string_agg(DISTINCT p_type, ' | ' ORDER BY p_type)
  FROM links l JOIN part ON l.site_id = p_partkey WHERE l.incident_id = i.incident_id) AS site_type FROM inc_long i WHERE i.incident_id = 77""")
def incident_by_id(spark, sf):
    one = inc.by_id(td.incidents_long(spark, sf), 77).select("incident_id", "date", "area")
    return inc.with_site_types(one, td.incident_sites(spark, sf).filter(F.col("incident_id") == 77), td.sites(spark, sf))


@query("M7", f"""WITH {o.INC_LONG}, edits AS (SELECT o_orderkey AS incident_id, CASE WHEN o_orderkey % 3 = 0 THEN 'high' END AS e_sev, o_orderkey % 5 = 0 AS skip
  FROM orders WHERE o_totalprice > 200000)
SELECT incident_id, coalesce(e_sev, severity) AS severity, area FROM inc_long LEFT JOIN edits USING (incident_id) WHERE NOT coalesce(skip, false)""")
def corrected_incidents(spark, sf):
    parsed = td.incidents_long(spark, sf).select("incident_id", "severity", "area")
    k = F.col("o_orderkey")
    edits = td.table(spark, sf, "orders").filter(F.col("o_totalprice") > 200000).select(
        k.alias("incident_id"), F.when(k % 3 == 0, "high").alias("severity"), (k % 5 == 0).alias("skip"))
    return merge.apply_corrections(parsed, edits, ["incident_id"])


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    t = inc.active(_typed(spark, sf))
    return t.select(F.col("incident_id").alias("cand_id"), "area", F.col("date").alias("incident_date"), "site_types",
                    F.col("updated_at").alias("ts"), F.lit(0).alias("seg"), "severity", "confirmed", "fire", "shutdown", "defended",
                    "combined", "explosions", F.lit("hearsay").alias("report_type"), F.lit(None).cast("string").alias("scale"))


@query("M6")
def arrival_merge(spark, sf):
    """Insert-or-update in arrival order, then the merged record of each incident."""
    c = _arrivals(spark, sf)
    placed = c.join(merge.assign_incidents(c), "cand_id")
    return merge.fold_candidates(placed, "incident_id", ["ts", "seg", "cand_id"]).select(
        "incident_id", "n_area", tx.join_pipe(F.col("n_site_types")).alias("site_type"), "n_explosions", "n_severity", "n_confidence", "n_merged")


@query("M6 M5")
def arrival_audit(spark, sf):
    c = _arrivals(spark, sf).withColumn("confidence", merge.candidate_confidence())
    return merge.running_audit(materialise(c.join(merge.assign_incidents(c), "cand_id"), "placed"))


@query("A5", f"""WITH {o.INC_LONG} SELECT area, max({o.REACH_LONG}) AS reach, count(*) AS n FROM inc_long
WHERE status = 'active' AND date BETWEEN DATE '2001-06-01' - 30 AND DATE '2001-06-01' GROUP BY area""")
def recent_reach(spark, sf):
    return daily.recent_reach(td.incidents_long(spark, sf), td.reach_long(spark, sf), ["area"], dt.date(2001, 6, 1), 30)


@query("P4 J6", f"WITH {o.INC_LONG} SELECT incident_id, {o.REACH_LONG} AS reach_score FROM inc_long")
def incident_reach(spark, sf):
    from sigtide.operators.areas import with_reach
    return with_reach(td.incidents_long(spark, sf), td.reach_long(spark, sf)).select("incident_id", "reach_score")
