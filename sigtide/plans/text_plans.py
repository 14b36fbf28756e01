"""Text functions and detectors over whole documents."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import dates
from sigtide.functions import text as tx
from sigtide.functions.detect import Detector
from sigtide.operators import segments
from sigtide.operators.areas import area_table, with_macro_area
from sigtide.operators.extract import count_signals, extract_incidents, prepare
from sigtide.operators.gazetteer import known, write_dictionary
from sigtide.operators.prefix import running_before
from sigtide.plans import oracle as o
from sigtide.plans.common import PACK
from sigtide.plans.registry import query
from sigtide.session import spread, work_dir
from sigtide.sources import messages as src
from sigtide.sources import testdata as td

DET = Detector(PACK)
LOW = F.col


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spread(td.messages(spark, sf)))


@query("S1 S2 D1 D3", f"""WITH {o.MESSAGES}
SELECT msg_id, channel, CAST(ts + INTERVAL 3 HOUR AS DATE) AS local_date FROM messages
WHERE ts >= TIMESTAMP '2024-01-04 21:00:00' AND ts < TIMESTAMP '2024-01-14 21:00:00'""")
def messages_local_range(spark, sf):
    kept = src.local_days(td.messages(spark, sf), dt.date(2024, 1, 5), dt.date(2024, 1, 14))
    return kept.select("msg_id", "channel", dates.local_date(F.col("ts")).alias("local_date"))


@query("T1", f"SELECT doc_id, {o.clean_sql('text')} AS clean FROM documents")
def text_clean(spark, sf):
    return spread(td.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query("T2", f"SELECT doc_id, lower({o.clean_sql('text')}) AS low FROM documents")
def text_lower(spark, sf):
    return spread(td.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tx.lower_text(F.col("text")).alias("low"))


@query("T3", f"""SELECT doc_id, CASE WHEN length(c) > 4000 THEN substr(c, 1, 4000) || '...' ELSE c END AS snippet
FROM (SELECT doc_id, {o.clean_sql('text')} AS c FROM documents)""")
def text_snippet(spark, sf):
    return td.table(spark, sf, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("T4", f"""WITH s AS (SELECT doc_id, {o.sentences_sql(o.clean_sql('text'))} AS ss FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)""")
def text_sentences(spark, sf):
    d = spread(td.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence"))


_FLAGS = ["primary", "context", "fire", "defence", "shutdown", "update_only", "direct_hit", "correction", "official"]


@query("T5 X4 X1 X2 X3 X11 X15", f"""WITH {o.PREPARED}
SELECT msg_id, {', '.join(f"{o.has('low', g)} AS {g}" for g in _FLAGS)},
  {o.has('low', 'fundraising', 'subscription', 'editorial', 'summary')} AS fast_reject,
  {o.has('low', 'editorial', 'summary', 'outbound')} AS skip_segment, {o.scope_sql('low')} AS in_scope,
  {o.followup_sql('low')} AS followup_only, {o.candidate_sql('low')} AS candidate FROM prepared""")
def detector_flags(spark, sf):
    low = F.col("low")
    return prepared(spark, sf).select(
        "msg_id", *[DET.has(low, g).alias(g) for g in _FLAGS], DET.fast_reject(low).alias("fast_reject"),
        DET.skip_segment(low).alias("skip_segment"), DET.in_scope(low).alias("in_scope"),
        DET.followup_only(low).alias("followup_only"), DET.candidate(low).alias("candidate"))


@query("T6 T7 X5", f"""WITH {o.PREPARED} SELECT msg_id, CAST({o.count_sql('low', 'explosion')} AS BIGINT) AS n_matches,
  {o.number_sql("regexp_extract(low, '[+]([0-9]+)', 1)")} AS first_number, CAST({o.explosions_sql('low')} AS BIGINT) AS explosions FROM prepared""")
def explosion_counts(spark, sf):
    low = F.col("low")
    return prepared(spark, sf).select(
        "msg_id", tx.count_matches(low, PACK.group("explosion")).cast("bigint").alias("n_matches"),
        tx.capture_number(low, "[+]([0-9]+)").alias("first_number"), DET.explosions(low).alias("explosions"))


@query("T8 X10", f"""WITH {o.PREPARED} SELECT msg_id, CAST(len({o.numbers_sql('low')}) AS INTEGER) AS n_numbers,
  list_max({o.numbers_sql('low')}) AS top_number, {o.scale_sql('low')} AS scale FROM prepared""")
def scale_buckets(spark, sf):
    low = F.col("low")
    nums = DET.numbers(low)
    return prepared(spark, sf).select("msg_id", F.size(nums).alias("n_numbers"), F.array_max(nums).alias("top_number"),
                                      DET.scale(low).alias("scale"))


@query("T9 X19 X25 J6", f"""WITH {o.PREPARED}, a AS (SELECT msg_id, {o.area_sql('low')} AS named FROM prepared)
SELECT msg_id, coalesce(named, 'Unknown Area') AS area, {o.macro_sql('named')} AS macro_area FROM a""")
def message_areas(spark, sf):
    named = prepared(spark, sf).select("msg_id", F.coalesce(DET.area(F.col("low")), F.lit(K.UNKNOWN_AREA)).alias("area"))
    return with_macro_area(named, area_table(spark, PACK)).select("msg_id", "area", "macro_area")


_SOFT = "('unknown', 'other', '')"
_TYPES = """types AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT p_type)) AS ts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
pairs AS (SELECT a.k, CASE WHEN a.k % 7 = 0 THEN ['unknown'] ELSE a.ts END AS x, CASE WHEN b.k % 11 = 0 THEN ['other'] ELSE b.ts END AS y
          FROM types a JOIN types b ON b.k = a.k + 1)"""


@query("T10 T11 T12 X14", f"""WITH {_TYPES}, u AS (SELECT *, list_filter(list_concat(x, y), lambda t: t NOT IN {_SOFT}) AS joint FROM pairs)
SELECT k, array_to_string(x, ' | ') AS old_types, array_to_string(CASE WHEN len(joint) = 0 THEN x ELSE
  list_filter(joint, lambda t, i: list_position(joint, t) = i) END, ' | ') AS merged,
  len(list_intersect(x, y)) > 0 AS overlap, x = ['unknown'] AS old_unknown,
  x IN (['unknown'], ['other']) OR y IN (['unknown'], ['other']) OR len(list_intersect(x, y)) > 0 AS compatible FROM u""")
def type_strings(spark, sf):
    from sigtide.operators.incidents import site_type_lists
    lists = site_type_lists(td.incident_sites(spark, sf), td.sites(spark, sf)).select(F.col("incident_id").alias("k"), "site_type")
    old = lists.select("k", F.when(F.col("k") % 7 == 0, "unknown").otherwise(F.col("site_type")).alias("_x"))
    new = lists.select((F.col("k") - 1).alias("k"), F.when(F.col("k") % 11 == 0, "other").otherwise(F.col("site_type")).alias("_y"))
    p = old.join(new, "k").select("k", tx.split_pipe(F.col("_x")).alias("x"), tx.split_pipe(F.col("_y")).alias("y"))
    x, y = F.col("x"), F.col("y")
    return p.select("k", tx.join_pipe(x).alias("old_types"), tx.join_pipe(tx.merge_type_arrays(x, y)).alias("merged"),
                    tx.types_overlap(x, y).alias("overlap"), tx.types_unknown(x).alias("old_unknown"),
                    tx.types_compatible(x, y).alias("compatible"))


@query("T13", """SELECT p_partkey, 'type_' || regexp_replace(lower(trim(p_name || '/' || p_type)), '[ /]', '_', 'g') AS column_name FROM part""")
def pivot_names(spark, sf):
    p = td.table(spark, sf, "part")
    return p.select("p_partkey", tx.column_name_of(F.concat("p_name", F.lit("/"), "p_type")).alias("column_name"))


_NAME_BASES = [*K.SIGNALS_EXT, "other_thing"]
_NAME_PARTS = [*K.SUFFIX_LABELS, "odd"]


def _name_sql() -> str:
    def lst(v): return "[" + ", ".join(o.q(s) for s in v) + "]"
    labels = " ".join(f"WHEN b = {o.q(k)} THEN {o.q(v)}" for k, v in K.SIGNAL_LABELS.items())
    parts = " ".join(f"WHEN s = {o.q(k)} THEN {o.q(v)}" for k, v in K.SUFFIX_LABELS.items())
    exact = " ".join(f"WHEN f = {o.q(k)} THEN {o.q(v)}" for k, v in K.EXACT_LABELS.items())
    return f"""WITH n AS (SELECT p_partkey, {lst(_NAME_BASES)}[CAST(p_partkey % {len(_NAME_BASES)} AS INTEGER) + 1] AS b,
  {lst(_NAME_PARTS)}[CAST(p_partkey % {len(_NAME_PARTS)} AS INTEGER) + 1] AS s FROM part),
m AS (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 'sin_month' ELSE b || '_' || s END AS f FROM n)
SELECT p_partkey, f AS feature, CASE {exact} WHEN b = 'other_thing' THEN upper(substr(replace(f, '_', ' '), 1, 1)) || substr(lower(replace(f, '_', ' ')), 2)
  ELSE (CASE {labels} END) || ' (' || (CASE {parts} ELSE s END) || ')' END AS readable FROM m"""


@query("T14", _name_sql())
def feature_labels(spark, sf):
    from sigtide.operators.summary import readable
    k = F.col("p_partkey")
    def pick(v): return F.get(F.array(*[F.lit(s) for s in v]), (k % len(v)).cast("int"))
    f = F.when(k % 13 == 0, "sin_month").otherwise(F.concat(pick(_NAME_BASES), F.lit("_"), pick(_NAME_PARTS)))
    return td.table(spark, sf, "part").select("p_partkey", f.alias("feature")).withColumn("readable", readable(F.col("feature")))


@query("X6 X7 X8 X9 X12 X13 X20 X27", f"""WITH {o.PREPARED}, t AS (SELECT msg_id, low,
  CASE WHEN {o.has('low', 'drone')} AND {o.has('low', 'missile')} THEN 'both' WHEN {o.has('low', 'missile')} THEN 'missile'
       WHEN {o.has('low', 'drone')} THEN 'drone' ELSE 'unknown' END AS attack_type FROM prepared)
SELECT msg_id, attack_type, {o.report_sql('low')} AS report_type, {o.confirmed_sql('low')} AS confirmed, {o.severity_sql('low')} AS severity,
  {o.facility_sql('low')} AS facility, array_to_string({o.types_sql('low')}, ' | ') AS site_type,
  CAST({o.n_targets_sql('low')} AS INTEGER) AS n_targets, ({o.n_targets_sql('low')}) > 1 OR attack_type = 'both' AS combined,
  {o.target_sql('low')} OR {o.has('low', 'primary', 'fire', 'shutdown')} OR {o.explosions_sql('low')} > 0 AS has_event FROM t""")
def message_classes(spark, sf):
    low = F.col("low")
    m = prepared(spark, sf).withColumn("_t", DET.targets(low))
    n = F.size("_t")
    return m.select(
        "msg_id", DET.attack_type(low).alias("attack_type"), DET.report_type(low).alias("report_type"),
        DET.confirmed(low).alias("confirmed"), DET.severity(low).alias("severity"), DET.facility(low).alias("facility"),
        tx.join_pipe(tx.distinct_types(F.transform("_t", lambda t: t["type"]))).alias("site_type"), n.alias("n_targets"),
        DET.combined(low, n, F.lit(False)).alias("combined"), DET.has_event(low).alias("has_event"))


@query("X13", f"""WITH {o.PREPARED}, n AS (SELECT msg_id, {o.facility_sql('low')} AS kind, {o.area_sql('low')} AS area,
  list_filter([{', '.join(f"CASE WHEN {o.any_sql('low', ps)} THEN {o.q(l + '=' + k)} END" for l, k, ps in PACK.sites)}], lambda x: x IS NOT NULL) AS named FROM prepared)
SELECT msg_id, unnest(CASE WHEN len(named) > 0 THEN named WHEN kind IS NOT NULL THEN
  ['Unknown ' || upper(kind[1]) || kind[2:] || coalesce(' (' || area || ')', '') || '=' || kind] ELSE [] END) AS target FROM n""")
def message_targets(spark, sf):
    t = prepared(spark, sf).select("msg_id", F.explode(DET.targets(F.col("low"))).alias("t"))
    return t.select("msg_id", F.concat("t.label", F.lit("="), "t.type").alias("target"))


@query("X16 D2", f"WITH {o.PREPARED} SELECT msg_id, msg_date, {o.date_sql('low', 'msg_date')} AS incident_date FROM prepared")
def incident_dates(spark, sf):
    return prepared(spark, sf).select("msg_id", "msg_date", dates.incident_date(F.col("msg_date"), F.col("low"), PACK).alias("incident_date"))


_SENT = f"""{o.PREPARED},
lists AS (SELECT *, {o.sentences_sql('clean')} AS ss FROM prepared),
sents AS (SELECT msg_id, pos, sent, lower({o.clean_sql('sent')}) AS sl
          FROM (SELECT msg_id, pos, ss[pos] AS sent FROM (SELECT msg_id, ss, unnest(range(1, len(ss) + 1)) AS pos FROM lists)))"""


def _anchor(col: str) -> str:
    return f"({o.has(col, 'primary', 'fire', 'shutdown')} OR {o.facility_sql(col)} IS NOT NULL)"


@query("X17", f"""WITH {_SENT}, w AS (SELECT l.msg_id, a.pos, array_to_string(l.ss[greatest(a.pos - 1, 1):a.pos + 2], ' ') AS win
  FROM lists l JOIN sents a USING (msg_id) WHERE {_anchor('a.sl')}),
d AS (SELECT *, row_number() OVER (PARTITION BY msg_id, lower(win) ORDER BY pos) AS dup FROM w),
n AS (SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY pos) - 1 AS INTEGER) AS i, win FROM d WHERE dup = 1)
SELECT * FROM n UNION ALL SELECT msg_id, 0, clean FROM lists WHERE len(ss) > 0 AND msg_id NOT IN (SELECT msg_id FROM w)""")
def sentence_windows(spark, sf):
    w = segments.anchored_windows(prepared(spark, sf), DET)
    return segments.to_rows(w, "windows", ["msg_id"], "i", "win")


_SEGMENTS = f"""{_SENT},
notes AS (SELECT *, {o.area_sql('sl')} AS area, {o.target_sql('sl')} AS has_target,
  ({o.target_sql('sl')} OR {o.has('sl', 'primary', 'fire')} OR {o.explosions_sql('sl')} > 0) AS has_event, {o.has('sl', 'transition')} AS trans FROM sents),
prev AS (SELECT *, last_value(area IGNORE NULLS) OVER (PARTITION BY msg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_area FROM notes),
marks AS (SELECT *, CASE WHEN pos > 1 AND has_event AND (coalesce(area <> prev_area, false) OR (trans AND has_target)) THEN 1 ELSE 0 END AS starts FROM prev),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY msg_id ORDER BY pos) AS sg FROM marks),
joined AS (SELECT msg_id, sg, string_agg(sent, ' ' ORDER BY pos) AS seg_text, count(*) OVER (PARTITION BY msg_id) AS dummy FROM numbered GROUP BY msg_id, sg),
lowered AS (SELECT j.*, lower({o.clean_sql('seg_text')}) AS sl FROM joined j JOIN lists l USING (msg_id) WHERE len(l.ss) > 1),
good AS (SELECT msg_id, sg, seg_text FROM lowered WHERE {o.target_sql('sl')} AND ({o.has('sl', 'primary', 'defence')} OR {o.confirmed_sql('sl')})),
segs AS (SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY sg) - 1 AS INTEGER) AS seg, seg_text FROM good
         UNION ALL SELECT msg_id, 0, clean FROM lists WHERE msg_id NOT IN (SELECT msg_id FROM good))"""


@query("X18", f"WITH {_SEGMENTS} SELECT msg_id, seg, seg_text FROM segs")
def event_segments(spark, sf):
    return segments.to_rows(segments.split_events(prepared(spark, sf), DET), "segments", ["msg_id"], "seg", "seg_text")


_FIELDS = dict(
    incident_date=o.date_sql("sl", "msg_date"), area=f"coalesce({o.area_sql('sl')}, {o.area_sql('low')}, 'Unknown Area')",
    site_type=f"array_to_string({o.types_sql('sl')}, ' | ')", combined=f"(n_segs > 1 OR ({o.n_targets_sql('sl')}) > 1)",
    scale=o.scale_sql("sl"), defended=o.has("sl", "defence"), shutdown=o.has("sl", "shutdown"), fire=o.has("sl", "fire"),
    explosions=f"CAST({o.explosions_sql('sl')} AS BIGINT)", confirmed=o.confirmed_sql("sl"), report_type=o.report_sql("sl"),
    severity=o.severity_sql("sl"), primary_hit=o.has("sl", "primary"), update_like=o.has("sl", "update_only"))

INCIDENTS_SQL = f"""WITH {_SEGMENTS},
parsed AS (SELECT msg_id, channel, ts, seg, msg_date, low, lower({o.clean_sql('seg_text')}) AS sl, count(*) OVER (PARTITION BY msg_id) AS n_segs
  FROM segs JOIN prepared USING (msg_id) WHERE clean <> '' AND NOT {o.has('low', 'fundraising', 'subscription', 'editorial', 'summary')}),
items AS (SELECT msg_id, channel, seg, {', '.join(f'{e} AS {n}' for n, e in _FIELDS.items())} FROM parsed WHERE {o.candidate_sql('sl')}),
scored AS (SELECT *, CAST({o.confidence_sql('report_type', 'confirmed', 'fire', 'shutdown', 'explosions', 'severity')} AS INTEGER) AS confidence,
  CAST({o.score_sql('fire', 'confirmed', 'shutdown', 'explosions', 'primary_hit', 'defended', 'severity', 'report_type')} AS INTEGER) AS score FROM items)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, incident_date, area, site_type ORDER BY score DESC, seg) AS rn FROM scored) WHERE rn = 1"""


def flat_incidents(df: DataFrame) -> DataFrame:
    return df.select(
        "msg_id", "channel", "seg", "incident_date", "area", tx.join_pipe(F.col("site_types")).alias("site_type"), "combined", "scale",
        "defended", "shutdown", "fire", "explosions", "confirmed", "report_type", "severity",
        F.col("primary").alias("primary_hit"), "update_like", "confidence", "score")


@query("X24 X21 X22 X23", INCIDENTS_SQL)
def parsed_incidents(spark, sf):
    return flat_incidents(extract_incidents(td.messages(spark, sf), PACK))


@query("X24 T9 X3 X13", INCIDENTS_SQL)
def dictionary_incidents(spark, sf):
    """As ``parsed_incidents``, with the aliases and the sites as a dictionary table instead of expressions of the plan."""
    aliases = spark.createDataFrame(PACK.gazetteer, "alias string, area string, prio long")
    rows = [(label, kind, p, i) for i, (label, kind, patterns) in enumerate(PACK.sites) for p in patterns]
    named = write_dictionary(work_dir(spark, "dictionary"), aliases, spark.createDataFrame(rows, "label string, type string, pattern string, prio long"))
    return flat_incidents(extract_incidents(td.messages(spark, sf), replace(PACK, gazetteer=[], sites=[]), dictionary=named))


#: Runs of letters of texts; those of five letters and more in three texts are aliases, and each is the area of its first three letters.
_PLACES_SQL = f"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[a-z]+')) AS run FROM documents),
own AS (SELECT DISTINCT doc_id, run FROM runs WHERE length(run) >= 5),
alias AS (SELECT run AS alias FROM own GROUP BY run HAVING count(*) >= 3),
sizes AS (SELECT DISTINCT length(alias) AS size FROM alias),
parts AS (SELECT DISTINCT run, substr(run, i::BIGINT, size) AS alias FROM (SELECT DISTINCT run FROM own) JOIN sizes ON length(run) >= size, unnest(range(1, length(run) - size + 2)) AS t(i)),
held AS (SELECT DISTINCT doc_id, alias FROM own JOIN parts USING (run) JOIN alias USING (alias))
SELECT doc_id, first(left(alias, 3) ORDER BY length(alias) DESC, alias) AS area, first(alias ORDER BY length(alias) DESC, alias) AS alias, count(*) AS n_aliases FROM held GROUP BY doc_id"""


@query("T9", _PLACES_SQL)
def dictionary_places(spark, sf):
    """Longest alias and area of every document by a dictionary of the corpus' own words."""
    docs = spread(td.table(spark, sf, "documents")).select("doc_id", F.translate("text", ascii_uppercase, ascii_lowercase).alias("low"))
    runs = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("([a-z]+)"), F.lit(1)))).alias("alias"))
    often = runs.filter(F.length("alias") >= 5).groupBy("alias").agg(F.count_distinct("doc_id").alias("n")).filter("n >= 3")
    words = write_dictionary(work_dir(spark, "dictionary"), often.select("alias", F.left("alias", F.lit(3)).alias("area"), F.lit(0).alias("prio")))
    held = docs.withColumn("_known", known(words, F.col("low"))).select("doc_id", F.col("_known.areas").alias("areas")).filter(F.size("areas") > 0)
    return held.select("doc_id", F.col("areas")[0]["label"].alias("area"), F.col("areas")[0]["pattern"].alias("alias"),
                       F.size("areas").cast("long").alias("n_aliases"))


_SIG = {"s_mention": o.has("low", "sig_mention"), "s_defence": o.has("low", "sig_defence"), "s_transit": o.has("low", "sig_transit"),
        "s_uncertain": o.has("low", "sig_uncertain"), "s_report": f"{o.has('low', 'sig_facility')} AND {o.has('low', 'sig_attack')}",
        "s_confirmed": f"{o.has('low', 'sig_facility')} AND {o.has('low', 'sig_attack')} AND {o.has('low', 'sig_official')}",
        "s_site": o.has("low", "sig_site"), "s_broad": o.has("low", "sig_broad"), "s_cross": o.has("low", "sig_cross")}

MESSAGE_SIGNALS_SQL = f"""WITH {o.PREPARED} SELECT msg_date AS date, channel, {', '.join(f'count(*) FILTER ({e}) AS {n}' for n, e in _SIG.items())},
  count(*) FILTER (clean <> '') AS msg_count FROM prepared GROUP BY ALL"""


@query("X26 A4", MESSAGE_SIGNALS_SQL)
def message_signals(spark, sf):
    return count_signals(spread(td.messages(spark, sf)), PACK)


@query("X18", """WITH c AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
s AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND role <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM c)
SELECT conv_id, CAST(seg AS BIGINT) AS seg, min(role) AS role, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM s GROUP BY conv_id, seg""")
def turn_segments(spark, sf):
    """The segment rule on ordered rows instead of sentences: a role change opens a segment.

    Both the previous role and the segment number are running aggregates over blocks of turns.
    """
    block, key, order = F.floor(F.col("turn") / 1000), ["conv_id"], ["turn"]
    t = td.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    t = running_before(t, key, block, order, {"_prev": (F.max, F.struct("turn", "role"))})
    change = F.coalesce(F.col("role") != F.col("_prev.role"), F.lit(False)).cast("bigint")
    t = running_before(t.withColumn("_c", change), key, block, order, {"_before": (F.sum, F.col("_c"))})
    t = t.withColumn("seg", F.coalesce("_before", F.lit(0)) + F.col("_c"))
    return t.groupBy("conv_id", "seg").agg(F.min("role").alias("role"), F.count("*").alias("n_turns"), F.sum("n_chars").alias("n_chars"))
