"""DuckDB SQL building blocks of the oracles: logical inputs and detector conditions as SQL text."""

from __future__ import annotations

from sigtide import constants as K
from sigtide.functions.text import is_literal
from sigtide.rules import demo_pack

PACK = demo_pack()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(col: str, patterns: list[str]) -> str:
    tests = [f"contains({col}, {q(p)})" if is_literal(p) else f"regexp_matches({col}, {q(p)})" for p in patterns]
    return "(" + (" OR ".join(tests) or "false") + ")"


def has(col: str, *groups: str) -> str:
    return any_sql(col, [p for g in groups for p in PACK.group(g)])


def clean_sql(col: str) -> str:
    t = f"replace(replace({col}, chr(160), ' '), chr(8203), ' ')"
    t = f"regexp_replace({t}, '\\[([^\\]]+)\\]\\((https?://[^\\)]+)\\)', '\\1', 'g')"
    t = f"regexp_replace({t}, 'https?://\\S+', '', 'g')"
    t = f"regexp_replace({t}, '__+', '', 'g')"
    t = f"regexp_replace({t}, '\\*+', '', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def sentences_sql(clean: str) -> str:
    t = f"regexp_replace({clean}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    t = f"regexp_replace({t}, '\\s+[—–-]\\s+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def area_sql(col: str) -> str:
    whens = " ".join(f"WHEN contains({col}, {q(a)}) THEN {q(n)}" for a, n in PACK.ordered_aliases())
    return f"CASE {whens} END"


def macro_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(a)} THEN {q(m)}" for a, m, _ in PACK.areas) + " END"


def facility_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(col, [p])} THEN {q(t)}" for p, t in PACK.facility) + " END"


def target_sql(col: str) -> str:
    return any_sql(col, [p for _, _, ps in PACK.sites for p in ps] + [p for p, _ in PACK.facility])


def count_sql(col: str, group: str) -> str:
    return " + ".join(f"len(regexp_extract_all({col}, {q(p)}))" for p in PACK.group(group))


def number_sql(text: str) -> str:
    """Digit string to BIGINT; null for the empty string and for what no BIGINT holds."""
    return f"TRY_CAST({text} AS BIGINT)"


def explosions_sql(col: str) -> str:
    caps = ", ".join(f"coalesce({number_sql(f'regexp_extract({col}, {q(p)}, 1)')}, 0)" for p in PACK.group("explosion_number"))
    return (f"greatest({count_sql(col, 'explosion')}, {caps}, CASE WHEN {has(col, 'explosion_several')} THEN 3 ELSE 0 END, "
            f"CASE WHEN {has(col, 'explosion_many')} THEN 5 ELSE 0 END)")


def numbers_sql(col: str) -> str:
    parts = [f"list_transform(regexp_extract_all({col}, {q(p)}, 1), lambda x: {number_sql('x')})" for p in PACK.group("unit_number")]
    unit = "|".join(PACK.group("unit"))
    for word, value in PACK.number_words.items():
        hit = f"regexp_matches({col}, {q(f'(^|[^a-z]){word}[^a-z]*({unit})')})"
        parts.append(f"CASE WHEN {hit} THEN [{value}::BIGINT] ELSE []::BIGINT[] END")
    parts.append(f"CASE WHEN {has(col, 'several')} THEN [3::BIGINT] ELSE []::BIGINT[] END")
    return "list_concat(" + ", ".join(parts) + ")" if len(parts) == 2 else "flatten([" + ", ".join(parts) + "])"


def scale_sql(col: str) -> str:
    top = f"list_max(list_transform({numbers_sql(col)}, lambda n: coalesce(n, 15)))"
    return (f"CASE WHEN {top} >= 15 THEN 'massive' WHEN {top} >= 5 THEN 'swarm' WHEN {top} >= 1 THEN 'few' "
            f"WHEN {has(col, 'update_only')} THEN NULL WHEN {has(col, 'drone')} THEN 'few' END")


def report_sql(col: str) -> str:
    return (f"CASE WHEN {has(col, 'correction')} THEN 'correction' WHEN {has(col, 'update_only')} THEN 'aftermath' "
            f"WHEN {has(col, 'official')} THEN 'official' ELSE 'hearsay' END")


def severity_sql(col: str) -> str:
    return f"CASE WHEN {has(col, 'damage_high')} THEN 'high' WHEN {has(col, 'damage_medium')} THEN 'medium' ELSE 'low' END"


def confirmed_sql(col: str) -> str:
    return f"({has(col, 'direct_hit', 'fire', 'shutdown')} OR {explosions_sql(col)} > 0)"


def followup_sql(col: str) -> str:
    return f"({has(col, 'followup')} AND NOT ({has(col, 'fire', 'shutdown', 'defence')} OR {explosions_sql(col)} > 0))"


def scope_sql(col: str) -> str:
    return f"(NOT {has(col, 'out_of_scope')} OR {any_sql(col, [a for a, _ in PACK.ordered_aliases()])})"


def candidate_sql(col: str) -> str:
    return (f"(NOT {followup_sql(col)} AND NOT {has(col, 'editorial', 'summary', 'outbound')} AND {scope_sql(col)} "
            f"AND {target_sql(col)} AND ({has(col, 'primary', 'context')} OR {confirmed_sql(col)}))")


def types_sql(col: str) -> str:
    """Distinct site types of a text in first-seen order."""
    named = ", ".join(f"CASE WHEN {any_sql(col, ps)} THEN {q(k)} END" for _, k, ps in PACK.sites)
    found = f"list_filter([{named}], lambda x: x IS NOT NULL)"
    seen = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    return (f"CASE WHEN len({found}) > 0 THEN {seen} WHEN {facility_sql(col)} IS NOT NULL THEN [{facility_sql(col)}] "
            f"ELSE []::VARCHAR[] END")


def n_targets_sql(col: str) -> str:
    named = " + ".join(f"CASE WHEN {any_sql(col, ps)} THEN 1 ELSE 0 END" for _, _, ps in PACK.sites)
    return f"CASE WHEN {named} > 0 THEN {named} WHEN {facility_sql(col)} IS NOT NULL THEN 1 ELSE 0 END"


def date_sql(col: str, msg_date: str) -> str:
    names = "|".join(PACK.months)
    forms = []
    for prefix in [*PACK.group("night_of"), ""]:
        p = f"{prefix}([0-9]{{1,2}}) +({names})"
        month = "CASE " + " ".join(f"WHEN regexp_extract({col}, {q(p)}, 2) = {q(m)} THEN {n}" for m, n in PACK.months.items()) + " END"
        forms.append(f"TRY_CAST(printf('%04d-%02d-%02d', year({msg_date}), {month}, "
                     f"TRY_CAST(regexp_extract({col}, {q(p)}, 1) AS BIGINT)) AS DATE)")
    return f"coalesce({', '.join(forms)}, CASE WHEN {has(col, 'yesterday')} THEN {msg_date} - 1 END, {msg_date})"


def confidence_sql(report: str, confirmed: str, fire: str, shutdown: str, explosions: str, severity: str) -> str:
    return (f"greatest(5, least(95, 50 + CASE {report} WHEN 'official' THEN 25 WHEN 'direct' THEN 10 WHEN 'hearsay' THEN -5 "
            f"WHEN 'correction' THEN 5 ELSE 0 END + CASE WHEN {confirmed} THEN 8 ELSE 0 END + CASE WHEN {fire} THEN 5 ELSE 0 END "
            f"+ CASE WHEN {shutdown} THEN 8 ELSE 0 END + least(greatest(coalesce({explosions}, 0), 0) * 2, 8) "
            f"+ CASE {severity} WHEN 'high' THEN 8 WHEN 'medium' THEN 4 ELSE 0 END))")


def score_sql(fire, confirmed, shutdown, explosions, primary, defended, severity, report) -> str:
    b = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
    return (f"({b(fire, 3)} + {b(confirmed, 2)} + {b(shutdown, 3)} + least({explosions}, 5) + {b(primary, 2)} + {b(defended, 1)} "
            f"+ CASE {severity} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END "
            f"+ CASE {report} WHEN 'official' THEN 2 WHEN 'direct' THEN 1 ELSE 0 END)")


# ── logical inputs ────────────────────────────────────────────────────────────

MESSAGES = """messages AS (
  SELECT doc_id AS msg_id, source AS channel, text,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) + to_minutes(doc_id % 1440) AS ts
  FROM documents)"""

PREPARED = MESSAGES + f""",
cleaned AS (SELECT msg_id, channel, ts, {clean_sql('text')} AS clean, CAST(ts + INTERVAL 3 HOUR AS DATE) AS msg_date
            FROM messages WHERE ts IS NOT NULL AND text IS NOT NULL),
prepared AS (SELECT *, lower({clean_sql('clean')}) AS low FROM cleaned)"""

EVENT_FLAGS = """flags AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS date, 'ch' || (user_id % 4) AS channel,
         event_type = 'click' AS s_mention, event_type = 'view' AS s_defence, event_type = 'signup' AS s_transit,
         event_type = 'purchase' AS s_uncertain, event_type IN ('click', 'view') AND value >= 20 AS s_report,
         event_type IN ('click', 'view') AND value >= 20 AND value >= 50 AS s_confirmed,
         event_type IN ('signup', 'purchase') AND value >= 20 AS s_site, event_type <> 'error' AS s_broad,
         event_type <> 'error' AND user_id % 3 = 0 AS s_cross
  FROM events)"""

_SUMS = ", ".join(f"count(*) FILTER ({s}) AS {s}" for s in K.SIGNALS)
SIG_SHORT = EVENT_FLAGS + f""",
sig_short AS (SELECT date, channel, {_SUMS}, count(*) AS msg_count FROM flags GROUP BY ALL)"""

INC_SHORT = """inc_short AS (
  SELECT event_id AS incident_id, CAST(ts AS DATE) AS date, 'area' || (user_id % 10) AS area, 'ch' || (user_id % 4) AS channel,
         'M' || (user_id % 10 % 5) AS macro_area,
         CASE WHEN value >= 100 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS severity,
         value >= 50 AS confirmed, event_id % 3 = 0 AS fire, event_id % 7 = 0 AS shutdown, event_id % 5 = 0 AS defended,
         event_id % 11 = 0 AS combined, CAST(event_id % 4 AS INTEGER) AS explosions,
         CASE WHEN event_id % 13 = 0 THEN 'merged' ELSE 'active' END AS status, ts AS created_at
  FROM events WHERE event_type = 'error')"""

INC_LONG = """inc_long AS (
  SELECT o_orderkey AS incident_id, CAST(o_orderdate AS DATE) AS date, n_name AS area, r_name AS macro_area, o_custkey AS place_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'medium'
              ELSE 'low' END AS severity,
         o_orderstatus = 'F' AS confirmed, o_orderkey % 3 = 0 AS fire, o_orderkey % 7 = 0 AS shutdown,
         o_orderkey % 5 = 0 AS defended, o_orderkey % 11 = 0 AS combined, CAST(o_orderkey % 4 AS INTEGER) AS explosions,
         CASE WHEN o_orderstatus = 'P' THEN 'merged' ELSE 'active' END AS status, o_orderdate AS created_at, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

SIG_LONG = """sig_long AS (
  SELECT macro_area, date, count(*) FILTER (severity = 'high') AS s_mention, count(*) FILTER (severity = 'medium') AS s_defence,
         count(*) FILTER (severity = 'low') AS s_transit, count(*) FILTER (status <> 'active') AS s_uncertain,
         count(*) FILTER (price >= 150000) AS s_report, count(*) FILTER (price >= 150000 AND confirmed) AS s_confirmed,
         count(*) FILTER (price < 50000) AS s_site, count(*) AS s_broad, count(*) FILTER (defended) AS s_cross,
         count(*) AS msg_count
  FROM inc_long GROUP BY ALL)"""

REACH_SHORT = "CASE macro_area WHEN 'M0' THEN 1 WHEN 'M1' THEN 2 WHEN 'M2' THEN 3 WHEN 'M3' THEN 4 ELSE 0 END"
REACH_LONG = "coalesce((SELECT r_regionkey + 1 FROM region WHERE r_name = macro_area), 0)"


def daily_inc(src: str, key: str, reach: str) -> str:
    return f"""rep AS (
  SELECT a.*, EXISTS (SELECT 1 FROM {src} b WHERE b.area = a.area AND b.status = 'active' AND b.incident_id <> a.incident_id
                      AND b.date BETWEEN a.date - 30 AND a.date - 1) AS repeated
  FROM {src} a WHERE a.status = 'active'),
daily_inc AS (
  SELECT {key}, date, count(*) AS inc_count, max(CAST(confirmed OR fire OR severity IN ('high', 'medium') AS INTEGER)) AS significant,
         max({reach}) AS reach_score, count(*) FILTER (fire) AS fire_count, count(*) FILTER (confirmed) AS hit_count,
         count(*) FILTER (shutdown) AS shutdown_count, sum(explosions)::BIGINT AS explosion_total,
         count(*) FILTER (combined) AS combined_count, count(*) FILTER (repeated) AS repeated_count
  FROM rep GROUP BY ALL)"""


def full_daily(sig: str, key: str) -> str:
    counters = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in [*K.INCIDENT_DAILY, *K.SIGNALS])
    return f"""bounds AS (SELECT {key}, min(date) AS lo, max(date) AS hi
  FROM (SELECT {key}, date FROM daily_inc UNION ALL SELECT {key}, date FROM {sig}) GROUP BY {key}),
spine AS (SELECT {key}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
full_daily AS (SELECT *, greatest(s_broad - s_cross, 0) AS s_internal FROM (
  SELECT {key}, date, {counters} FROM spine LEFT JOIN daily_inc USING ({key}, date) LEFT JOIN {sig} USING ({key}, date)))"""


SHORT_DAILY = f"WITH {SIG_SHORT}, {INC_SHORT}, {daily_inc('inc_short', 'channel', REACH_SHORT)}, {full_daily('sig_short', 'channel')}"
LONG_DAILY = f"WITH {INC_LONG}, {SIG_LONG}, {daily_inc('inc_long', 'macro_area', REACH_LONG)}, {full_daily('sig_long', 'macro_area')}"


def feature_sql(key: str, lb: int, signals: list[str] = K.SIGNALS_EXT, src: str = "full_daily") -> dict[str, str]:
    """Feature expressions over windows ``f`` (lookback) and ``b`` (30-row baseline) and ``k`` (series)."""
    frame = f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN {lb} PRECEDING AND 1 PRECEDING)"
    base = f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
    order = f"(PARTITION BY {key} ORDER BY date)"
    norm = sum(K.DECAY**i for i in range(lb))
    out = {}

    def lag(c: str, k: int) -> str:
        return f"lag({c}, {k}) OVER {order}"

    def ewm(c: str) -> str:
        return "(" + " + ".join(f"{K.DECAY**(k - 1)!r} * {lag(c, k)}" for k in range(1, lb + 1)) + f") / {norm!r}"

    for s in signals:
        n = f"count({s}) OVER {base}"
        mean = f"CASE WHEN {n} >= 5 THEN avg({s}) OVER {base} ELSE 0 END"
        raw = f"stddev_samp({s}) OVER {base}"
        std = f"CASE WHEN {n} >= 5 AND {raw} > 1e-9 THEN {raw} ELSE 1 END"
        out[f"{s}_sum"] = f"sum({s}) OVER {frame}"
        out[f"{s}_ewm"] = ewm(s)
        for k in (1, 3, 7):
            out[f"{s}_lag{k}"] = lag(s, k) if k <= lb else "0"
        out[f"{s}_slope"] = f"regr_slope({s}, rn) OVER {frame}" if lb >= 3 else "0"
        out[f"{s}_zscore"] = f"({lag(s, 1)} - ({mean})) / ({std})"
        out[f"_h_{s}"] = f"list({s}) OVER {frame}"
        out[f"_m_{s}"], out[f"_s_{s}"] = mean, std
    month = "month(date - 1)"
    out["s_mention_x_s_report"] = f"{lag('s_mention', 1)} * {lag('s_report', 1)}"
    out["sin_month"] = f"sin(2 * pi() * {month} / 12)"
    out["cos_month"] = f"cos(2 * pi() * {month} / 12)"
    out["is_heating_season"] = f"CASE WHEN {month} IN (10, 11, 12, 1, 2, 3) THEN 1 ELSE 0 END"
    out["recent_incident_rate"] = f"avg(CASE WHEN inc_count > 0 THEN 1.0 ELSE 0.0 END) OVER {frame}"
    out["days_since_last_incident"] = f"coalesce(rn - 1 - max(CASE WHEN inc_count > 0 THEN rn END) OVER {frame}, {lb})"
    out["incident_momentum"] = ewm("inc_count")
    return out


def feature_query(with_sql: str, key: str, lb: int, signals: list[str] = K.SIGNALS_EXT, names: list[str] | None = None,
                  tail: str = "", digits: int = 6) -> str:
    """CTEs up to ``feats`` (key, date, rn, n, all features unrounded); then a select of the wanted names."""
    exprs = feature_sql(key, lb, signals)
    inner = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    alerts = ", ".join(f"len(list_filter(_h_{s}, lambda v: (v - _m_{s}) / _s_{s} > 1)) AS {s}_alert_days" for s in signals)
    ctes = f"""{with_sql},
numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM full_daily),
raw AS (SELECT {key}, date, rn, n, {inner} FROM numbered),
feats AS (SELECT * EXCLUDE (rn, n), rn, n, {alerts} FROM raw WHERE rn > {lb})"""
    if names is None:
        return ctes
    cols = ", ".join(f"round({c}::DOUBLE, {digits}) AS {c}" for c in names)
    return f"{ctes} SELECT {key}, date, {cols} FROM feats {tail}"
