"""Daily signals, rollups, the daily frame, timeline reports, correlations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.operators import analogs, correlate, daily, report
from sigtide.operators import features as ft
from sigtide.plans import oracle as o
from sigtide.plans.common import LONG, SHORT, long_daily, rounded, short_daily, signals_short
from sigtide.plans.incident_plans import links
from sigtide.plans.registry import query
from sigtide.sources import testdata as td


@query("A4 X26", f"WITH {o.SIG_SHORT} SELECT * FROM sig_short")
def event_signals(spark, sf):
    return signals_short(spark, sf)


@query("S5 P5", f"""WITH {o.SIG_SHORT} SELECT date, s_mention, s_broad, s_cross, greatest(s_broad - s_cross, 0) AS s_internal FROM sig_short
WHERE channel = 'ch1'""")
def channel_signals(spark, sf):
    s = daily.fill_signals(signals_short(spark, sf).filter(F.col("channel") == "ch1"))
    return daily.with_internal(s).select("date", "s_mention", "s_broad", "s_cross", "s_internal")


@query("S6", f"""WITH {o.SIG_SHORT} SELECT channel, date, s_mention FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY date DESC) AS rn FROM sig_short)
WHERE rn <= 10""")
def latest_signals(spark, sf):
    return daily.latest_rows(signals_short(spark, sf), SHORT, 10).select("channel", "date", "s_mention")


@query("A2 J3", f"WITH {o.INC_LONG}, {o.daily_inc('inc_long', 'macro_area', o.REACH_LONG)} SELECT * FROM daily_inc")
def daily_incidents(spark, sf):
    return daily.daily_incidents(td.incidents_long(spark, sf), td.reach_long(spark, sf), LONG)


@query("A2 P4", f"WITH {o.INC_SHORT}, {o.daily_inc('inc_short', 'channel', o.REACH_SHORT)} SELECT * FROM daily_inc")
def daily_incidents_by_channel(spark, sf):
    return daily.daily_incidents(td.incidents_short(spark, sf), td.reach_short(spark), SHORT)


_TIMELINE = f"""{o.INC_LONG}, tl0 AS (SELECT macro_area, date, count(*) AS inc_count, count(*) FILTER (fire) AS fire_count,
  count(*) FILTER (confirmed) AS hits, count(*) FILTER (shutdown) AS shutdowns, count(*) FILTER (defended) AS defended_count,
  count(*) FILTER (combined) AS combined_count, avg(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS avg_severity
  FROM inc_long WHERE status = 'active' GROUP BY ALL),
tl AS (SELECT *, avg(inc_count) OVER (PARTITION BY macro_area ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7d FROM tl0),
lim AS (SELECT macro_area, CASE WHEN count(*) > 4 THEN quantile_cont(inc_count, 0.75) ELSE 3 END AS threshold FROM tl GROUP BY 1)"""


@query("A3 W2 P11", f"""WITH {_TIMELINE} SELECT * EXCLUDE (avg_severity, rolling_7d), round(avg_severity, 6) AS avg_severity, round(rolling_7d, 6) AS rolling_7d,
  CASE WHEN avg_severity < 1.5 THEN 'low' WHEN avg_severity < 2.5 THEN 'medium' ELSE 'high' END AS bucket FROM tl""")
def daily_timeline(spark, sf):
    from sigtide.functions.scoring import severity_bucket
    t = daily.daily_timeline(td.incidents_long(spark, sf), LONG).withColumn("bucket", severity_bucket(F.col("avg_severity")))
    return rounded(t, "avg_severity", "rolling_7d")


@query("A8 W20", f"WITH {_TIMELINE} SELECT macro_area, date, inc_count, threshold::DOUBLE AS threshold, inc_count >= threshold AS intense FROM tl JOIN lim USING (macro_area)")
def intense_days(spark, sf):
    t = daily.daily_timeline(td.incidents_long(spark, sf), LONG)
    return daily.intense_days(t, LONG).select("macro_area", "date", "inc_count", "threshold", "intense")


@query("R1", f"""WITH {_TIMELINE}, {o.SIG_LONG}, l AS (SELECT macro_area, date, CASE WHEN inc_count >= threshold THEN 'intense' ELSE 'any' END AS band,
  CASE WHEN avg_severity < 1.5 THEN 'low' WHEN avg_severity < 2.5 THEN 'medium' ELSE 'high' END AS bucket,
  {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in report.INCIDENT_SERIES)} FROM tl JOIN lim USING (macro_area))
SELECT macro_area, date, series, 'incidents' AS axis, value, band, bucket FROM (UNPIVOT l ON {', '.join(report.INCIDENT_SERIES)} INTO NAME series VALUE value)
UNION ALL SELECT macro_area, date, series, 'signals', value::DOUBLE, NULL, NULL FROM (UNPIVOT sig_long ON {', '.join(K.SIGNALS)} INTO NAME series VALUE value)""")
def timeline_report(spark, sf):
    t = daily.daily_timeline(td.incidents_long(spark, sf), LONG)
    return rounded(report.timeline(t, daily.intense_days(t, LONG), td.signals_long(spark, sf), LONG), "value")


@query("W18", f"""WITH {o.SIG_SHORT}, {o.INC_SHORT}, {o.daily_inc('inc_short', 'channel', o.REACH_SHORT)}, {o.full_daily('sig_short', 'channel')}
SELECT channel, date FROM spine""")
def date_spine(spark, sf):
    both = td.incidents_short(spark, sf).filter("status = 'active'").select("channel", "date").unionByName(
        signals_short(spark, sf).select("channel", "date"))
    return daily.date_spine(both, SHORT)


@query("J4 W18 P5", o.LONG_DAILY + " SELECT * FROM full_daily")
def full_daily(spark, sf):
    return long_daily(spark, sf)


@query("J4", o.SHORT_DAILY + " SELECT * FROM full_daily")
def full_daily_by_channel(spark, sf):
    return short_daily(spark, sf)


@query("A21", o.LONG_DAILY + """ SELECT macro_area, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM full_daily GROUP BY 1""")
def dataset_summary(spark, sf):
    return daily.dataset_summary(long_daily(spark, sf), LONG)


_LINKED = f"""{o.INC_LONG}, links AS (SELECT DISTINCT l_orderkey AS incident_id, l_partkey AS site_id FROM lineitem),
linked AS (SELECT date, macro_area, lower(trim(p_type)) AS site_type FROM inc_long JOIN links USING (incident_id) JOIN part ON site_id = p_partkey
           WHERE status = 'active' AND p_type IS NOT NULL AND lower(trim(p_type)) NOT IN ('unknown', 'other', ''))"""


def linked(spark, sf):
    from sigtide.operators import incidents as inc
    i = inc.active(td.incidents_long(spark, sf)).select("incident_id", "date", "macro_area")
    return inc.link_sites(i, links(spark, sf), td.sites(spark, sf), "inner")


@query("A6", f"WITH {_LINKED} SELECT site_type, count(*) AS n FROM linked GROUP BY 1 HAVING count(*) >= 5")
def frequent_types(spark, sf):
    return daily.frequent_types(linked(spark, sf))


TYPE_DAYS = f"""{_LINKED}, often AS (SELECT site_type FROM linked GROUP BY 1 HAVING count(*) >= 5),
tdays AS (SELECT DISTINCT macro_area, date, 'type_' || replace(replace(site_type, ' ', '_'), '/', '_') AS outcome FROM linked JOIN often USING (site_type))"""


def type_outcomes(spark, sf):
    return daily.type_outcomes(linked(spark, sf), LONG)


@query("A7", f"WITH {TYPE_DAYS} PIVOT tdays ON outcome USING count(*) GROUP BY macro_area, date")
def type_days(spark, sf):
    return daily.type_days(type_outcomes(spark, sf), LONG)


@query("J4 A7", o.LONG_DAILY + f""", {TYPE_DAYS.removeprefix(o.INC_LONG + ", ")},
every AS (SELECT macro_area, date, inc_count, s_broad, outcome FROM full_daily LEFT JOIN tdays USING (macro_area, date))
PIVOT every ON outcome USING count(*) GROUP BY macro_area, date, inc_count, s_broad""")
def full_daily_with_types(spark, sf):
    inc = daily.daily_incidents(td.incidents_long(spark, sf), td.reach_long(spark, sf), LONG)
    types = daily.type_days(type_outcomes(spark, sf), LONG)
    full = daily.full_daily(inc, td.signals_long(spark, sf), LONG, types)
    return full.select("macro_area", "date", "inc_count", "s_broad", *[c for c in types.columns if c not in ("macro_area", "date")])


@query("ML7 W15", o.LONG_DAILY + f""", {TYPE_DAYS.removeprefix(o.INC_LONG + ", ")}
SELECT f.macro_area, f.date, outcome, min(t.date - f.date)::INTEGER AS days_ahead FROM full_daily f JOIN tdays t
  ON t.macro_area = f.macro_area AND t.date BETWEEN f.date AND f.date + {max(K.HORIZONS) - 1} GROUP BY ALL""")
def type_labels(spark, sf):
    """Long form of the outcomes from types: days until each type's next day, where that lies within the longest horizon."""
    ahead = ft.next_types(long_daily(spark, sf).select(*LONG, "date"), type_outcomes(spark, sf), LONG, max(K.HORIZONS))
    return (ahead.select(*LONG, "date", F.inline(F.arrays_zip("ahead_outcome", "ahead_wait")))
            .withColumnsRenamed({"ahead_outcome": "outcome", "ahead_wait": "days_ahead"}))


@query("A10", f"""WITH {_LINKED}, c AS (SELECT macro_area, site_type, count(*) AS n FROM linked GROUP BY ALL)
SELECT macro_area, site_type, n, round(n / sum(n) OVER (PARTITION BY macro_area), 6) AS share,
  row_number() OVER (PARTITION BY macro_area ORDER BY n DESC, site_type) AS rank FROM c QUALIFY rank <= 5""")
def type_shares(spark, sf):
    counts = daily.typed(linked(spark, sf)).groupBy("macro_area", "site_type").agg(F.count("*").alias("n"))
    return rounded(analogs.top_shares(counts, LONG, "site_type"), "share")


# ── correlations ──────────────────────────────────────────────────────────────

def _ccf(with_sql: str, key: str) -> str:
    lags = ", ".join(f"lead(inc_count, {g}) OVER w AS y{g}".replace("lead(inc_count, -", "lag(inc_count, ").replace("y-", "ym")
                     for g in range(-14, 15))
    rows = " UNION ALL ".join(
        f"SELECT {key}, feature, {g} AS lag, count(y{str(g).replace('-', 'm')}) AS n_pairs, CASE WHEN count(y{str(g).replace('-', 'm')}) >= 10 "
        f"AND stddev_pop(x) FILTER (y{str(g).replace('-', 'm')} IS NOT NULL) > 1e-12 AND stddev_pop(y{str(g).replace('-', 'm')}) > 1e-12 "
        f"THEN corr(x, y{str(g).replace('-', 'm')}) END AS pearson_r FROM long GROUP BY ALL" for g in range(-14, 15))
    return f"""{with_sql}, shifted AS (SELECT *, {lags} FROM full_daily WINDOW w AS (PARTITION BY {key} ORDER BY date)),
long AS (UNPIVOT shifted ON {', '.join(K.SIGNALS)} INTO NAME feature VALUE x), ccf AS ({rows})"""


@query("A12", f"{_ccf(o.LONG_DAILY, 'macro_area')} SELECT macro_area, feature, lag, n_pairs, round(pearson_r, 6) AS pearson_r FROM ccf")
def lagged_correlation(spark, sf):
    return rounded(correlate.lagged_corr(long_daily(spark, sf), LONG), "pearson_r")


@query("A12", f"{_ccf(o.SHORT_DAILY, 'channel')} SELECT channel, feature, lag, n_pairs, round(pearson_r, 6) AS pearson_r FROM ccf")
def lagged_correlation_by_channel(spark, sf):
    return rounded(correlate.lagged_corr(short_daily(spark, sf), SHORT), "pearson_r")


@query("A14 R2", f"""{_ccf(o.LONG_DAILY, 'macro_area')} SELECT macro_area, feature, arg_max(lag, (abs(pearson_r), -lag)) AS best_lag,
  round(arg_max(pearson_r, (abs(pearson_r), -lag)), 6) AS pearson_r FROM ccf WHERE lag > 0 AND pearson_r IS NOT NULL GROUP BY ALL""")
def best_lags(spark, sf):
    return rounded(correlate.best_positive_lag(correlate.lagged_corr(long_daily(spark, sf), LONG), LONG), "pearson_r")


_FEATS, _OUTS = ft.feature_names(), [s["name"] for s in K.OUTCOMES]
_LABELS = ", ".join(f"CASE WHEN {s['col']} >= {s['threshold']} THEN 1.0 ELSE 0 END AS {s['name']}" for s in K.OUTCOMES)


@query("A11", f"""{o.feature_query(o.LONG_DAILY, 'macro_area', 10)},
lab AS (SELECT macro_area, date, {_LABELS} FROM full_daily),
d AS (SELECT macro_area, {', '.join(_OUTS)}, {', '.join(f'{f}::DOUBLE AS {f}' for f in _FEATS)} FROM feats JOIN lab USING (macro_area, date)),
u AS (UNPIVOT d ON {', '.join(_FEATS)} INTO NAME feature VALUE x)
{' UNION ALL '.join(f"SELECT macro_area, feature, '{n}' AS outcome, round(CASE WHEN stddev_pop({n}) > 1e-12 AND stddev_pop(x) > 1e-12 THEN corr(x, {n}) END, 6) AS r FROM u GROUP BY ALL" for n in _OUTS)}""")
def feature_outcome_correlation(spark, sf):
    data = ft.build_dataset(long_daily(spark, sf), LONG, [10], [1], K.OUTCOMES)
    return rounded(correlate.feature_outcome_corr(data, LONG, _FEATS, _OUTS), "r")
