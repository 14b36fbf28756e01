"""Messages to incidents as one narrow plan: no shuffle between the scan and the incident rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import dates, scoring
from sigtide.functions import text as tx
from sigtide.functions.detect import Detector
from sigtide.operators.gazetteer import Dictionary, known, search_text
from sigtide.operators.segments import split_events
from sigtide.rules import RulePack
from sigtide.session import spread


def prepare(messages: DataFrame, offset_hours: int = K.UTC_OFFSET_HOURS) -> DataFrame:
    """Cleaned and lower-cased text plus the local date; undated messages go."""
    return (
        messages.filter(F.col("ts").isNotNull() & F.col("text").isNotNull())
        .withColumn("clean", tx.clean_text(F.col("text")))
        .withColumn("low", tx.relower(F.col("clean")))
        .withColumn("msg_date", dates.local_date(F.col("ts"), offset_hours))
    )


def _fields(low: Column, det: Detector, msg_area: Column, msg_date: Column, multi: Column, matched: Column) -> Column:
    return tx.bind(det.targets(low), lambda targets: F.struct(
        dates.incident_date(msg_date, low, det.pack).alias("incident_date"),
        F.coalesce(det.area(low), msg_area, F.lit(K.UNKNOWN_AREA)).alias("area"),
        tx.distinct_types(F.transform(targets, lambda t: t["type"])).alias("site_types"),
        (multi | (F.size(targets) > 1) | matched).alias("combined"),
        det.scale(low).alias("scale"),
        det.has(low, "defence").alias("defended"),
        det.has(low, "shutdown").alias("shutdown"),
        det.has(low, "fire").alias("fire"),
        det.explosions(low).alias("explosions"),
        det.confirmed(low).alias("confirmed"),
        det.report_type(low).alias("report_type"),
        det.severity(low).alias("severity"),
        det.has(low, "primary").alias("primary"),
        det.has(low, "update_only").alias("update_like"),
    ))


def _with_scores(item: Column, seg: Column) -> Column:
    """Sort key first: (date, area, types) ascending, then best score, then earliest segment."""
    score = scoring.signal_score(item["fire"], item["confirmed"], item["shutdown"], item["explosions"],
                                 item["primary"], item["defended"], item["severity"], item["report_type"])
    conf = scoring.confidence(item["report_type"], item["confirmed"], item["fire"], item["shutdown"],
                              item["explosions"], item["severity"])
    return F.struct(
        item["incident_date"].alias("incident_date"), item["area"].alias("area"),
        tx.join_pipe(item["site_types"]).alias("site_type"), (-score).alias("neg_score"), seg.alias("seg"),
        score.alias("score"), conf.alias("confidence"), item.alias("item"),
    )


INCIDENT_COLUMNS = [
    "incident_date", "area", "site_types", "combined", "scale", "defended", "shutdown", "fire", "explosions",
    "confirmed", "report_type", "severity", "confidence", "primary", "update_like", "score",
]


def extract_incidents(messages: DataFrame, pack: RulePack, matched: Column | None = None,
                      offset_hours: int = K.UTC_OFFSET_HOURS, dictionary: Dictionary | None = None) -> DataFrame:
    """Parse messages (msg_id, channel, ts, text) into incident candidates, one row each.

    Whole-message rejection runs before segmentation. Rows without a candidate vanish in the final
    explode; there is no filter on a derived column before it (see ``split_events``). Per message and (date, area, types) the
    segment with the best signal score stays, the earliest on ties. A ``dictionary`` stands for the pack's aliases and sites.
    """
    det = Detector(pack) if dictionary is None else Detector(pack, F.col("_known"))
    matched = F.lit(False) if matched is None else matched
    keep = (F.col("clean") != "") & ~det.fast_reject(F.col("low"))
    ready = prepare(spread(messages), offset_hours).withColumn("_split", F.when(keep, tx.split_sentences(F.col("clean"), cleaned=True)))
    if dictionary is not None:
        ready = ready.withColumn("_search", search_text(F.col("_split"), F.col("low"))).withColumn("_known", known(dictionary, F.col("_search")))
    kept = (
        ready
        .withColumn("msg_area", det.area(F.col("low")))
        .withColumn("_matched", matched)
    )
    segs = (
        split_events(kept, det, sentences=F.col("_split"))
        .withColumn("_multi", F.size("segments") > 1)
        .withColumn("_lows", F.transform("segments", lambda s, i: F.struct(tx.relower(s).alias("low"), i.alias("seg"))))
        .withColumn("_cands", F.filter("_lows", lambda s: det.candidate(s["low"])))
    )
    items = F.transform("_cands", lambda s: F.struct(
        _fields(s["low"], det, F.col("msg_area"), F.col("msg_date"), F.col("_multi"), F.col("_matched")).alias("item"),
        s["seg"].alias("seg")))
    scored = F.transform("_items", lambda x: _with_scores(x["item"], x["seg"]))

    def same_key(a: Column, b: Column) -> Column:
        return ((a["incident_date"] == b["incident_date"]) & (a["area"] == b["area"])
                & (a["site_type"] == b["site_type"]))

    best = F.filter("_sorted", lambda x, i: (i == 0) | ~same_key(x, F.get(F.col("_sorted"), i - 1)))
    out = (
        segs.withColumn("_items", items)
        .withColumn("_sorted", F.array_sort(scored))
        .select("msg_id", "channel", "ts", F.explode(best).alias("x"))
    )
    picked = []
    for c in INCIDENT_COLUMNS:
        src = f"x.{c}" if c in ("confidence", "score", "incident_date", "area") else f"x.item.{c}"
        picked.append(F.col(src).alias(c))
    return out.select("msg_id", "channel", "ts", F.col("x.seg").alias("seg"), *picked)


def count_signals(messages: DataFrame, pack: RulePack, offset_hours: int = K.UTC_OFFSET_HOURS,
                  extra_keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Nine signal counters plus the message count per local date and channel.

    Only booleans reach the shuffle, already summed per map task, so a hot channel is no problem.
    """
    det = Detector(pack)
    low = F.col("low")
    flagged = (
        prepare(spread(messages), offset_hours)
        .select(
            F.col("msg_date").alias("date"), *extra_keys, (F.col("clean") != "").alias("f_text"),
            *[det.has(low, f"sig_{g}").alias(f"f_{g}") for g in (
                "mention", "defence", "transit", "uncertain", "official", "facility", "attack", "site", "broad", "cross")],
        )
    )
    report = F.col("f_facility") & F.col("f_attack")
    return flagged.groupBy("date", *extra_keys).agg(
        F.count_if("f_mention").alias("s_mention"),
        F.count_if("f_defence").alias("s_defence"),
        F.count_if("f_transit").alias("s_transit"),
        F.count_if("f_uncertain").alias("s_uncertain"),
        F.count_if(report).alias("s_report"),
        F.count_if(report & F.col("f_official")).alias("s_confirmed"),
        F.count_if("f_site").alias("s_site"),
        F.count_if("f_broad").alias("s_broad"),
        F.count_if("f_cross").alias("s_cross"),
        F.count_if("f_text").alias("msg_count"),
    )
