"""Incident store: site joins, repeat flags, matching, get-or-create dimensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtide import constants as K
from sigtide.functions import text as tx


def day_number(c: str | Column) -> Column:
    return F.unix_date(F.col(c) if isinstance(c, str) else c)


def active(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("status") == "active")


def link_sites(incidents: DataFrame, bridge: DataFrame, sites: DataFrame, how: str = "left") -> DataFrame:
    """Incident to bridge to site. No hints: Catalyst broadcasts a side only while its size allows."""
    return incidents.join(bridge, "incident_id", how).join(sites, "site_id", how)


def site_type_lists(bridge: DataFrame, sites: DataFrame) -> DataFrame:
    """Per incident the distinct site types, sorted and pipe-joined.

    The types are collected as a set, so map tasks send each type of an incident once.
    """
    return (
        bridge.join(sites, "site_id").filter(F.col("site_type").isNotNull())
        .groupBy("incident_id").agg(F.collect_set("site_type").alias("_types"))
        .select("incident_id", tx.join_pipe(F.array_sort("_types")).alias("site_type"))
    )


def with_site_types(incidents: DataFrame, bridge: DataFrame, sites: DataFrame) -> DataFrame:
    """Incidents with their aggregated site types; 'unknown' without any."""
    return (incidents.join(site_type_lists(bridge, sites), "incident_id", "left")
            .withColumn("site_type", F.coalesce("site_type", F.lit("unknown"))))


def repeat_days(incidents: DataFrame, area: str = "area", days: int = K.REPEAT_DAYS) -> DataFrame:
    """Per (area, date) with active incidents: was there another 1..``days`` days earlier?

    Incidents collapse to distinct days first, so the window holds at most one row per calendar day
    however many incidents an area has.
    """
    w = Window.partitionBy(area).orderBy("date")
    return (active(incidents).select(area, "date").distinct()
            .withColumn("repeated", F.coalesce(F.datediff("date", F.lag("date").over(w)) <= days, F.lit(False))))


def with_repeat_flag(incidents: DataFrame, area: str = "area", days: int = K.REPEAT_DAYS) -> DataFrame:
    """Active incidents with the ``repeated`` flag of their area and day."""
    return active(incidents).join(repeat_days(incidents, area, days), [area, "date"])


# ── matching against recent incidents ─────────────────────────────────────────

def _newest(cond: Column | None = None) -> Column:
    """Newest incident by (updated, id); null update times lose."""
    order = F.struct(F.coalesce("updated_at", F.lit(dt.datetime(1, 1, 1)).cast("timestamp_ntz")), F.col("incident_id"))
    value = F.struct("updated_at", "incident_id")
    return F.max_by(value if cond is None else F.when(cond, value), order if cond is None else F.when(cond, order))


def match_days(existing: DataFrame, days: int = K.MERGE_DAYS) -> DataFrame:
    """Compact lookup per (area, match date): what a candidate of that date can match.

    Per (area, date) only the newest incident per type, the newest untyped one and the newest of all
    can ever win, so those are kept and the rest of a hot area never travels. Each day is then
    offered to the dates it can serve, 0..``days`` later.
    """
    e = active(existing).withColumn("_unknown", tx.types_unknown(F.col("site_types")))
    per_type = (
        e.select("area", "date", "incident_id", "updated_at",
                 F.explode(F.array_distinct(F.transform("site_types", F.lower))).alias("_type"))
        .groupBy("area", "date", "_type").agg(_newest().alias("_best"))
        .groupBy("area", "date").agg(F.map_from_entries(F.collect_list(F.struct("_type", "_best"))).alias("by_type"))
    )
    overall = e.groupBy("area", "date").agg(
        _newest(F.col("_unknown")).alias("best_unknown"), _newest().alias("best_any"))
    day = overall.join(per_type, ["area", "date"], "left")
    age = F.explode(F.sequence(F.lit(0), F.lit(days))).alias("age")
    return (
        day.select("*", age)
        .groupBy("area", F.date_add("date", F.col("age")).alias("match_date"))
        .pivot("age", list(range(days + 1)))
        .agg(F.first(F.struct("by_type", "best_unknown", "best_any", "date")))
    )


def match_candidates(candidates: DataFrame, existing: DataFrame, days: int = K.MERGE_DAYS) -> DataFrame:
    """Add ``match_id`` and ``match_class`` (0 = shared type, 1 = either side unknown) to candidates.

    Candidates need area, incident_date, site_types. Same area, incident date at most ``days``
    earlier; a shared type beats an unknown type; within a class the later date, then the latest
    update, then the larger id wins. One equi-join on a unique key, so no candidate multiplies.
    """
    lookup = match_days(existing, days)
    types = F.array_distinct(F.transform("site_types", F.lower))
    unknown = tx.types_unknown(F.col("site_types"))
    options = []
    for a in range(days + 1):
        day = F.col(f"`{a}`")
        options.append((0, _best_of_types(day, types)))
    for a in range(days + 1):
        day = F.col(f"`{a}`")
        options.append((1, _ordered(F.when(unknown, day["best_any"]).otherwise(day["best_unknown"]))))
    match_id = F.coalesce(*[o["incident_id"] for _, o in options])
    match_class = F.coalesce(*[F.when(o["incident_id"].isNotNull(), c) for c, o in options])
    joined = candidates.join(
        lookup, (candidates["area"] == lookup["area"]) & (candidates["incident_date"] == lookup["match_date"]), "left"
    ).drop(lookup["area"])
    return (joined.withColumn("match_id", match_id).withColumn("match_class", match_class)
            .drop("match_date", *[str(a) for a in range(days + 1)]))


def _best_of_types(day: Column, types: Column) -> Column:
    hits = F.transform(types, lambda t: _ordered(F.try_element_at(day["by_type"], t)))
    return F.array_max(F.array_compact(hits))


def _ordered(best: Column) -> Column:
    """Comparable form of a newest-incident struct: nulls of updated_at sort first in Spark."""
    return F.when(best.isNotNull(), F.struct(best["updated_at"].alias("updated_at"), best["incident_id"].alias("incident_id")))


# ── dimension and bridge ──────────────────────────────────────────────────────

def site_key(site_type: Column, area: Column) -> Column:
    """Deterministic surrogate id of a site: hash of the case-folded (type, area)."""
    return F.xxhash64(F.lower(site_type), F.lower(F.coalesce(area, F.lit(""))))


def get_or_create_sites(sites: DataFrame, wanted: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Existing sites plus one new row per case-folded (type, area) that is not there yet.

    Duplicates among the wanted rows collapse first (smallest spelling), so the anti-join sees
    distinct keys.
    """
    def key(df: DataFrame) -> DataFrame:
        return df.withColumn("_t", F.lower("site_type")).withColumn("_a", F.lower(F.coalesce("area", F.lit(""))))

    new = (
        key(wanted).groupBy("_t", "_a").agg(F.min(F.struct("site_type", "area")).alias("_s"))
        .join(key(sites).select("_t", "_a"), ["_t", "_a"], "left_anti")
        .select(F.col("_s.site_type").alias("site_type"), F.col("_s.area").alias("area"))
        .withColumn("site_id", site_key(F.col("site_type"), F.col("area")))
        .withColumn("is_canonical", ~tx.is_unknown(F.col("area")))
    )
    if areas is not None:
        new = new.join(areas.select("area", "macro_area"), "area", "left")
    return sites.unionByName(new, allowMissingColumns=True)


def insert_links(bridge: DataFrame, new: DataFrame) -> DataFrame:
    """Insert, do nothing on conflict: existing links win, new ones are unique per (incident, site)."""
    keys = ["incident_id", "site_id"]
    return bridge.unionByName(
        new.dropDuplicates(keys).join(bridge.select(*keys), keys, "left_anti"), allowMissingColumns=True)


# ── lookups ───────────────────────────────────────────────────────────────────

def recent(incidents: DataFrame, n: int = 5, for_date: dt.date | None = None) -> DataFrame:
    """Latest active incidents up to a date. The site types of n rows are joined after the limit."""
    out = active(incidents)
    if for_date is not None:
        out = out.filter(F.col("date") <= F.lit(for_date))
    return out.orderBy(F.desc_nulls_last("date"), F.desc("created_at"), F.desc("incident_id")).limit(n)


def by_id(incidents: DataFrame, incident_id: int) -> DataFrame:
    return incidents.filter(F.col("incident_id") == incident_id)


def in_date_range(df: DataFrame, first: dt.date, last: dt.date, column: str = "date") -> DataFrame:
    return df.filter(F.col(column).between(F.lit(first), F.lit(last)))
