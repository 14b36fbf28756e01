"""Merging candidates into incidents: fold, field diffs, audit rows, upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtide.functions import scoring
from sigtide.functions import text as tx
from sigtide.operators.matching import OpenIncidents
from sigtide.operators.prefix import running_before

FLAGS = ["combined", "defended", "fire", "shutdown", "confirmed"]
TRACKED = ["area", "site_types", "combined", "defended", "fire", "shutdown", "explosions", "confirmed",
           "severity", "confidence", "scale"]


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both frames, the update winning per key; of repeated update keys one row stays.

    What the update replaces leaves by an anti-join, which moves the store only where the update's keys are too many to
    broadcast; null keys are equal to each other.
    """
    cols, new = existing.columns, updates.select(*existing.columns).dropDuplicates(keys)
    gone = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return existing.select(*cols).join(gone, same, "left_anti").unionByName(new)


def candidate_confidence() -> Column:
    return scoring.confidence(F.col("report_type"), F.col("confirmed"), F.col("fire"), F.col("shutdown"),
                              F.col("explosions"), F.col("severity"))


def fold_candidates(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All candidates of one incident folded into one row, as if merged one by one in ``order``.

    Every part of the merge is a plain aggregate (or, max, earliest known value), so a hot incident
    is reduced on the map side and never collected. Types keep first-seen order through their
    earliest position.
    """
    position = F.struct(*order)
    known = ~tx.is_unknown(F.col("area"))
    base = candidates.withColumn("_conf", candidate_confidence()).withColumn("_pos", position)
    flat = base.groupBy(key).agg(
        F.min_by(F.when(known, F.col("area")), F.when(known, F.col("_pos"))).alias("n_area"),
        *[F.bool_or(c).alias(f"n_{c}") for c in FLAGS],
        F.max("explosions").alias("n_explosions"),
        F.max_by("severity", F.struct(scoring.merge_rank(F.col("severity")))).alias("n_severity"),
        F.max("_conf").alias("n_confidence"),
        F.min_by("scale", F.when(F.col("scale").isNotNull(), F.col("_pos"))).alias("n_scale"),
        F.count("*").alias("n_merged"),
    )
    types = (
        base.select(key, "_pos", F.posexplode("site_types").alias("_i", "_type"))
        .groupBy(key, "_type").agg(F.min(F.struct("_pos", "_i")).alias("_first"))
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_first", "_type"))).alias("_ts"))
        .select(key, tx.merge_type_arrays(F.array().cast("array<string>"), F.transform("_ts", lambda t: t["_type"])).alias("n_site_types"))
    )
    return flat.join(types, key, "left")


def merged_columns() -> dict[str, Column]:
    """Merged value of each field from the existing row and the folded candidates (``n_`` columns)."""
    no_types = F.array().cast("array<string>")
    old_area = F.col("area")
    take_area = tx.is_unknown(old_area) & F.col("n_area").isNotNull()
    better = F.coalesce(scoring.merge_rank(F.col("n_severity")) > scoring.merge_rank(F.col("severity")), F.lit(False))
    out = {
        "area": F.when(take_area, F.col("n_area")).otherwise(old_area),
        "site_types": tx.merge_type_arrays(F.coalesce("site_types", no_types), F.coalesce("n_site_types", no_types)),
        "explosions": F.greatest(F.coalesce("explosions", F.lit(0)), F.coalesce("n_explosions", F.lit(0))),
        "severity": F.when(better, F.col("n_severity")).otherwise(F.col("severity")),
        "confidence": F.greatest(F.coalesce("confidence", F.lit(50)), F.col("n_confidence")),
        "scale": F.coalesce("scale", "n_scale"),
    }
    for c in FLAGS:
        out[c] = F.coalesce(c, F.lit(False)) | F.coalesce(f"n_{c}", F.lit(False))
    return out


def _text(field: str, c: Column) -> Column:
    return tx.join_pipe(F.array_sort(c)) if field == "site_types" else c.cast("string")


def merge_into(existing: DataFrame, folded: DataFrame) -> DataFrame:
    """Existing incidents with folded candidates applied, plus ``diffs`` (field, old, new).

    Site types compare as sorted lists. No difference means the row stays as it was.
    """
    joined = existing.join(folded, "incident_id")
    new = merged_columns()
    pairs = [F.struct(F.lit(f).alias("field"), _text(f, F.col(f)).alias("old_value"), _text(f, new[f]).alias("new_value"))
             for f in TRACKED]
    diffs = F.filter(F.array(*pairs), lambda d: ~d["old_value"].eqNullSafe(d["new_value"]))
    keep = [c for c in existing.columns if c not in new]
    return joined.select(*keep, *[c.alias(f) for f, c in new.items()], diffs.alias("diffs"))


def audit_rows(merged: DataFrame) -> DataFrame:
    return merged.select("incident_id", F.explode("diffs").alias("d")).select("incident_id", "d.*")


def apply_updates(existing: DataFrame, merged: DataFrame, updated_at: Column) -> DataFrame:
    """Incident table after the update: changed rows replaced and stamped, the rest untouched."""
    changed = (merged.filter(F.size("diffs") > 0).drop("diffs").withColumn("updated_at", updated_at)
               .select(*existing.columns))
    return upsert(existing, changed, ["incident_id"])


def apply_corrections(parsed: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Reviewed values replace parsed ones; rows marked ``skip`` drop."""
    fields = [c for c in corrections.columns if c not in (*keys, "skip")]
    edits = corrections.select(*keys, "skip", *[F.col(c).alias(f"_e_{c}") for c in fields])
    return (
        parsed.join(edits, keys, "left").filter(~F.coalesce("skip", F.lit(False)))
        .withColumns({c: F.coalesce(f"_e_{c}", c) for c in fields})
        .drop("skip", *[f"_e_{c}" for c in fields])
    )


# ── arrival-order insert or update ────────────────────────────────────────────

def date_islands(candidates: DataFrame, days: int = 2) -> DataFrame:
    """Add ``island``: dates of an area with no gap above ``days`` between neighbours.

    Candidates of different islands can never meet. Built on the distinct (area, date) pairs, so the
    window holds one row per calendar day.
    """
    w = Window.partitionBy("area").orderBy("incident_date")
    gap = F.coalesce(F.datediff("incident_date", F.lag("incident_date").over(w)) > days, F.lit(True))
    marks = (
        candidates.select("area", "incident_date").distinct()
        .withColumn("_gap", gap)
        .withColumn("island", F.sum(F.col("_gap").cast("int")).over(w))
        .drop("_gap")
    )
    return candidates.join(marks, ["area", "incident_date"])


def assign_incidents(candidates: DataFrame, days: int = 2) -> DataFrame:
    """Insert-or-update in arrival order: which incident each candidate ends up in.

    Order matters here, since a merge changes the types later candidates match on, so the fold itself
    is sequential per (area, island). Only four narrow columns take part. They stream through sorted
    partitions and the open incidents of the last days are the only state, so a hot area is never
    held in memory; all field merging happens afterwards in ``fold_candidates``, in parallel.
    Columns: cand_id, area, incident_date, site_types, ts, seg.
    """
    narrow = date_islands(candidates, days).select(
        "area", "island", F.unix_date("incident_date").alias("day"),
        F.struct("ts", "seg", "cand_id").alias("pos"), "cand_id",
        tx.distinct_types(F.col("site_types")).alias("types"))
    placed = (narrow.repartition("area", "island").sortWithinPartitions("area", "island", "pos")
              .select("area", "island", "day", "cand_id", "types"))

    def fold(batches):
        key, store = None, OpenIncidents(days)
        for pdf in batches:
            ids, isnew = [], []
            for area, island, day, cand, types in zip(pdf["area"], pdf["island"], pdf["day"], pdf["cand_id"], pdf["types"]):
                if (area, island) != key:
                    key, store = (area, island), OpenIncidents(days)
                incident, inserted = store.place(cand, int(day), list(types))
                ids.append(incident)
                isnew.append(inserted)
            yield pd.DataFrame({"cand_id": pdf["cand_id"], "incident_id": ids, "inserted": isnew})

    return placed.mapInPandas(fold, "cand_id bigint, incident_id bigint, inserted boolean")


def running_audit(assigned: DataFrame) -> DataFrame:
    """Audit rows of the arrival-order merge for every tracked field; the area never changes, as candidates match within one.

    The state before each candidate comes from the earlier ones of its incident: running maxima hour by hour for flags, numbers,
    severity and the first known scale, and for types the position at which each first came up.
    """
    conf = F.when(F.col("inserted"), F.col("confidence")).otherwise(candidate_confidence())
    fields, order = [*FLAGS, "explosions", "confidence"], ["ts", "seg", "cand_id"]
    rank = F.struct(scoring.merge_rank(F.col("severity")).alias("rank"), "severity")
    early = F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), (-F.col("seg")).alias("s"), (-F.col("cand_id")).alias("c"), "scale")
    base = assigned.withColumns({"confidence": conf, "_pos": F.struct(*order), "_rank": rank, "_early": F.when(F.col("scale").isNotNull(), early)})
    ran = running_before(base, ["incident_id"], F.date_trunc("hour", "ts"), order,
                         {**{f"_old_{c}": (F.max, F.col(c)) for c in fields}, "_old_rank": (F.max, F.col("_rank")), "_old_early": (F.max, F.col("_early"))})
    firsts = (base.select("incident_id", "_pos", F.posexplode("site_types").alias("_i", "_type"))
              .groupBy("incident_id", "_type").agg(F.min(F.struct("_pos", "_i")).alias("_at"))
              .groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_type"))).alias("_firsts")))
    ran = ran.filter(~F.col("inserted")).join(firsts, "incident_id", "left")
    none = F.array().cast("array<string>")
    seen = F.transform(F.filter("_firsts", lambda t: t["_at"]["_pos"] < F.col("_pos")), lambda t: t["_type"])
    old_types = tx.merge_type_arrays(none, F.coalesce(seen, none))
    old_scale = F.col("_old_early.scale")
    worse = F.col("_rank.rank") > F.col("_old_rank.rank")
    values = {c: (F.col(f"_old_{c}"), F.greatest(f"_old_{c}", c)) for c in fields} | {
        "severity": (F.col("_old_rank.severity"), F.when(worse, F.col("severity")).otherwise(F.col("_old_rank.severity"))),
        "scale": (old_scale, F.coalesce(old_scale, "scale")),
        "site_types": (old_types, tx.merge_type_arrays(old_types, F.coalesce("site_types", none))),
    }
    pairs = [F.struct(F.lit(c).alias("field"), _text(c, old).alias("old_value"), _text(c, new).alias("new_value")) for c, (old, new) in values.items()]
    return (ran.select("incident_id", "cand_id", F.explode(F.array(*pairs)).alias("d"))
            .filter(~F.col("d.old_value").eqNullSafe(F.col("d.new_value")))
            .select("incident_id", "cand_id", "d.*"))
