"""Stateful incident matcher: insert-or-update in arrival order on a stream, keyed by area."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sigtide import constants as K
from sigtide.operators.matching import OpenIncidents

OUTPUT = "area string, cand_id bigint, incident_id bigint, inserted boolean"
STATE = "id bigint, day int, types array<string>, updated bigint"


class IncidentMatcher(StatefulProcessor):
    """Keeps the open incidents of one area as list state; forgets those the watermark has passed.

    Within a micro-batch candidates are taken in arrival order (ts, segment, id).
    """

    def __init__(self, days: int = K.MERGE_DAYS):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [{"id": r[0], "day": r[1], "types": list(r[2]), "updated": r[3]} for r in self.open.get()]
        store = OpenIncidents(self.days, kept, max((r["updated"] for r in kept), default=0))
        batch = pd.concat(list(rows)).sort_values(["ts", "seg", "cand_id"])
        placed = [store.place(int(c), int(d), list(t)) for c, d, t in zip(batch["cand_id"], batch["day"], batch["types"])]
        passed = timerValues.getCurrentWatermarkInMs()
        if passed > 0:
            store.expire(passed // 86_400_000)
        self.open.put([(r["id"], r["day"], r["types"], r["updated"]) for r in store.rows()])
        yield pd.DataFrame({"area": key[0], "cand_id": batch["cand_id"].to_numpy(),
                            "incident_id": [p[0] for p in placed], "inserted": [p[1] for p in placed]})

    def close(self) -> None:
        pass


def match_stream(candidates: DataFrame, delay: str = "30 days", days: int = K.MERGE_DAYS) -> DataFrame:
    """Assign streamed candidates (cand_id, area, incident_date, site_types, ts, seg) to incidents.

    ``delay`` is how far back a message may date an incident: older open incidents are forgotten.
    """
    narrow = candidates.select(
        "area", "cand_id", "seg", "ts", F.col("ts").cast("timestamp").alias("event_time"),
        F.unix_date("incident_date").alias("day"), F.array_distinct("site_types").alias("types"))
    return (narrow.withWatermark("event_time", delay).groupBy("area")
            .transformWithStateInPandas(IncidentMatcher(days), OUTPUT, "Append", "EventTime"))
