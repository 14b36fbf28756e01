"""Open incidents of one area: the small state of the arrival-order matcher, batch and streaming."""

from __future__ import annotations

SOFT = {"unknown", "other"}


def _unknown(types: list[str]) -> bool:
    joined = " | ".join(types).strip().lower()
    return joined in ("", "unknown", "unknown area") or joined.startswith("unknown ")


class OpenIncidents:
    """Incidents that a candidate dated within ``days`` after them can still join.

    The incident date is fixed at insertion; a merge adds types and renews the update position. A candidate joins
    the last updated incident that shares a type with it, so of a day only the last one of each type is kept: others can
    never be reached again. Soft types, which a merge takes away, keep all their incidents. State and work are thus bounded by
    days and types, however many candidates there are.
    """

    def __init__(self, days: int, rows: list[dict] = (), clock: int = 0):
        self.days, self.clock = days, clock
        self.by_type: dict[int, dict[str, dict]] = {}
        self.soft: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: r["updated"]):
            self._keep(r)

    def _keep(self, r: dict) -> None:
        for t in {t.lower() for t in r["types"]} - SOFT:
            self.by_type.setdefault(r["day"], {})[t] = r
        if _unknown(r["types"]) or {t.lower() for t in r["types"]} & SOFT:
            others = [x for x in self.soft.get(r["day"], ()) if x is not r]
            self.soft[r["day"]] = [*others, r]

    def _of_day(self, day: int) -> list[dict]:
        """What is kept of a day, the last updated first."""
        found = {r["id"]: r for r in [*self.by_type.get(day, {}).values(), *self.soft.get(day, ())]}
        return sorted(found.values(), key=lambda r: -r["updated"])

    def rows(self) -> list[dict]:
        return [r for day in {*self.by_type, *self.soft} for r in self._of_day(day)]

    def _sharing(self, day: int, types: set[str]) -> dict | None:
        """The last updated incident of a day that shares a type."""
        index = self.by_type.get(day, {})
        found = [index[t] for t in types if t in index]
        if types & SOFT:
            found += [r for r in self.soft.get(day, ()) if types & {t.lower() for t in r["types"]}]
        return max(found, key=lambda r: r["updated"], default=None)

    def place(self, cand_id: int, day: int, types: list[str]) -> tuple[int, bool]:
        """Incident id for the candidate, and whether it is a new one."""
        self.clock += 1
        lowered, near = {t.lower() for t in types}, range(day, day - self.days - 1, -1)
        hit = next((r for d in near if (r := self._sharing(d, lowered))), None)
        if hit is None and _unknown(types):
            hit = next((rows[0] for d in near if (rows := self._of_day(d))), None)
        elif hit is None:
            hit = next((r for d in near for r in reversed(self.soft.get(d, ())) if _unknown(r["types"])), None)
        if hit is None:
            self._keep({"id": cand_id, "day": day, "types": list(types), "updated": self.clock})
            return cand_id, True
        union = [t for t in dict.fromkeys([*hit["types"], *types]) if t not in SOFT]
        hit["types"] = union or hit["types"] or types or ["other"]
        hit["updated"] = self.clock
        self.soft[hit["day"]] = [r for r in self.soft.get(hit["day"], ()) if r is not hit]
        self._keep(hit)
        return hit["id"], False

    def expire(self, before_day: int) -> None:
        """Forget incidents that no candidate dated ``before_day`` or later can reach."""
        self.by_type = {d: x for d, x in self.by_type.items() if d + self.days >= before_day}
        self.soft = {d: x for d, x in self.soft.items() if x and d + self.days >= before_day}
