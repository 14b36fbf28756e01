"""Rule pack: the lexicon, gazetteer and area hierarchy that drive detection.

The engine treats these as input. ``demo_pack`` is a small synthetic pack fitted to the
invented prose of the fixture corpus; a user loads their own with ``RulePack.from_tables``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

MAX_RULE_ROWS = 5_000


@dataclass(frozen=True)
class RulePack:
    gazetteer: list[tuple[str, str, int]]            # alias, area, prio
    areas: list[tuple[str, str, int]]                # area, macro_area, reach_score
    groups: dict[str, list[str]]                     # rule group -> patterns
    facility: list[tuple[str, str]]                  # pattern -> site type, in priority order
    sites: list[tuple[str, str, list[str]]]          # label, site type, patterns
    type_labels: dict[str, str] = field(default_factory=dict)
    months: dict[str, int] = field(default_factory=dict)
    number_words: dict[str, int] = field(default_factory=dict)

    def group(self, name: str) -> list[str]:
        return self.groups.get(name, [])

    def ordered_aliases(self) -> list[tuple[str, str]]:
        """Longest alias first; equal lengths keep the gazetteer priority."""
        return [(a, area) for a, area, _ in sorted(self.gazetteer, key=lambda g: (-len(g[0]), g[2]))]

    @classmethod
    def from_tables(cls, rules: DataFrame, gazetteer: DataFrame, areas: DataFrame, **extra) -> "RulePack":
        """Build a pack from (rule_group, pattern, label, prio), (alias, area, prio) and area tables.

        Rules become literals of the plan, so their number is checked; message data never comes here.
        """
        def small(df: DataFrame, *cols: str) -> list:
            rows = df.select(*cols).orderBy(*cols).limit(MAX_RULE_ROWS + 1).collect()
            if len(rows) > MAX_RULE_ROWS:
                raise ValueError(f"rule table has more than {MAX_RULE_ROWS} rows")
            return rows

        groups: dict[str, list[str]] = {}
        facility: list[tuple[int, str, str]] = []
        sites: dict[tuple[int, str, str], list[str]] = {}
        for prio, group, pattern, label in small(rules, "prio", "rule_group", "pattern", "label"):
            if group == "facility":
                facility.append((prio, pattern, label))
            elif group.startswith("site:"):
                sites.setdefault((prio, label, group[len("site:"):]), []).append(pattern)
            else:
                groups.setdefault(group, []).append(pattern)
        return cls(
            gazetteer=[tuple(r) for r in small(gazetteer, "alias", "area", "prio")],
            areas=[tuple(r) for r in small(areas, "area", "macro_area", "reach_score")],
            groups=groups,
            facility=[(p, t) for _, p, t in sorted(facility)],
            sites=[(label, kind, pats) for (_, label, kind), pats in sorted(sites.items())],
            **extra,
        )


def demo_pack() -> RulePack:
    return RulePack(
        gazetteer=[
            ("thatin", "Northfield", 1), ("hehely", "Eastport", 2), ("orantion", "Southmere", 3),
            ("ononst", "Westvale", 4), ("rewh", "Highmoor", 5), ("orre", "Lowmoor", 6),
            ("thorre", "Lakeside", 7), ("schst", "Steinfurt", 8), ("eaule", "Belleville", 9),
            ("menteci", "Villanueva", 10), ("ouha", "Riverside", 11), ("whing", "Midland", 12),
        ],
        areas=[
            ("Northfield", "North", 1), ("Highmoor", "North", 1), ("Eastport", "East", 2),
            ("Riverside", "East", 2), ("Southmere", "South", 3), ("Villanueva", "South", 3),
            ("Westvale", "West", 4), ("Belleville", "West", 4), ("Steinfurt", "Central", 5),
            ("Lakeside", "Central", 5), ("Lowmoor", "Central", 5),
        ],
        groups={
            "fundraising": ["token ="],
            "subscription": ["licen[cs]e", "http"],
            "editorial": ["@", "copyright"],
            "summary": ["!!"],
            "outbound": ["tirest", "auverk"],
            "out_of_scope": ["anou", "gung"],
            "primary": ["ndst", "leeau", "chver"],
            "context": ["ithe", "eauen", "nicht"],
            "fire": ["blest", "queau", "chste"],
            "explosion": ["ntsh", "ntsh[aeiou]", "euxle"],
            "explosion_number": ["over ([0-9]+)", "[+]([0-9]+)"],
            "explosion_several": ["erend"],
            "explosion_many": ["onlyth"],
            "defence": ["wher", "adoci"],
            "shutdown": ["hatst", "keitein"],
            "direct_hit": ["ingst", "tionle"],
            "missile": ["lyst"],
            "drone": ["herst", "atnd"],
            "correction": ["thingor"],
            "update_only": ["shere", "ofthe"],
            "official": ["esha", "pour"],
            "damage_high": ["shou", "nicht"],
            "damage_medium": ["erth", "mente", "blest"],
            "followup": ["thest", "dans"],
            "transition": ["(^|[^a-z])and([^a-z]|$)", "(^|[^a-z])und([^a-z]|$)", "nder"],
            "unit_number": ["([0-9]+) [a-z]", "with ([0-9]+)"],
            "unit": ["herst", "atnd"],
            "several": ["erend"],
            "night_of": ["in the night of "],
            "yesterday": ["edble"],
            # daily signal groups
            "sig_mention": ["herst", "atnd"],
            "sig_defence": ["wher", "adoci", "ndst"],
            "sig_transit": ["edble"],
            "sig_uncertain": ["thest", "dans"],
            "sig_official": ["esha", "pour"],
            "sig_facility": ["erth", "mente", "schein"],
            "sig_attack": ["ndst", "leeau", "blest", "ntsh"],
            "sig_site": ["thing", "eaule"],
            "sig_broad": ["ndst", "lyst", "chver", "eauen"],
            "sig_cross": ["rewh.{0,12}nd", "orre.{0,8}th"],
        },
        facility=[
            ("thing", "depot"), ("ation", "line"), ("erth", "plant"), ("eaule|euxle", "grid"),
            ("schein", "works"), ("menteci", "hub"),
        ],
        sites=[
            ("Alpha Depot", "depot", ["thingor", "ingth"]),
            ("Beta Plant", "plant", ["enerth", "onerth"]),
            ("Gamma Grid", "grid", ["queaule", "tioneux"]),
            ("Delta Hub", "hub", ["adoci"]),
            ("Epsilon Works", "works", ["chver"]),
        ],
        type_labels={
            "depot": "Depot", "line": "Line", "plant": "Plant", "grid": "Grid", "works": "Works", "hub": "Hub",
        },
        months={"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7,
                "august": 8, "september": 9, "october": 10, "november": 11, "december": 12},
        number_words={"one": 1, "two": 2, "three": 3, "five": 5, "ten": 10, "twenty": 20},
    )
