"""Detectors over lower-cased text, compiled from a rule pack to column expressions.

Each method takes the lower-cased text column, so the same expression serves whole messages, and
sentences or segments inside a ``transform`` lambda.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtide.functions import text as tx
from sigtide.rules import RulePack


class Detector:
    """``known``: what the whole message holds of a dictionary (``operators.gazetteer``); it then stands for the pack's aliases and sites."""

    def __init__(self, pack: RulePack, known: Column | None = None):
        self.pack, self.known = pack, known

    def _held(self, low: Column, kind: str) -> Column:
        """The dictionary entries of the message that this part of it holds, in their order."""
        return F.filter(self.known[kind], lambda k: low.contains(k["pattern"]))

    def has(self, low: Column, *groups: str) -> Column:
        return tx.any_of(low, [p for g in groups for p in self.pack.group(g)])

    # ── message and segment filters ───────────────────────────────────────────
    def fast_reject(self, low: Column) -> Column:
        return self.has(low, "fundraising", "subscription", "editorial", "summary")

    def skip_segment(self, low: Column) -> Column:
        return self.has(low, "editorial", "summary", "outbound")

    def in_scope(self, low: Column) -> Column:
        known = F.lit(False) if self.known is None else F.exists(self.known["areas"], lambda k: low.contains(k["pattern"]))
        for alias, _ in self.pack.ordered_aliases():
            known = known | low.contains(alias)
        return ~self.has(low, "out_of_scope") | known

    # ── places and sites ──────────────────────────────────────────────────────
    def area(self, low: Column) -> Column:
        if self.known is not None:
            return F.get(self._held(low, "areas"), F.lit(0))["label"]
        return tx.lookup_longest(low, self.pack.ordered_aliases())

    def macro_area(self, area: Column) -> Column:
        return tx.first_match(area, [(a, m) for a, m, _ in self.pack.areas], lambda c, a: c == a)

    def facility(self, low: Column) -> Column:
        return tx.first_match(low, self.pack.facility)

    def has_target(self, low: Column) -> Column:
        patterns = [p for _, _, ps in self.pack.sites for p in ps] + [p for p, _ in self.pack.facility]
        named = F.lit(False) if self.known is None else F.exists(self.known["sites"], lambda k: low.contains(k["pattern"]))
        return named | tx.any_of(low, patterns)

    def targets(self, low: Column) -> Column:
        """Array of (label, type): every named site that matches, else one generic facility, else empty."""
        named, seen = [], set()
        for label, kind, patterns in self.pack.sites:
            if label in seen:
                continue
            seen.add(label)
            every = [p for n, k, ps in self.pack.sites if n == label and k == kind for p in ps]
            entry = F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"))
            named.append(F.when(tx.any_of(low, every), entry))
        found = F.array_compact(F.array(*named))
        if self.known is not None:
            own = F.filter(self._held(low, "sites"), lambda k: k["named"])
            found = F.array_distinct(F.transform(own, lambda k: F.struct(k["label"].alias("label"), k["type"].alias("type"))))

        def generic(kind: Column) -> Column:
            pretty = F.coalesce(
                tx.first_match(kind, list(self.pack.type_labels.items()), lambda c, k: c == k), F.lit("Unknown Facility"))
            area = self.area(low)
            label = F.concat(F.lit("Unknown "), pretty, F.coalesce(F.concat(F.lit(" ("), area, F.lit(")")), F.lit("")))
            one = F.array(F.struct(label.alias("label"), kind.alias("type")))
            return F.when(kind.isNotNull(), one).otherwise(F.array().cast("array<struct<label: string, type: string>>"))

        return tx.bind(found, lambda f: F.when(F.size(f) > 0, f).otherwise(tx.bind(self.facility(low), generic)))

    # ── signals ───────────────────────────────────────────────────────────────
    def explosions(self, low: Column) -> Column:
        """The largest of the words counted and the numbers read; a number that no BIGINT holds takes no part."""
        count = tx.count_matches(low, self.pack.group("explosion")).cast("bigint")
        floor = [F.coalesce(tx.capture_number(low, p), F.lit(0)) for p in self.pack.group("explosion_number")]
        several = F.when(self.has(low, "explosion_several"), 3).otherwise(0)
        many = F.when(self.has(low, "explosion_many"), 5).otherwise(0)
        return F.greatest(count, *floor, several, many)

    def has_explosion(self, low: Column) -> Column:
        """``explosions > 0`` without counting, for the places that only ask whether."""
        positive = F.lit(False)
        for p in self.pack.group("explosion_number"):
            positive = positive | (F.coalesce(tx.capture_number(low, p), F.lit(0)) > 0)
        return self.has(low, "explosion", "explosion_several", "explosion_many") | positive

    def attack_type(self, low: Column) -> Column:
        drone, missile = self.has(low, "drone"), self.has(low, "missile")
        return F.when(drone & missile, "both").when(missile, "missile").when(drone, "drone").otherwise("unknown")

    def report_type(self, low: Column) -> Column:
        return (F.when(self.has(low, "correction"), "correction")
                 .when(self.has(low, "update_only"), "aftermath")
                 .when(self.has(low, "official"), "official").otherwise("hearsay"))

    def confirmed(self, low: Column) -> Column:
        return self.has(low, "direct_hit", "fire", "shutdown") | self.has_explosion(low)

    def severity(self, low: Column) -> Column:
        return F.when(self.has(low, "damage_high"), "high").when(self.has(low, "damage_medium"), "medium").otherwise("low")

    def followup_only(self, low: Column) -> Column:
        return self.has(low, "followup") & ~(self.has(low, "fire", "shutdown", "defence") | self.has_explosion(low))

    def numbers(self, low: Column) -> Column:
        found = [tx.capture_numbers(low, self.pack.group("unit_number"))]
        unit = "|".join(self.pack.group("unit"))
        with_unit = tx.any_of(low, self.pack.group("unit")) if unit else F.lit(True)
        for word, value in self.pack.number_words.items():
            hit = with_unit & low.contains(word) & low.rlike(f"(^|[^a-z]){word}[^a-z]*(?:{unit})")
            found.append(F.when(hit, F.array(F.lit(value).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
        several = F.when(self.has(low, "several"), F.array(F.lit(3).cast("bigint")))
        found.append(several.otherwise(F.array().cast("array<bigint>")))
        return F.concat(*found)

    def scale(self, low: Column) -> Column:
        """Bucket of the largest number; one too large to hold is over every limit."""
        def bucket(top: Column) -> Column:
            return (F.when(top >= 15, "massive").when(top >= 5, "swarm").when(top >= 1, "few")
                     .when(self.has(low, "update_only"), F.lit(None).cast("string"))
                     .when(self.has(low, "drone"), "few"))
        return tx.bind(F.array_max(F.transform(self.numbers(low), lambda n: F.coalesce(n, F.lit(15)))), bucket)

    def has_event(self, low: Column) -> Column:
        """Sentence carries event content of any kind."""
        return self.has_target(low) | self.has(low, "primary", "fire", "shutdown") | self.has_explosion(low)

    def segment_signal(self, low: Column) -> Column:
        return self.has(low, "primary", "defence") | self.confirmed(low)

    def combined(self, low: Column, n_targets: Column, matched: Column) -> Column:
        """Stand-alone combined-strike rule: several targets, a matched incident, or both attack types."""
        return (n_targets > 1) | matched | (self.attack_type(low) == "both")

    def candidate(self, low: Column) -> Column:
        attack = self.has(low, "primary", "context")
        return (~self.followup_only(low) & ~self.skip_segment(low) & self.in_scope(low)
                & self.has_target(low) & (attack | self.confirmed(low)))
