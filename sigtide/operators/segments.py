"""Event segmentation of messages.

A message is cut with array functions on its own row, so segmentation needs no shuffle at all,
works in a stream, and a very long message costs one row, not one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide.functions import text as tx
from sigtide.functions.detect import Detector


def _join(sentences: Column) -> Column:
    return F.array_join(sentences, " ")


def annotate_sentences(sentences: Column, det: Detector) -> Column:
    """Array of (area, area_event, transition) per sentence: the area named, whether it comes with an event, and whether a transition
    phrase comes with a target. A target is an event, and an event matters only there, so that nothing else is searched for.
    """
    def event(low: Column) -> Column:
        return det.has_target(low) | det.has(low, "primary", "fire") | det.has_explosion(low)

    def one(sentence: Column) -> Column:
        return tx.bind(tx.relower(sentence), lambda low: tx.bind(det.area(low), lambda area: F.struct(
            area.alias("area"),
            (area.isNotNull() & event(low)).alias("area_event"),
            (det.has_target(low) & det.has(low, "transition")).alias("transition"),
        )))
    return F.transform(sentences, one)


def segment_starts(notes: Column) -> Column:
    """0-based positions where a segment begins.

    A sentence after the first begins a segment when it carries an event and either names an area
    that differs from the last one named, or holds a transition phrase and a target.
    """
    zero = F.struct(
        F.lit(None).cast("string").alias("area"), F.lit(0).alias("pos"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, note: Column) -> Column:
        changed = F.coalesce(note["area"] != acc["area"], F.lit(False))
        begins = (acc["pos"] > 0) & ((changed & note["area_event"]) | note["transition"])
        return F.struct(
            F.coalesce(note["area"], acc["area"]).alias("area"),
            (acc["pos"] + 1).alias("pos"),
            F.when(begins, F.concat(acc["starts"], F.array(acc["pos"]))).otherwise(acc["starts"]).alias("starts"),
        )
    return F.aggregate(notes, zero, step, lambda acc: acc["starts"])


def cut(sentences: Column, starts: Column) -> Column:
    """Segment texts between consecutive starts; ``starts`` must be a materialised column."""
    def one(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(sentences))
        return _join(F.slice(sentences, start + 1, end - start))
    return F.transform(starts, one)


def split_events(messages: DataFrame, det: Detector, text: str = "clean", sentences: Column | None = None) -> DataFrame:
    """Add ``segments``: event segments of a cleaned text, or the whole text when none qualifies.

    ``sentences`` are those of the text where they are known already. Where they are null all steps see null and cost nothing. A
    ``filter`` would do the same in principle, but predicates on derived columns are pushed to the scan with the regex chain copied
    into every reference.
    """
    def qualifies(segment: Column) -> Column:
        return F.exists(
            F.array(tx.relower(segment)), lambda low: det.has_target(low) & det.segment_signal(low))

    return (
        messages
        .withColumn("_sentences", tx.split_sentences(F.col(text), cleaned=True) if sentences is None else sentences)
        .withColumn("_notes", annotate_sentences(F.col("_sentences"), det))
        .withColumn("_starts", segment_starts(F.col("_notes")))
        .withColumn("_parts", F.when(F.size("_sentences") > 1, F.filter(cut(F.col("_sentences"), F.col("_starts")), qualifies)))
        .withColumn("segments", F.when(F.size("_parts") > 0, F.col("_parts"))
                    .when(F.col("_sentences").isNotNull(), F.array(F.col(text))))
        .drop("_sentences", "_notes", "_starts", "_parts")
    )


def to_rows(df: DataFrame, array: str, keep: list[str], pos: str, value: str) -> DataFrame:
    """One row per array element.

    The outer form on purpose: for a plain explode the optimizer adds a size test on the array and
    pushes it, with all the work that builds the array, down to the scan.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def anchored_windows(messages: DataFrame, det: Detector, text: str = "clean") -> DataFrame:
    """Add ``windows``: sentences i-1..i+2 around each anchor i, distinct by lower-cased text.

    Without an anchor the whole text is the one window.
    """
    def anchor(low: Column) -> Column:
        return det.has(low, "primary", "fire", "shutdown") | det.facility(low).isNotNull()

    s = F.col("_sentences")
    at = F.filter(F.transform(s, lambda x, i: F.when(anchor(tx.relower(x)), i)), lambda i: i.isNotNull())
    window = F.transform(F.col("_anchors"), lambda i: _join(
        F.slice(s, F.greatest(i, F.lit(1)), F.least(i + 3, F.size(s)) - F.greatest(i - 1, F.lit(0)))))
    keyed = F.transform(F.col("_windows"), lambda w, i: F.struct(tx.relower(w).alias("low"), i.alias("i"), w.alias("w")))
    sorted_ = F.array_sort(keyed)
    first = F.filter(F.col("_sorted"), lambda w, i: (i == 0) | (w["low"] != F.get(F.col("_sorted"), i - 1)["low"]))
    by_pos = F.array_sort(F.transform(first, lambda w: F.struct(w["i"].alias("i"), w["w"].alias("w"))))
    return (
        messages
        .withColumn("_sentences", tx.split_sentences(F.col(text), cleaned=True))
        .withColumn("_anchors", at)
        .withColumn("_windows", window)
        .withColumn("_sorted", sorted_)
        .withColumn("windows", F.when(F.size("_sentences") == 0, F.array().cast("array<string>"))
                    .when(F.size("_windows") == 0, F.array(F.col(text)))
                    .otherwise(F.transform(by_pos, lambda w: w["w"])))
        .drop("_sentences", "_anchors", "_windows", "_sorted")
    )
