"""Line-first quality rules, in DataFrame expressions only.

Every line is judged on its own: shouting, symbols, navigation, boilerplate, missing punctuation. Failing lines
are removed, and a document that loses too large a share of its characters is rejected. Document-wide measures
(repeated words, lines) come beside it. Everything is array work inside one row: no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide.llm.common import BLANK_RUN, BLANKS, fresh, whole_text

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BOILERPLATE = (
    r"(?i)\b(?:licensed under|all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|use of cookies|"
    r"enable javascript|lorem ipsum|click here|read more|sign up|log in|subscribe now|skip to content|back to top)\b"
)
#: A text that holds none of these words, in small letters, has none of the phrases above.
STOCK_WORDS = ("licensed", "rights res", "policy", "terms of", "cookies", "javascript", "ipsum", "click", "read more", "sign up", "log in",
               "subscribe", "skip to", "back to")
MARKS = r"[!#*$%&|<>/»·•]|::|->"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are of a line's, or a document's, characters."""

    symbols: float = 0.10       # a line with more symbols than this is markup
    marks: float = 0.05         # a line with more exclamation marks than this is shouted
    separators: int = 3         # so many standing separators make a menu
    max_loss: float = 0.5       # a document that loses more than this is rejected
    min_words: int = 20
    repeat_percent: int = 30


SEPARATOR = r"(?<=[\x20\x09])(?:[|>/»·•]|::|->)(?=[\x20\x09])"
WORD = r"[^\x20\x09-\x0D]"
THREE_WORDS = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]"
ENDS = (".", "!", "?", "…", ":", ";", ")", '"', "”", "»", ",")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_RUN), "")


def _heads(a: Column, by: int) -> tuple[Column, Column]:
    """An array without its last, and without its first, ``by`` elements."""
    n = F.greatest(F.size(a) - by, F.lit(0))
    return F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n)


def _doubled(a: Column, by: int) -> Column:
    left, right = _heads(a, by)
    return F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column) -> Column:
    """Positions under windows that occur twice or more: sort (hash, start), keep equal neighbours, add up the cover."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    left, right = _heads(pairs, 1)
    same = F.flatten(F.zip_with(left, right, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))
                                .otherwise(F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(same))


def _judged(text: Column, low: Column, lines: Column, r: Rules, keep: Callable[[Column, Column], Column]) -> Column:
    """The lines for which ``keep``, given whether a line fails and the line, holds. A text without any mark or word of the costlier rules is spared them; ``low``: the text in small letters.

    Markup: too many symbols. Shouting: three words without a small letter, or too many exclamation marks.
    Navigation: standing separators, or one or two words that end no sentence. Boilerplate: a stock phrase.
    """
    def three(x: Column) -> Column:
        return x.rlike(THREE_WORDS)

    def plain(x: Column) -> Column:
        last = F.substring(F.rtrim(x, F.lit(BLANKS)), -1, 1)
        return (~x.rlike(r"\p{Ll}") & x.rlike(r"\p{Lu}") & three(x)) | (~last.isin(*ENDS) & ~three(x))

    def marked(x: Column) -> Column:
        n = F.length(x).cast("double")
        return (plain(x) | (n - F.length(_without(x, SYMBOLS)) > r.symbols * n)
                | ((n - F.length(_without(x, "!")) > r.marks * n) & three(x)) | (F.size(F.split(x, SEPARATOR)) > r.separators))

    stock = reduce(Column.__or__, [low.contains(w) for w in STOCK_WORDS])
    return (F.when(stock, F.filter(lines, lambda x: keep(marked(x) | x.rlike(BOILERPLATE), x)))
            .when(text.rlike(MARKS), F.filter(lines, lambda x: keep(marked(x), x))).otherwise(F.filter(lines, lambda x: keep(plain(x), x))))


def failing(text: Column, low: Column, lines: Column, r: Rules = Rules()) -> Column:
    """The lines that fail."""
    return _judged(text, low, lines, r, lambda fails, line: fails)


def passing(text: Column, low: Column, lines: Column, r: Rules = Rules()) -> Column:
    """The lines that do not fail, and those without a word."""
    return _judged(text, low, lines, r, lambda fails, line: ~fails | ~line.rlike(WORD))


def _with_words(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(WORD))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_share, base_failed, kept.

    One row per input row, repeated rows and null ids included. A null or empty text has no words and fails. Other
    columns are ignored, so their names cannot clash. n_repeat_words compares 64-bit hashes of the windows of one
    document with each other.
    """
    d = whole_text(docs, id_col, text_col)
    d = d.select("doc_id", "text", F.lower("text").alias("low"), _words(F.col("text")).alias("words"), _with_words(F.split("text", "\n", -1)).alias("lines"))
    d = d.select("doc_id", "text", "low", "lines", F.length(F.array_join("words", "")).alias("solid"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    d = d.withColumn("h2", _doubled(F.col("h"), 1))
    d = d.withColumn("h4", _doubled(F.col("h2"), 2))
    d = d.withColumn("h8", _doubled(F.col("h4"), 4))
    d = d.withColumn("starts", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), _covered(F.col("h8"))))
    left, right = _heads(F.col("starts"), 1)
    repeat = F.when(F.col("starts").isNull(), F.lit(0)).otherwise(
        F.aggregate(F.zip_with(left, right, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, x: s + x))
    every = F.length(F.array_join("lines", ""))
    lost = F.length(F.array_join(failing(F.col("text"), F.col("low"), F.col("lines"), rules), ""))
    d = d.select(
        "doc_id", F.size("h").cast("long").alias("n_words"), F.col("solid").cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.when(F.size("lines") > 0, 1 - lost / every).otherwise(F.lit(0.0)).alias("kept_share"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= 1 - rules.max_loss))
    # A later filter on a measure would be pushed to the scan with all that leads to it written out again at each use; it stops at a generator.
    one = F.array(F.struct(*[c for c in d.columns if c != "doc_id"]))
    return d.select("doc_id", F.inline(one))


def _good(docs: DataFrame, text_col: str, rules: Rules) -> DataFrame:
    """The measures of the rows whose document passes, the whole row as ``doc_id``."""
    doc, text = fresh(docs, "doc", "text")
    tagged = docs.withColumns({doc: F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text: F.col(f"`{text_col}`")})
    return quality_rules(tagged, doc, text, rules).where("kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows whose document passes, with all columns and whole texts. A narrow filter: nothing is joined or shuffled."""
    return _good(docs, text_col, rules).select("doc_id.*")


def clean_lines(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows whose document passes, with all columns, the failing lines taken out of their texts.

    Lines without a word stay, and so does a text none of whose lines fails, to the letter. Rejected documents, null and empty texts among them,
    have no row; repeated rows have one each. A line is judged alone, so nothing else fails once these are gone. Narrow like ``keep_good``.
    """
    text = F.col(f"doc_id.`{text_col}`")
    clean = F.when(F.col("kept_share") < 1, F.array_join(passing(text, F.lower(text), F.split(text, "\n", -1), rules), "\n")).otherwise(text)
    return _good(docs, text_col, rules).select(*[(clean if c == text_col else F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])
