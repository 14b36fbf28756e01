"""Personal data against plain regular expressions, discovery on planted contexts, and redaction."""

import random
import re

from sigtide.llm import pii

from .helpers import ROWS, awkward, empty

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    x = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 if v > 9 else v for v in x) % 10 == 0


def slow(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d or "1"),
                    "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, z) for a, _, kind, z in sorted(out)]


def base(df):
    return {r.doc_id: [(s.kind, s.start, s.stop) for s in r.base] for r in df.collect()}


def fuzz(n):
    rng = random.Random(8)
    bits = ["a@b.c", "a@b.c_d@e.f", "@", ".", "1.2.3.4.5.6.7.8", "255.0.001.9", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+1 (375) 555-4393",
            "+12", "+", "é😀", " ", "\n", "0", "7", "-", " 5", "x", "%", "a.b+c@d-e.f.g", "(", ")", "30569309025904", "6011000990139424 0", "00000000000000", "١٢٣"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_documents_and_fuzz(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(1_000_000 + i, t) for i, t in enumerate(fuzz(3000))]
    got = pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        kept = [(s.kind, s.start, s.stop) for s in r.spans]
        assert [s for s in kept if s[0] in PATTERNS] == [(s.kind, s.start, s.stop) for s in r.base]
    found = base(got)
    for i, t in docs:
        assert found[i] == slow(t), t


def test_long_runs_do_not_hang(spark):
    texts = ["a" * 200_000, "a.b-" * 50_000, "1" * 200_000, "1.2." * 50_000, "+1" + " " * 200_000, "1 " * 100_000, "a@" * 50_000, "x@" + "y." * 50_000, "é1 " * 3000]
    got = base(pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)))
    assert len(got) == len(texts) and all(not got[i] for i in (0, 1, 2, 6, 8))


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    known = [(i, f"{word()} {word()} please reach {word()}{i}@mail.example {word()}.") for i in range(40)]
    new = [(100 + i, f"{word()} please reach user{i}-at-mail {word()} {word()}.") for i in range(5)]
    other = [(200 + i, f"{word()} about page number{i}x {word()} {word()}.") for i in range(20)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(known + new + other, "doc_id long, text string")).collect()}
    for i, t in new:
        assert [(s.kind, t[s.start:s.stop]) for s in got[i].spans] == [("found_email", f"user{i - 100}-at-mail")]
        assert not got[i].base
    assert all(not got[i].spans for i, _ in other)
    assert all([s.kind for s in got[i].spans] == ["email"] for i, _ in known)


def test_discovered_identifiers_open_further_contexts(spark):
    """A chain: seeds, a context, new tokens, a context of these alone, new tokens, ... over more rounds than three."""
    size, leads = [256, 64, 16, 4, 1], ["please reach", "kindly contact", "or else", "failing which"]
    token = lambda g, i: f"u{i}@mail{i}.example" if g == 0 else f"user{g}x{i}-at-mail"
    rows = [f"we say {lead} {token(g + d, i)} today." for g, lead in enumerate(leads) for d in (0, 1) for i in range(size[g + d])]
    rows += [f"we say about page number{i}x today." for i in range(20)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, t in enumerate(rows):
        want = [] if "about page" in t else [("email" if "@" in t else "found_email", t.split()[4].rstrip("."))]
        assert [(s.kind, t[s.start:s.stop]) for s in got[i].spans] == want, t


def test_contexts_are_whole_words_however_long(spark):
    far, last = "thanks " + "reach" * 30, "a" * 60 + " " + "b" * 60
    rows = [f"we {far} u{i}@mail.example" for i in range(8)] + [f"we {far} user{i}-at-mail" for i in range(2)]
    rows += [f"we x{last} u{i}@mail.example" for i in range(8)] + [f"we y{last} user{i}-at-home" for i in range(2)]
    long = ["a " * 100_000 + "1", "a" * 200_000 + " 1", "a" + " " * 200_000 + "1", "a" * 100_000 + " " + "b" * 100_000 + "  1", "1 " + "a b " * 50_000]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows + long)), "doc_id long, text string")).collect()}
    assert [[s.kind for s in got[i].spans] for i in range(20)] == [["email"]] * 8 + [["found_email"]] * 2 + [["email"]] * 8 + [[]] * 2
    assert not any(got[20 + i].spans for i in range(len(long)))


def test_redaction(spark):
    rows = [(1, "é mail a.b@c.de or 10.0.0.1, +1 (375) 555-4393."), (2, "nothing here"), (3, None), (3, None), (None, "x y@z.com"), (4, "4111 1111 1111 1111")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'q' as `key`", "1 as spans")
    got = pii.redact(d)
    assert got.columns == d.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted([
        (1, "é mail [EMAIL] or [IP], [PHONE]."), (2, "nothing here"), (3, ""), (3, ""), (-1, "x [EMAIL]"), (4, "[CARD]")])


def test_awkward_rows(spark):
    got = pii.personal_data(awkward(spark))
    assert got.count() == len(ROWS) and got.where("size(spans) > 0").count() == 0
    assert pii.redact(awkward(spark)).count() == len(ROWS)
    assert pii.personal_data(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_plan_has_no_python(spark, sf):
    for df in (pii.personal_data, pii.redact):
        plan = df(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
