"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction of identifiers the patterns do not know.

DataFrame expressions only. One pass over the texts keeps, per document, the spans of the fixed patterns and the candidate tokens
(words with a digit or an at sign) with the two words before them. Candidates that are what a fixed pattern takes are the seeds. Then, on
distinct (context, token) edges: a context is good when enough of its tokens are believed, and a token behind a good context is believed,
so that it counts towards other contexts; round after round, until no context is added. Candidates behind good contexts are new spans of
the context's leading kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide.llm.common import fresh, row_key, stored, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Equal in what they match, left to right, to the plain forms in the docstring of ``searches``. Possessive, and bound to start where
#: a run of their first characters starts (or the last match ended), so that no text makes them try a run over and over. A shorter run of
#: digits has no card in it, so the least length stands in the pattern.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A phone or card number, or else a word with a digit or an at sign.
CANDIDATE = rf"(?<![^\x20\x09-\x0D])(?:{PHONE}|{CARD}|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: Tried at the starts of words alone, and possessive, so that a long piece is read a few times at most.
LAST_TWO = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+\z"
SPAN = "array<struct<start:int,stop:int,token:string>>"
#: Numbers that are added up at once; see ``_before``.
STEP = 256


@dataclass(frozen=True)
class Bootstrap:
    """What a context must show: distinct seeds or believed identifiers among its tokens, share of believed tokens, length of an identifier.

    ``rounds`` is a bound on the rounds, for comparison; None goes on until no context is added.
    """

    rounds: int | None = None
    min_seeds: int = 3
    min_share: float = 0.8
    min_length: int = 6


def _before(sizes: Column) -> Column:
    """For each number the sum of those before it. Blocks first, then inside each block: appending within one long array would copy it each time.

    ``sizes`` must be a column of its own, as lambdas read it.
    """
    def running(a: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    count = F.ceil(F.size(sizes) / STEP).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(sizes, b * STEP + 1, F.lit(STEP)))).otherwise(
        F.array().cast("array<array<int>>"))
    starts = running(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)), F.lit(0))
    return F.flatten(F.zip_with(blocks, starts, lambda x, s: running(x, s)))


def located(d: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per pattern an array of (start, stop, token) in code points, under its name; ``<name>_gaps`` has the pieces between. The text goes.

    A pattern comes with a condition that the text must meet to be searched. Places are pieces and matches added up in turn.
    """
    names = list(patterns)
    none = F.array().cast("array<string>")
    keep = [c for c in d.columns if c != "text"]
    d = d.select(*keep, *[x for k, (p, gate) in patterns.items() for x in (
        F.when(gate, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(k), F.when(gate, F.split("text", p, -1)).otherwise(none).alias(f"{k}_gaps"))])
    d = d.withColumns({f"{k}_n": F.zip_with(F.slice(f"{k}_gaps", F.lit(1), F.size(k)), k, lambda g, h: F.length(g) + F.length(h)) for k in names})
    d = d.withColumns({f"{k}_at": _before(F.col(f"{k}_n")) for k in names})
    place = lambda k: F.zip_with(F.zip_with(f"{k}_at", f"{k}_n", lambda a, n: a + n), k, lambda z, h: F.struct(
        (z - F.length(h)).alias("start"), z.alias("stop"), h.alias("token")))
    return d.select(*keep, *[x for k in names for x in (place(k).alias(k), F.col(f"{k}_gaps"))])


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, nines cast out; a sum of tens passes."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda x: x.cast("int"))
    odd = F.filter(F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), lambda d: d.isNotNull())
    return F.aggregate(odd, F.lit(0), lambda s, d: s + d) % 10 == 0


def _size(token: Column) -> Column:
    return F.length(_digits(token))


def _is_card(token: Column) -> Column:
    return F.when(_size(token).between(14, 19), _luhn(_digits(token))).otherwise(F.lit(False))


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def searches(text: Column) -> dict[str, tuple[str, Column]]:
    """Per kind its pattern and what a text must have: email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip ``[0-9]+(\\.[0-9]+){3}``;
    card ``[0-9]([ -]?[0-9])+``; phone ``\\+[0-9][ ().0-9-]+[0-9]``."""
    return {"email": (EMAIL, text.contains("@")), "ip": (IP, text.rlike(r"[0-9]\.[0-9]")), "card": (CARD, text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]")),
            "phone": (PHONE, text.contains("+"))}


def passes(kind: str, spans: Column) -> Column:
    """The spans that hold: ip parts are at most 255, a card has 14 to 19 digits and passes Luhn, a phone has 10 to 15 digits."""
    tests = {"ip": lambda s: s["token"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "card": lambda s: _is_card(s["token"]), "phone": lambda s: _size(s["token"]).between(10, 15)}
    return F.filter(spans, tests[kind]) if kind in tests else spans


def _normal(words: Column) -> Column:
    return F.lower(F.regexp_replace(words, r"[0-9]+", "0"))


def _kind(token: Column) -> Column:
    """What a candidate is by the fixed patterns, null if nothing."""
    return (F.when(token.rlike(EMAIL), "email").when(token.rlike(IP), "ip").when(token.rlike(PHONE) & _size(token).between(10, 15), "phone")
            .when(_is_card(token), "card"))


def evidence(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, key, spans (start, rank, kind, stop, token) and cands (start, stop, token, context)."""
    d = docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text")
    d = located(d, searches(F.col("text")) | {"cand": (CANDIDATE, F.col("text").rlike("[0-9@]"))})
    named = F.concat(*[_named(k, i) for i, k in enumerate(KINDS)])

    def candidate(s: Column, gap: Column) -> Column:
        # A token goes without the marks around it; its context is the last two words of the piece before it.
        lead = F.length(F.regexp_extract(s["token"], r"^[^\p{L}\p{N}+]*", 0))
        bare = F.regexp_replace(s["token"], r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
        two = F.regexp_extract(gap, LAST_TWO, 1)
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(bare)).alias("stop"), bare.alias("token"),
                        F.regexp_replace(_normal(two), r"[\x20\x09-\x0D]+", " ").alias("context"))

    cands = F.zip_with("cand", F.slice("cand_gaps", F.lit(1), F.size("cand")), candidate)
    cands = F.filter(cands, lambda c: (F.length(c["token"]) > 0) & (F.length(c["context"]) > 0))
    return d.select("doc_id", "key", F.sort_array(named).alias("spans"), cands.alias("cands"))


def _named(kind: str, rank: int) -> Column:
    return F.transform(passes(kind, F.col(kind)), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                                                s["stop"].alias("stop"), s["token"].alias("token")))


def discover(found: DataFrame, b: Bootstrap = Bootstrap()) -> DataFrame:
    """(key, spans): the identifiers that good contexts show and no fixed pattern does, per distinct document."""
    c = found.select("key", F.explode("cands").alias("c")).select("key", "c.*", _kind(F.col("c.token")).alias("kind"))
    c = stored(c, "candidates")
    edges = stored(c.groupBy("context", "token").agg(F.max("kind").alias("kind")), "edges")
    # What is believed never gets less, and contexts and tokens keep the kind with which they came in: the rounds end, and their order changes nothing.
    tokens = edges.where("kind is not null").select("token", F.col("kind").alias("as_kind"), F.lit(True).alias("counts")).distinct()
    context, done = edges.select("context", F.lit("").alias("as_kind"), F.lit(-1).alias("round")).limit(0), 0
    while b.rounds is None or done < b.rounds:
        seen = edges.select("context", "token").join(tokens, "token", "left")
        votes = [F.count_if(F.col("counts") & (F.col("as_kind") == k)).alias(k) for k in KINDS]
        lead = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("kind")) for k in KINDS])
        good = seen.groupBy("context").agg(F.count("as_kind").alias("believed"), F.count("*").alias("n"), *votes)
        good = good.where((F.col("believed") / F.col("n") >= b.min_share) & (sum(F.col(k) for k in KINDS) >= b.min_seeds))
        good = good.select("context", lead["kind"].alias("as_kind"), F.lit(done).alias("round")).join(context, "context", "left_anti")
        context = stored(context.unionByName(good), "contexts")
        added, done = context.where(F.col("round") == done), done + 1
        if added.isEmpty():
            break
        # Tokens too short for an identifier are believed, but do not count as seeds.
        shown = edges.join(added, "context").groupBy("token").agg(F.max("as_kind").alias("as_kind")).join(tokens, "token", "left_anti")
        tokens = stored(tokens.unionByName(shown.withColumn("counts", F.length("token") >= b.min_length)), "tokens")
    new = c.where(F.col("kind").isNull() & (F.length("token") >= b.min_length)).join(context, "context")
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), "as_kind").cast("int").alias("rank"),
                    F.concat(F.lit("found_"), "as_kind").alias("kind"), "stop", "token")
    return new.groupBy("key").agg(F.sort_array(F.collect_set(span)).alias("more"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """Per document: doc_id, key, base (spans of the fixed patterns) and spans (those and the discovered ones), in order of start.

    A span is (start, rank, kind, stop, token); discovered kinds are called found_<kind>. Null and empty texts have none. Repeated rows
    each get their spans, but count once as evidence, as equal (context, token) edges do. Null ids are ids like others; other columns are
    ignored; an empty table gives an empty result.
    """
    found = stored(evidence(whole_text(docs, id_col, text_col)), "evidence")
    kind = found.schema["spans"].dataType.simpleString()
    d = found.select("doc_id", "key", "spans").join(discover(found, bootstrap), "key", "left")
    more = F.coalesce(F.col("more").cast(kind), F.array().cast(kind))
    return d.select("doc_id", "key", F.col("spans").alias("base"), F.sort_array(F.concat("spans", more)).alias("spans"))


def redacted_text(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap count as one, the first gives the name."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """All rows and columns, with the personal data in the text replaced. A null text stays null."""
    key, = fresh(docs, "key")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spans = personal_data(docs, id_col, text_col, bootstrap).where(F.size("spans") > 0).dropDuplicates(["key"])
    tagged = docs.withColumn(key, row_key(F.col(f"`{id_col}`"), text))
    spans = spans.select(F.col("key").alias(key), F.col("spans").alias(f"{key}_spans"))
    clean = F.when(F.col(f"{key}_spans").isNull(), F.col(f"`{text_col}`")).otherwise(redacted_text(F.col(f"`{text_col}`"), F.col(f"{key}_spans")))
    return tagged.join(spans, key, "left").withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns])
