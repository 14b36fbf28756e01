"""DuckDB SQL of the queries that SQL can express.

Places of matches: the pieces between the matches and the matches, added up in turn.
"""

from __future__ import annotations

from sigtide.llm.quality_rules import BOILERPLATE, ENDS, SYMBOLS, THREE_WORDS, Rules

_Q = "'"


def _lit(text: str) -> str:
    return "'" + text.replace(_Q, _Q + _Q) + "'"


def _kind(rank: int, kind: str, pattern: str, keep: str = "true") -> str:
    p = _lit(pattern)
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, z - length(m) AS a, z FROM (
  SELECT rid, unnest(ms) AS m, unnest(list_transform(ms, lambda x, i: CAST(list_sum(list_transform(ps[1:i], lambda y: length(y))) + list_sum(list_transform(ms[1:i], lambda y: length(y))) AS BIGINT))) AS z
  FROM (SELECT rid, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS ps FROM docs)) WHERE {keep}"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_FOUND = " UNION ALL ".join([
    _kind(0, "assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, {_lit('^' + _ASSIGN + '([A-Za-z0-9+/_.=-]+)$')}, 1)) >= 8"),
    _kind(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    _kind(2, "hex", "[0-9a-f]+", "length(m) >= 32"),
    _kind(3, "pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    _kind(4, "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
])
_DOCS = "docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"
_JOINED = "coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank){}, '')"

_SECRETS = f"""WITH {_DOCS}, f AS ({_FOUND}),
s AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  {_JOINED.format(' FILTER (rank < 3)')} AS base, {_JOINED.format('')} AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM docs LEFT JOIN s USING (rid)"""

_WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
last AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN last > page_id OR last IS NOT NULL AND page_id IS NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last > page_id OR page_id IS NULL THEN last END AS refers_to FROM d LEFT JOIN last USING (digest)"""

_R = Rules()
_BLANK = r"[\x20\x09-\x0D]+"


def _less(text: str, chars: str) -> str:
    return f"length(regexp_replace({text}, {_lit('[' + chars + ']')}, '', 'g'))"


_QUALITY = f"""WITH {_DOCS}, w AS (SELECT rid, list_filter(string_split_regex(text, {_lit(_BLANK)}), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM r) GROUP BY rid),
l AS (SELECT rid, unnest(ls) AS x FROM w),
t AS (SELECT rid, x, length(x) AS n, regexp_matches(x, {_lit(THREE_WORDS)}) AS three FROM l),
v AS (SELECT rid, n, (NOT regexp_matches(x, '\\p{{Ll}}') AND regexp_matches(x, '\\p{{Lu}}') AND three)
  OR (right(regexp_replace(x, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ({', '.join(map(_lit, ENDS))}) AND NOT three)
  OR n - {_less('x', '#*$%&|<>')} > {_R.symbols} * n OR (n - {_less('x', '!')} > {_R.marks} * n AND three)
  OR len(list_filter(string_split_regex(x, '[\\x20\\x09]')[2:-2], lambda y: y IN ('|', '>', '/', '»', '·', '•', '::', '->'))) >= {_R.separators}
  OR regexp_matches(x, {_lit(BOILERPLATE)}) AS bad FROM t),
k AS (SELECT rid, sum(n) AS n, coalesce(sum(n) FILTER (bad), 0) AS lost FROM v GROUP BY rid),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - {_less('text', SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CASE WHEN k.n > 0 THEN 1 - lost / k.n ELSE 0.0 END AS share
  FROM docs JOIN w USING (rid) LEFT JOIN c USING (rid) LEFT JOIN k USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.repeat_percent} * n_words AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.repeat_percent} * n_words) AND share >= 1 - {_R.max_loss} AS kept FROM a"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PHRASES = f"""WITH pieces AS MATERIALIZED (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT p, lang, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p, lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces)),
g AS MATERIALIZED (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM t WINDOW s AS (PARTITION BY p ORDER BY i)),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS a FROM g GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS a FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING a >= 10),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING a >= 10),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, w1, w2, max(a) AS longest FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
cuts AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.a, 1 AS j, x.a AS l, y.a AS r FROM f2 AS c LEFT JOIN longer AS m USING (lang, w1, w2)
  JOIN f1 AS x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 AS y ON y.lang = c.lang AND y.w1 = c.w2 WHERE NOT coalesce(100 * m.longest >= 50 * c.a, false)
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.a, 1, x.a, y.a FROM f3 AS c
  JOIN f1 AS x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 AS y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.a, 2, x.a, y.a FROM f3 AS c
  JOIN f2 AS x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 AS y ON y.lang = c.lang AND y.w1 = c.w3),
best AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000"""

_REPEATS = f"""WITH {_DOCS}, w AS (SELECT rid, doc_id, list_filter(string_split_regex(text, {_lit(_BLANK)}), lambda x: x <> '') AS w FROM docs),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
later AS (SELECT rid, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) > 1),
gone AS (SELECT rid, list(p) AS ps FROM (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM later) GROUP BY rid),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w)
  ANTI JOIN (SELECT rid, unnest(ps) AS p FROM gone) USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)"""

SQL: dict[str, str] = {"op1_secret_scan": _SECRETS, "op7_warc": _WARC, "op9_quality_rules": _QUALITY, "op11_phrase_collocations": _PHRASES,
                       "op12_substring_dedup": _REPEATS}
