"""The operators' queries as DuckDB SQL, where SQL can say what they do.

Packing, line dedup, mixing, neighbours, licences and the pipeline depend on
byte-pair ids, words' rarity, trained models or an index, and sharding's checksum has no
function there; they are tested against brute force, exact round trips and held-out
accuracy instead.
"""

from __future__ import annotations

from risklens.llm.quality import BAR, BAR_MARKS, BOILERPLATE, ENDINGS, MARKED, NAVIGATION, LineRules

_SPACE = "[ \\t\\n\\x0B\\f\\r]"
_WORD = "[^ \\t\\n\\x0B\\f\\r]"
_RULES = LineRules()


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _quality() -> str:
    phrases = " OR ".join(f"contains(low, {_text(p)})" for p in BOILERPLATE)
    endings = ", ".join(_text(e) for e in ENDINGS)
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '')) AS word,
 generate_subscripts(list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> ''), 1) AS i FROM d),
g AS (SELECT r, i, concat_ws(chr(1), word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS k,
 lead(word, 4) OVER o IS NOT NULL AS five FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (
 SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g WHERE five) WHERE c > 1),
rep AS (SELECT r, sum(least(coalesce(nxt - i, 5), 5)) AS n FROM twice GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
s AS (SELECT r, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l WHERE regexp_matches(line, '{_WORD}')),
j AS (SELECT *, lower(bare) AS low, len(string_split_regex(bare, '{_SPACE}+')) AS nw FROM s),
v AS (SELECT *, length(regexp_replace(bare, '{_SPACE}', '', 'g')) AS chars, right(bare, 1) IN ({endings})
 AND len(regexp_extract_all(bare, {_text(MARKED)})) * 100 <= nw * {_RULES.marked_pct}
 AND NOT (nw <= {_RULES.short_words} AND (regexp_matches(low, {_text(NAVIGATION)}) OR len(regexp_extract_all(bare, {_text(BAR)})) >= {_RULES.bar_marks}))
 AND NOT ({phrases}) AS good FROM j),
a AS (SELECT r, sum(chars) AS word_chars, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (NOT good) AS gone,
 coalesce(sum(chars) FILTER (good), 0) AS kept_chars FROM v GROUP BY r),
n AS (SELECT r, count(*) AS n FROM w GROUP BY r),
b AS (SELECT d.doc_id, coalesce(n.n, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 coalesce(gone, 0) AS n_lines_removed, coalesce(kept_chars, 0) AS kept_chars FROM d LEFT JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN a USING (r)),
f AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_pct} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND kept_chars * 100 >= word_chars * {_RULES.min_kept_pct} AS kept, n_lines_removed, kept_chars FROM f"""


_CHAT = """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER o AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t
 WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST)),
c AS (SELECT *, md5(concat(coalesce(md5(role), '-'), coalesce(md5(text), '-'))) AS h FROM p),
x AS (SELECT conv_id, position, n_turns, string_agg(h, '' ORDER BY position) OVER (PARTITION BY conv_id ORDER BY position) AS pre FROM c),
whole AS (SELECT conv_id, pre FROM x WHERE position = n_turns),
shorter AS (SELECT DISTINCT pre FROM x WHERE position < n_turns),
keep AS (SELECT min(conv_id) AS conv_id FROM whole WHERE pre NOT IN (SELECT pre FROM shorter) GROUP BY pre)
SELECT p.conv_id, position, n_turns, role,
 concat('<|', coalesce(role, 'unknown'), '|>', chr(10), coalesce(text, ''), '<|end|>', chr(10)) AS rendered FROM p JOIN keep USING (conv_id)"""


_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)),
q AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1 AS again FROM w),
r AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM q WHERE again),
g AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
i AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY 1, 2),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM i),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
 string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(concat(coalesce(head, ''), substr(x, 2 * coalesce(tail, 0) + 1)))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


_JOIN = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], chr(1)) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, bit_xor(hash(k)) AS h FROM s GROUP BY doc_id),
same AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, h) AS rep FROM n),
one AS (SELECT s.doc_id, k FROM s JOIN same USING (doc_id) WHERE same.doc_id = rep),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM one a JOIN one b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM same WHERE doc_id = rep UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN same USING (doc_id) LEFT JOIN comp ON comp.x = rep"""


_PHRASES = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM d),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
 SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
s AS (SELECT lang, a, unnest(list_distinct(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))))) AS phrase FROM c WHERE k > 2),
o AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM s GROUP BY ALL) USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
u AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM o),
v AS (SELECT u.lang, u.phrase, a, cut, x.f AS l, y.f AS r, (2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS score FROM u
 JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[cut + 1:u.k], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t JOIN n USING (lang)"""


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


_RUNS = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS s,
 list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, {_CRC} AS h FROM d),
g AS (SELECT r, doc_id, w, n, h, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS e FROM h),
p AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] END) ELSE w END AS w FROM g),
m AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM p),
q AS (SELECT x.r, x.i, x.i - y.i AS q FROM m x JOIN m y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM q),
l AS (SELECT r, q, min(i) - q AS s, max(i) + 1 AS e FROM k GROUP BY r, q, island),
f AS (SELECT r, s, e - s AS l, min(q) AS q FROM l WHERE e - s >= 6 AND e - s >= 4 * q GROUP BY r, s, e),
o AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS listed FROM f GROUP BY r),
b AS (SELECT a.r, a.s, a.l, a.q FROM f a WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.r = a.r AND
 (z.l * a.q > a.l * z.q OR z.l * a.q = a.l * z.q AND (z.s < a.s OR z.s = a.s AND z.q < a.q)))),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM f),
c AS (SELECT m.r, string_agg(word, ' ' ORDER BY m.i) AS t FROM m LEFT JOIN gone ON gone.r = m.r AND gone.i = m.i WHERE gone.i IS NULL GROUP BY m.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
 sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM p LEFT JOIN o USING (r) LEFT JOIN b USING (r) LEFT JOIN c USING (r)"""


ORACLE: dict[str, str] = {
    "op2_quality": _quality(),
    "op3_chat": _CHAT,
    "op5_suffix_dedup": _REPEATS,
    "op7_ngram_join": _JOIN,
    "op12_collocations": _PHRASES,
    "op13_periodic_runs": _RUNS,
}
