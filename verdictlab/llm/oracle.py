"""SQL (DuckDB) of those queries of this subpackage that SQL can state."""

from __future__ import annotations

from verdictlab.llm.quality import BOILERPLATE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Targets in closed form, the exponential order of each source cut at its budget, then up to three closing documents.
MIXING = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
q AS (SELECT doc_id AS id, avg(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT rid, doc_id, source, size,
    -ln((CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
      / CAST(CASE WHEN q >= 0.5 THEN 2.0 WHEN q < 0.5 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS k
  FROM d LEFT JOIN q ON d.doc_id = q.id),
s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS DOUBLE) AS cap,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM k GROUP BY source),
s1 AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS used, coalesce(sum(weight) OVER w, 0) AS passed, sum(source_size) OVER () AS everything, sum(weight) OVER () AS weights
  FROM s0 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, (CAST(everything AS DOUBLE) - used) / (weights - passed) AS level FROM s1),
s3 AS (SELECT *, coalesce((SELECT max(level) FROM s2 WHERE level * weight <= cap), 0) AS top FROM s2),
s4 AS (SELECT source, source_size, least(cap, top * weight) AS target FROM s3),
s AS (
  SELECT *, target - epochs * source_size AS rest FROM
    (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM s4)),
r AS (SELECT source, k, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY k) AS upto FROM k GROUP BY source, k),
f AS (SELECT r.*, s.rest, upto <= rest AS inside FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source WHERE rest >= 1),
g0 AS (SELECT source, rest - coalesce(max(upto) FILTER (inside), 0) AS gap FROM f GROUP BY source, rest),
c1 AS (SELECT f.source, min(struct_pack(o := abs(size - gap), k := k, size := size)) AS x FROM f JOIN g0 ON f.source IS NOT DISTINCT FROM g0.source
  WHERE NOT inside AND size > 0 AND size <= gap GROUP BY f.source),
g1 AS (SELECT g0.source, gap - coalesce(x.size, 0) AS gap, [x.k] AS ks FROM g0 LEFT JOIN c1 ON g0.source IS NOT DISTINCT FROM c1.source),
c2 AS (SELECT f.source, min(struct_pack(o := abs(size - gap), k := k, size := size)) AS x FROM f JOIN g1 ON f.source IS NOT DISTINCT FROM g1.source
  WHERE NOT inside AND NOT coalesce(list_contains(ks, k), false) AND size > 0 AND size <= gap GROUP BY f.source),
g2 AS (SELECT g1.source, gap - coalesce(x.size, 0) AS gap, list_append(ks, x.k) AS ks FROM g1 LEFT JOIN c2 ON g1.source IS NOT DISTINCT FROM c2.source),
c3 AS (SELECT f.source, min(struct_pack(o := abs(size - gap), k := k, size := size)) AS x FROM f JOIN g2 ON f.source IS NOT DISTINCT FROM g2.source
  WHERE NOT inside AND NOT coalesce(list_contains(ks, k), false) AND size > 0 AND abs(size - gap) < gap GROUP BY f.source),
g3 AS (SELECT g2.source, list_append(ks, x.k) AS ks FROM g2 LEFT JOIN c3 ON g2.source IS NOT DISTINCT FROM c3.source),
taken AS (
  SELECT f.source, f.k FROM f WHERE inside
  UNION SELECT source, unnest(ks) FROM g3),
copies AS (
  SELECT k.rid, s.epochs + count(t.k) AS copies FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source
  LEFT JOIN taken t ON k.source IS NOT DISTINCT FROM t.source AND k.k = t.k GROUP BY k.rid, s.epochs)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies
FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source JOIN copies USING (rid)
"""

#: Plain windows: every item's windows, looked up at every word of every document.
DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
pos AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d),
hits AS (
  SELECT rid, p, n, item FROM (SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM pos CROSS JOIN (SELECT DISTINCT n FROM win) WHERE p + n - 1 <= len(w))
  JOIN win USING (n, k)),
hit AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS x FROM hits) GROUP BY rid),
met AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN met USING (rid)
"""

_PHRASES = ", ".join("'" + p.decode().replace("'", "''") + "'" for p in BOILERPLATE)
_PUNCT = r"[!-/:-@\[-`{-~]"

#: The rules line by line, then what the failing lines held of the text.
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT rid, p, array_to_string(w[p : p + 2], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
rep AS (
  SELECT rid, count(DISTINCT x) AS n FROM (
    SELECT rid, unnest([p, p + 1, p + 2]) AS x FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1) GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS no FROM d),
l1 AS (SELECT *, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw, regexp_replace(l, '[\x20\x09-\x0D]', '', 'g') AS solid FROM l0 WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
l2 AS (
  SELECT *, len(lw) AS n, len(regexp_extract_all(l, '{_PUNCT}')) AS marks, len(regexp_extract_all(l, '[A-Za-z]')) AS letters, len(regexp_extract_all(l, '[A-Z]')) AS upper,
    len(list_filter(lw, lambda x: regexp_full_match(x, '{_PUNCT}{{1,3}}'))) AS bars, row_number() OVER (PARTITION BY rid, l ORDER BY no) > 1 AS dup,
    translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM l1),
l3 AS (
  SELECT *, dup
    OR marks > CASE WHEN n >= 5 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END * strlen(solid)
    OR (n >= 5 AND upper > CAST(0.6 AS DOUBLE) * letters)
    OR (bars >= 3 AND 5 * bars >= n) OR (n < 3 AND NOT regexp_matches(solid, '[.!?:;"'')…”]$'))
    OR (n >= 30 AND len(list_distinct(lw)) ** 2 < 4 * n)
    OR (n <= 20 AND len(list_filter([{_PHRASES}], lambda x: contains(low, x))) > 0) AS bad FROM l2),
l AS (SELECT rid, count(*) FILTER (dup) AS dups, coalesce(sum(length(solid)) FILTER (bad), 0) AS lost FROM l3 GROUP BY rid),
a AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (word_chars = 0 OR 2 * lost <= word_chars) AS kept FROM b
"""

#: Whole texts and whole lines of any length: all but the first of equal ones; lines inside a repeated text are part of it.
WHOLE_LINES = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, text, {_WORDS} AS w FROM d),
texts AS (SELECT *, min(doc_id) OVER (PARTITION BY w) AS first_doc_id FROM t WHERE len(w) > 0),
l0 AS (
  SELECT doc_id, l, no, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS no FROM texts)),
l1 AS (
  SELECT *, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
    CAST(base + length(regexp_extract(l, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*')) AS INTEGER) AS s,
    CAST(base + length(regexp_replace(l, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$', '')) AS INTEGER) AS e FROM l0),
l2 AS (SELECT * FROM l1 WHERE len(w) > 0),
l3 AS (
  SELECT *, first_value(doc_id) OVER f AS first_doc_id, first_value(s) OVER f AS first_start, row_number() OVER f AS nth
  FROM l2 WINDOW f AS (PARTITION BY w ORDER BY doc_id, no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT t.doc_id, min(s) AS start, max(e) AS "end", CAST(len(any_value(t.w)) AS BIGINT) AS n_words, 'text' AS kind, any_value(t.first_doc_id) AS first_doc_id, 0 AS first_start
FROM texts t JOIN l2 ON t.doc_id = l2.doc_id WHERE t.doc_id > t.first_doc_id GROUP BY t.doc_id
UNION ALL
SELECT doc_id, s, e, CAST(len(w) AS BIGINT), 'line', first_doc_id, first_start FROM l3 WHERE nth > 1 AND doc_id IN (SELECT doc_id FROM texts WHERE doc_id = first_doc_id)
"""

#: The parts of all vectors that can be coded, equal ones counted; the codebooks of each round; the final codes.
_BEGIN = """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) AS q(p)),
d AS MATERIALIZED (SELECT p, x, count(*) AS n FROM parts GROUP BY p, x),
c0 AS MATERIALIZED (SELECT p, i, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i FROM parts) WHERE i < 256)"""
_ASSIGN = "a{0} AS MATERIALIZED (SELECT d.p, d.x, any_value(d.n) AS n, min({{'e': list_sum(list_transform(list_zip(d.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'i': c.i}}) AS best FROM d JOIN c{0} c ON c.p = d.p GROUP BY d.p, d.x)"
_MEANS = """c{1} AS MATERIALIZED (SELECT c.p, c.i, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN (SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY k) AS x
  FROM (SELECT p, best.i AS i, k, CAST(sum(n * x[k]) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS n FROM a{0}, (SELECT unnest(range(1, len(any_value(x)) + 1)) AS k FROM d) GROUP BY ALL) GROUP BY p, i) m ON m.p = c.p AND m.i = c.i)"""
_CODES = """coded AS (SELECT r, any_value(vec_id) AS vec_id, string_agg(lpad(lower(to_hex(best.i)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.e) AS BIGINT) AS error FROM parts JOIN a4 USING (p, x) GROUP BY r)
SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, i)) FROM c4) AS codebooks_sha256 FROM coded JOIN kept USING (r)"""
VECTOR_CODES = "WITH " + ",\n".join([_BEGIN, *[t.format(k, k + 1) for k in range(4) for t in (_ASSIGN, _MEANS)], _ASSIGN.format(4), _CODES])

#: CRC-32 of an ASCII string, bit by bit.
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(CAST(8 AS BIGINT))), lambda x, n: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
)


def _moves(to: int) -> str:
    """The cheapest way, then the least, into a state by one row: from any state, after up to two inserts. A way is its cost,
    its audit and the repaired rows."""
    new = {"s": "system", "u": "user", "a": "assistant"}
    ways = []
    for state in range(4):
        at, inserted, lines = state, "", ""
        for n in range(3):
            ways += [(state, 5 * n + 2, inserted + "D", to == at, "true", f"'{lines}'")]
            for role, then in {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[at].items():
                ways.append((state, 5 * n, inserted + "K", to == then, f"NOT gone AND initial = '{role}'", f"'{lines}' || chr(10) || line"))
                if role != "s":
                    ways.append((state, 5 * n + 1, inserted + "R", to == then, "NOT gone", f"'{lines}' || chr(10) || '{new[role]}:' || text"))
            role = "a" if at == 2 else "u"
            at, inserted, lines = (3 if role == "a" else 2), inserted + "I", lines + "\n" + new[role] + ":"
    listed = [
        f"CASE WHEN {cond} THEN {{'c': f.w{s}.c + {cost}{'' if edits.endswith('D') else ' + CASE WHEN fault = 3 THEN 5 ELSE 0 END'}, 'a': f.w{s}.a || '{edits}', 't': f.w{s}.t || {made}}} END"
        for s, cost, edits, fits, cond, made in ways if fits
    ]
    return f"list_min([{', '.join(listed) or 'CAST(NULL AS ' + _WAY + ')'}])"


_WAY = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
_NOWHERE = f"CAST({{'c': 1000000000, 'a': '', 't': ''}} AS {_WAY})"

#: The damage, the faults, and a fold over the turns of all conversations abreast with the best way into each state.
CONVERSATIONS = rf"""
WITH RECURSIVE d0 AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
d1 AS (SELECT *, {_CRC32.format("k")} % 20 AS m FROM d0),
d2 AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d1 WHERE m <> 0),
d3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, substr(role, 1, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid FROM d2),
d4 AS (SELECT *, CASE WHEN solid = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2 WHEN NOT regexp_matches(solid, '[.!?]$') THEN 3 ELSE 0 END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM d3),
r AS MATERIALIZED (SELECT *, fault IN (1, 2) AS gone, role || ':' || text AS line FROM d4),
counts AS (
  SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM r GROUP BY conv_id),
fold AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST({{'c': 0, 'a': '', 't': ''}} AS {_WAY}) AS w0, {_NOWHERE} AS w1, {_NOWHERE} AS w2, {_NOWHERE} AS w3 FROM counts
  UNION ALL
  SELECT r.conv_id, r.n, coalesce({_moves(0)}, {_NOWHERE}), coalesce({_moves(1)}, {_NOWHERE}), coalesce({_moves(2)}, {_NOWHERE}), coalesce({_moves(3)}, {_NOWHERE})
  FROM fold f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.n = f.n + 1),
best AS (
  SELECT f.conv_id, list_min([w0, {{'c': w1.c + 10, 'a': w1.a || 'II', 't': w1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': w2.c + 5, 'a': w2.a || 'I', 't': w2.t || chr(10) || 'assistant:'}}, w3]) AS w
  FROM fold f JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.n = f.n),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(substr(w.t, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def _hits(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of one fixed pattern: what stands before each, summed up, gives their places."""
    p = pattern.replace("'", "''")
    return (
        f"SELECT r, {no} AS no, '{kind}' AS kind, own, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop, length(hit) AS n FROM (SELECT r, unnest(range(len(h))) AS i, unnest(h) AS hit, unnest(o) AS own, unnest(g[1 : len(h)]) AS gap"
        f" FROM (SELECT r, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {group}) AS o, string_split_regex(t, '{p}') AS g FROM d)) QUALIFY length(own) >= {least}"
    )


#: Fixed values of the contract: the patterns of assignments, access keys and hex runs.
_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_BASE_HITS = " UNION ALL ".join([
    _hits(0, "assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), _hits(1, "access", "AKIA[A-Z0-9]+", 0, 20), _hits(2, "hex", "[0-9a-f]+", 0, 24),
])
SECRET_PATTERNS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({_BASE_HITS}),
g AS (SELECT r, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS k, count(*) FILTER (no = 2) AS x, string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, no) AS listed FROM hits GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)
"""
