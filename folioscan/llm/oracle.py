"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

from .licenses import IDENTIFIERS, PHRASES, TEMPLATES

OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM d GROUP BY hex),
b AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (15 - 5 * k)) & 31)::INT + 1, 1), '' ORDER BY g, k) AS payload_digest
      FROM (SELECT hex, g, k, ('0x' || substr(hex, 5 * g::INT + 1, 5))::BIGINT AS v FROM f, range(8) AS x(g), range(4) AS y(k)) GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, NULL::VARCHAR AS error
FROM d JOIN f USING (hex) JOIN b USING (hex)
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 6))) AS p FROM s)),
twice AS (SELECT rid, gram FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p + k) AS n FROM g JOIN twice USING (rid, gram), range(8) AS x(k) GROUP BY rid),
docs AS (SELECT rid, source, coalesce(doc_id::VARCHAR, '#' || rid) AS doc, ls FROM s),
lines AS (SELECT rid, source, doc, unnest(list_transform(ls, lambda l: array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+'), ' '))) AS line FROM docs),
hosts AS (SELECT source, count(DISTINCT doc) AS documents FROM docs GROUP BY 1),
often AS (SELECT l.source, line FROM lines l JOIN hosts o ON l.source IS NOT DISTINCT FROM o.source GROUP BY l.source, line HAVING count(DISTINCT doc) > 10 AND count(DISTINCT doc) > 0.05 * any_value(o.documents)),
gone AS (SELECT rid, sum(length(l.line) - length(replace(l.line, ' ', '')) + 1)::BIGINT AS n FROM lines l JOIN often f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY rid),
c AS (SELECT s.doc_id, len(s.w) AS n_words, length(regexp_replace(s.t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(s.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(s.ls) - len(list_distinct(s.ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_boilerplate_words
      FROM s LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_boilerplate_words AS words_left FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND words_left >= 8 AND words_left >= 0.3 * n_words AS kept, n_boilerplate_words FROM f
"""

OP10 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p::INT + 1, 100) AS s FROM d, LATERAL (SELECT unnest(range(0, greatest(0, length(h) // 2 - 49))) AS p)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first_id < doc_id),
mark AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
part AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM mark),
spans AS (SELECT doc_id, span, min(p) AS b, max(p) + 50 AS e FROM part GROUP BY doc_id, span),
edges AS (SELECT doc_id, span, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM spans),
cut AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last_e FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before::INT + 1, 2 * (b - before)::INT), '' ORDER BY b) AS k FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(body) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN body ELSE unhex(k || substr(h, 2 * last_e::INT + 1)) END) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"



def _rows(pairs) -> str:
    return ", ".join("('{}', '{}')".format(label, text.replace("'", "''")) for label, text in pairs)


OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, {_WORDS}) AS w FROM d),
phrases AS (SELECT label, string_split(t, ' ') AS p FROM (VALUES {_rows((label, phrase) for phrase, label in PHRASES.items())}) AS x(label, t)),
places AS (SELECT rid, label, i - 1 AS pos FROM (SELECT rid, label, w, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM s, phrases WHERE list_has_all(w, p)) WHERE w[i:i + len(p) - 1] = p),
templates AS (SELECT row_number() OVER () AS k, label, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS said FROM (VALUES {_rows(TEMPLATES + IDENTIFIERS)}) AS x(label, t)),
paired AS (SELECT *, list_distinct(said) AS tw, (2 ** greatest(3, ceil(log2(1.25 * len(said)))))::BIGINT AS step, list_distinct(list_transform(range(1, len(said)), lambda i: said[i] || ' ' || said[i + 1])) AS near FROM templates),
rules AS (SELECT *, CASE WHEN len(tw) < 10 THEN len(tw) ELSE ceil(0.8 * len(tw) - 1e-9) END AS need, CASE WHEN len(tw) < 10 THEN len(near) ELSE ceil(0.5 * len(near) - 1e-9) END AS need_near FROM paired),
able AS (SELECT rid, k FROM (SELECT rid, list_distinct(w) AS u FROM s) JOIN rules ON len(list_intersect(u, tw)) >= need),
cuts AS (SELECT rid, step, unnest(range(0, greatest(1, len(w) - step), step)) AS b FROM s JOIN (SELECT DISTINCT rid, step FROM able JOIN rules USING (k)) USING (rid)),
blocks AS (SELECT rid, step, b, w[b + 1:b + 2 * step] AS w FROM cuts JOIN s USING (rid)),
held AS (SELECT rid, b, c.step, k, label, tw, c.w AS w, len(list_intersect(c.w, tw)) AS n FROM blocks c JOIN able USING (rid) JOIN rules r USING (k) WHERE c.step = r.step AND len(list_intersect(c.w, tw)) >= need),
pairs AS (SELECT h.*, list_distinct(list_transform(range(1, len(h.w)), lambda i: h.w[i] || ' ' || h.w[i + 1])) AS near FROM held h),
firm AS (SELECT h.*, n / len(h.tw) AS c FROM pairs h JOIN rules r USING (k) WHERE len(list_intersect(h.near, r.near)) >= r.need_near),
wide AS (SELECT f.rid, f.b, f.step, f.k, f.label, f.tw, c.w, list_distinct(list_transform(range(1, len(c.w)), lambda i: c.w[i] || ' ' || c.w[i + 1])) AS near FROM firm f JOIN blocks c ON c.rid = f.rid AND c.step = f.step AND abs(c.b - f.b) <= f.step),
other AS (SELECT f.rid, f.b, f.step, f.k, len(list_intersect(f.w, o.tw)) AS n, len(list_intersect(f.w, o.tw)) / len(o.tw) AS c FROM wide f JOIN rules o ON o.label <> f.label AND 2 * len(list_intersect(o.tw, f.tw)) >= len(list_distinct(o.tw || f.tw))
          WHERE len(list_intersect(f.w, o.tw)) >= o.need AND len(list_intersect(f.near, o.near)) >= o.need_near),
best AS (SELECT DISTINCT f.rid, f.label FROM firm f WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.rid = f.rid AND o.b = f.b AND o.step = f.step AND o.k = f.k AND (o.c > f.c OR o.c = f.c AND o.n > f.n))),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM places UNION ALL SELECT rid, label FROM best) GROUP BY rid),
top AS (SELECT rid, max(c) AS c FROM firm GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM s LEFT JOIN base USING (rid) LEFT JOIN every USING (rid) LEFT JOIN top USING (rid)
"""

ORACLE_SQL = {"op1_warc": OP1, "op3_linefreq": OP3, "op7_licenses": OP7, "op10_substrings": OP10}
