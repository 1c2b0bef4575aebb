"""DuckDB twins of the registered queries, written apart from the plans they are compared with."""

from __future__ import annotations

INV = """inv AS (SELECT doc_id AS id, '/corpus/root' || (doc_id % 2) AS root, 'doc-' || doc_id || '.' || ext AS filename,
 '/corpus/root' || (doc_id % 2) || '/' || source || '/doc-' || doc_id || '.' || ext AS path, '.' || ext AS extension, n_chars AS size_bytes,
 1.7e12 + (doc_id * 7919 % 1000) * 1000.0 AS modified_at_ms, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 'indexed' ELSE 'no_text' END AS status, text, doc_id, source
 FROM (SELECT *, CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'adoc' ELSE 'sql' END AS ext FROM documents))"""
BLK = """raw AS (SELECT id AS document_id, extension, unnest(range(len(l))) AS ordinal, unnest(l) AS content FROM (SELECT id, extension, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM inv WHERE status = 'indexed')),
 blk AS (SELECT document_id, ordinal::INT AS ordinal, CASE WHEN extension = '.md' THEN first_value(content) OVER (PARTITION BY document_id ORDER BY ordinal) END AS heading, content, 'line ' || (ordinal + 1) AS location_value
  FROM raw WHERE trim(content, E' \\t\\x0b\\f') <> '')"""


def _ranked(terms: list[str], query: str, all_terms: bool, field: str = "all", where: str = "true") -> str:
    has = lambda col, t: f"contains({col}, '{t}')"
    h = [f"(coalesce(heading, '') <> '' AND coalesce({has('lower(heading)', t)}, false))" for t in terms]
    c = [has("lower(content)", t) for t in terms]
    any_h = "(" + " OR ".join(h) + ")"
    cover = f"CASE WHEN {any_h} THEN {' + '.join(x + '::INT' for x in h)} ELSE {' + '.join(x + '::INT' for x in c)} END"
    name = "lower(filename)"
    named = "0" if field == "content" else f"CASE WHEN {name} = '{query}' THEN 4 WHEN {' AND '.join(has(name, t) for t in terms)} THEN 3 ELSE 0 END"
    known = [f"(coalesce(seen{i}, false)" + ("" if field == "content" else f" OR {has(name, t)}") + ")" for i, t in enumerate(terms)]
    enough = " AND ".join(known) if all_terms else "true"
    body = "0" if field == "filename" else f"CASE WHEN NOT ({enough}) THEN 0 WHEN heading_at IS NOT NULL THEN 2 WHEN content_at IS NOT NULL THEN 1 WHEN {all_terms} AND cov > 0 THEN 1 ELSE 0 END"
    suffix = " (all terms)" if all_terms else ""
    return f"""hit AS (SELECT document_id, ordinal, {any_h} AS by_h, {cover} AS cov, {' AND '.join(h)} AS h_all, {' AND '.join(c)} AS c_all, {', '.join(f'{a} AS h{i}, {b} AS c{i}' for i, (a, b) in enumerate(zip(h, c)))} FROM blk WHERE {' OR '.join(h + c)}),
 ev AS (SELECT document_id, min(CASE WHEN h_all THEN ordinal END) AS heading_at, min(CASE WHEN c_all THEN ordinal END) AS content_at, max(cov) AS cov, {', '.join(f'bool_or(h{i} OR c{i}) AS seen{i}' for i in range(len(terms)))} FROM hit GROUP BY document_id),
 rep AS (SELECT document_id, ordinal AS rep_at, by_h FROM hit WHERE cov > 0 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY cov DESC, by_h DESC, ordinal) = 1),
 lad AS (SELECT inv.*, {named} AS nr, heading_at, content_at, rep_at, by_h, {body} AS br FROM inv LEFT JOIN ev ON id = ev.document_id LEFT JOIN rep ON id = rep.document_id WHERE {where}),
 res AS (SELECT id, path, modified_at_ms, status, extension, CASE WHEN nr > 0 THEN nr ELSE br END AS rank,
  CASE WHEN nr > 0 THEN 'filename' WHEN heading_at IS NOT NULL THEN 'heading' WHEN content_at IS NOT NULL THEN 'content' WHEN by_h THEN 'heading' ELSE 'content' END AS "by",
  CASE WHEN nr = 0 THEN coalesce(heading_at, content_at, rep_at) END AS ordinal,
  CASE CASE WHEN nr > 0 THEN nr ELSE br END WHEN 4 THEN 'filename equals' WHEN 3 THEN 'filename contains{suffix}' WHEN 2 THEN 'heading{suffix}' ELSE 'content{suffix}' END AS reason
  FROM lad WHERE nr > 0 OR br > 0)"""


ORDERS = {"relevance": "rank DESC, modified_at_ms DESC, path", "filename": "path, modified_at_ms DESC", "modified": "modified_at_ms DESC, path"}


def _search(text: str, all_terms: bool = False, field: str = "all", sort: str = "relevance", where: str = "true", limit: int = 20, skip: int = 0) -> str:
    query = text.lower()
    terms = list(dict.fromkeys(query.split())) if all_terms else [query]
    return f"WITH {INV}, {BLK}, {_ranked(terms, query, all_terms, field, where)} SELECT position, id, path, rank, \"by\", ordinal, reason FROM (SELECT *, row_number() OVER (ORDER BY {ORDERS[sort]}) AS position FROM res) WHERE position > {skip} AND position <= {limit}"


def _with(text: str, all_terms: bool, tail: str, sort: str = "relevance") -> str:
    query = text.lower()
    terms = list(dict.fromkeys(query.split())) if all_terms else [query]
    return f"WITH {INV}, {BLK}, {_ranked(terms, query, all_terms)}, pos AS (SELECT *, row_number() OVER (ORDER BY {ORDERS[sort]}) AS position FROM res) {tail}"


DISK = f"""WITH {INV}, idx AS (SELECT path, extension, size_bytes, modified_at_ms, id, CASE WHEN id % 17 = 2 THEN 'error' ELSE status END AS status, CASE WHEN id % 5 <> 0 THEN 1 END AS parse_version FROM inv WHERE id % 13 <> 3),
 disk AS (SELECT path, id, CASE WHEN id % 23 = 6 THEN '.bin' ELSE extension END AS extension, size_bytes + CASE WHEN id % 7 = 1 THEN 1 ELSE 0 END AS size_bytes, modified_at_ms FROM inv WHERE id % 19 <> 4)"""
READ = "('.md','.txt','.xml','.java','.sql','.js','.docx','.pptx','.xlsx','.xlsm','.odt','.rtf','.csv','.pdf','.doc','.xls','.mht','.mhtml','.html','.htm','.xhtml','.adoc','.msg','.vsd')"
TEXT = "('.txt','.md','.adoc','.xml','.java','.sql','.js')"
IGNORED = """CASE WHEN regexp_matches(rel, '(?i)^src1/') THEN '/src1/' WHEN regexp_matches(rel, '(?i)(?:^|/)[^/]*-1[^/]\\.md$') THEN '*-1?.md'
 WHEN regexp_matches(rel, '(?i)^src2/(?:.*/)?doc-3[^/]*$') THEN 'src2/**/doc-3*' WHEN regexp_matches(rel, '(?i)\\.sql$') THEN '**/*.sql' END"""
OWNED = """CASE WHEN path LIKE '/corpus/root0/src2/%' THEN '/corpus/root0/src2' WHEN path LIKE '/corpus/root0/%' THEN '/corpus/root0' WHEN path LIKE '/corpus/root1/src3/%' THEN '/corpus/root1/src3' END"""
EVENTS = """ev AS (SELECT conv_id AS session, turn AS line, (conv_id + turn) % 11 <> 0 AS valid, role, CASE WHEN role = 'user' THEN 'message' ELSE 'event_msg' END AS event_type, '2024-01-01T' || lpad(turn::VARCHAR, 5, '0') AS time,
 '/corpus/root' || (conv_id % 2) || '/src' || (conv_id % 20) || '/DOC-' || (conv_id + 2 * turn) || '.txt' AS path FROM conversations)"""
REFS = f"""WITH {INV}, {EVENTS}, refs AS (SELECT session, path, count(*) AS occurrences, list_sort(list(DISTINCT event_type)) AS et,
 bool_or(role = 'user') AS u, bool_or(role = 'system') AS s, bool_or(role NOT IN ('user', 'system')) AS o FROM ev WHERE valid GROUP BY ALL),
 out AS (SELECT session, refs.path, occurrences, CASE WHEN s THEN 'prompt' WHEN o THEN 'other-tool' ELSE 'user-provided' END AS source, CASE WHEN s OR o THEN 'high' ELSE 'medium' END AS confidence,
 concat_ws(',', CASE WHEN s THEN 'prompt' END, CASE WHEN u THEN 'user-provided' END, CASE WHEN o THEN 'other-tool' END) AS sources, array_to_string(et, ',') AS event_types,
 coalesce(a.id, b.id) AS document_id, coalesce(a.id, b.id) IS NOT NULL AS indexed FROM refs LEFT JOIN inv a ON a.path = refs.path LEFT JOIN inv b ON lower(b.path) = lower(refs.path))"""
WORK = """w AS (SELECT user_id % 4 AS root, 'u' || user_id AS rel_path, CASE event_type WHEN 'view' THEN 'expand' WHEN 'error' THEN 'delete' ELSE 'event' END AS reason, ts, event_id FROM events)"""
QUEUE = """q AS (SELECT root, rel_path, count(*) AS generation, min(ts) AS created_at, CASE WHEN arg_max(reason, (ts, event_id)) = 'expand' AND arg_max(reason, (ts, event_id)) FILTER (reason <> 'expand') = 'event' THEN 'event' ELSE arg_max(reason, (ts, event_id)) END AS reason FROM w GROUP BY root, rel_path)"""

DEBOUNCED = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
 w AS (SELECT key, k, 1 AS burst, tm AS first, tm AS last, 1 AS n, tm + 21600000 AS due FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, CASE WHEN tm < due THEN burst ELSE burst + 1 END, CASE WHEN tm < due THEN first ELSE tm END, tm, CASE WHEN tm < due THEN n + 1 ELSE 1 END, least(tm + 21600000, CASE WHEN tm < due THEN first ELSE tm END + 86400000)
  FROM w JOIN e ON e.key = w.key AND e.k = w.k + 1)
 SELECT key, first, last, n, due FROM w QUALIFY row_number() OVER (PARTITION BY key, burst ORDER BY k DESC) = 1"""



def _pad(byte: int) -> str:
    """The padded key of an HMAC in hex."""
    return bytes(b ^ byte for b in b"key of this installation".ljust(64, b"\0")).hex()




def _snippet(source: str, term: str) -> str:
    """SQL for the snippet of 160 characters around the first hit of a short term, of texts that are their own normal form."""
    flat = lambda text: f"regexp_replace({text}, '\\s+', ' ', 'g')"
    at = f"instr(lower({source}), {term})"
    left, right = flat(f"substr({source}, 1, {at} - 1)"), flat(f"substr({source}, {at} + length({term}))")
    hit = f"substr({source}, {at}, length({term}))"
    before = f"least(45, length({left}), 158 - length({term}))"
    after = f"(158 - {before} - length({term}))"
    lead = f"CASE WHEN length({left}) > {before} THEN '…' ELSE '' END || right({left}, {before})"
    tail = f"substr({right}, 1, {after}) || CASE WHEN length({right}) > {after} THEN '…' ELSE '' END"
    return f"trim({lead} || {hit} || {tail}, E' \t\n')"


TOOLS = """t AS (SELECT conv_id AS session, turn AS line, '/corpus/root' || (conv_id % 2) || '/src' || (conv_id % 20) || '/doc-' || (conv_id + 2 * turn) || '.txt' AS path,
 CASE role WHEN 'user' THEN 'user-provided' ELSE 'other-tool' END AS source, CASE role WHEN 'user' THEN 'medium' ELSE 'high' END AS confidence,
 CASE role WHEN 'user' THEN 'response_item/message' WHEN 'assistant' THEN 'response_item/function_call' ELSE 'response_item/custom_tool_call' END AS event_type FROM conversations)"""

ORACLE_SQL = {
    "line_blocks": f"WITH {INV}, {BLK} SELECT * FROM blk",
    "search_phrase": _search("the than"),
    "search_phrase_filename": _search("doc-1", field="filename"),
    "search_phrase_content": _search("thti", field="content"),
    "search_all_terms": _search("re ing", True),
    "search_all_terms_coverage": _search("eau doc-7 ou", True),
    "search_filters": _search("en", where="extension IN ('.adoc', '.md') AND status = 'indexed' AND root = '/corpus/root1' AND path LIKE '/corpus/root1/src3/%'"),
    "search_sort_filename": _search("ten", sort="filename"),
    "search_sort_modified": _search("ten", sort="modified"),
    "search_exact_name": _search("doc-7.txt"),
    "search_page2": _search("the than", limit=30, skip=15),
    "search_phased": _search("doc-2"),
    "search_total_exact": _with("ten", False, "SELECT count(*) AS total, 'eq' AS relation FROM res"),
    "search_total_fast": _with("ten", False, "SELECT least(count(*), 500) AS total, CASE WHEN count(*) < 500 THEN 'eq' ELSE 'gte' END AS relation FROM res"),
    "refine_within": f"WITH {INV}, {BLK}, first AS (SELECT id AS fid, position AS p FROM ({_search('ten', sort='modified', limit=200)})), {_ranked(['ing'], 'ing', False)} SELECT row_number() OVER (ORDER BY p) AS position, id, path, rank, \"by\", ordinal, reason FROM res JOIN first ON id = fid",
    "phrase_passages": _with("the than", False, """SELECT document_id, place, ordinal, heading, location_value, source FROM (SELECT b.document_id, b.ordinal, b.heading, b.location_value,
 concat_ws(chr(10), CASE WHEN contains(lower(b.heading), 'the than') THEN b.heading END, CASE WHEN contains(lower(b.content), 'the than') THEN b.content END) AS source,
 row_number() OVER (PARTITION BY b.document_id ORDER BY (b.ordinal = coalesce(pos.ordinal, -1)) DESC, b.ordinal) AS place
 FROM pos JOIN blk b ON b.document_id = pos.id WHERE position <= 50 AND (contains(lower(b.content), 'the than') OR coalesce(contains(lower(b.heading), 'the than'), false))) WHERE place <= 2"""),
    "snippet_page": _with("the than", False, f""", p AS (SELECT pos.position, pos.id, CASE "by" WHEN 'heading' THEN b.heading WHEN 'content' THEN b.content ELSE pos.filename END AS source
 FROM pos LEFT JOIN blk b ON b.document_id = pos.id AND b.ordinal = pos.ordinal WHERE position <= 20) SELECT position, id, {_snippet('source', "'the than'")} AS snippet, false AS snippet_truncated FROM p""").replace("SELECT id, path, modified_at_ms, status", "SELECT id, path, filename, modified_at_ms, status"),
    "context_passages": _with("re ing", True, f""", h AS (SELECT b.*, coalesce(contains(lower(heading), 're'), false) AS h0, coalesce(contains(lower(heading), 'ing'), false) AS h1, contains(lower(content), 're') AS c0, contains(lower(content), 'ing') AS c1
 FROM pos JOIN blk b ON b.document_id = pos.id WHERE position <= 20),
 r AS (SELECT document_id, ordinal, CASE WHEN h0 OR h1 THEN 2 ELSE 1 END AS rank, location_value AS location, CASE WHEN h0 OR h1 THEN heading ELSE content END AS source, CASE WHEN h0 OR h1 THEN h0 ELSE c0 END AS m0, CASE WHEN h0 OR h1 THEN h1 ELSE c1 END AS m1 FROM h),
 m AS (SELECT *, m0::INT + m1::INT AS n FROM r WHERE m0 OR m1),
 a1 AS (SELECT *, 1 AS place FROM m QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, rank DESC, ordinal) = 1),
 a2 AS (SELECT m.*, 2 AS place FROM m JOIN a1 x USING (document_id) WHERE m.ordinal <> x.ordinal QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY (m.m0 AND NOT x.m0)::INT + (m.m1 AND NOT x.m1)::INT DESC, m.n DESC, m.rank DESC, m.ordinal) = 1),
 a3 AS (SELECT m.*, 3 AS place FROM m JOIN a1 x USING (document_id) JOIN a2 y USING (document_id) WHERE m.ordinal NOT IN (x.ordinal, y.ordinal)
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY (m.m0 AND NOT x.m0 AND NOT y.m0)::INT + (m.m1 AND NOT x.m1 AND NOT y.m1)::INT DESC, m.n DESC, m.rank DESC, m.ordinal) = 1),
 f AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3), t AS (SELECT *, CASE WHEN m0 AND (NOT m1 OR instr(lower(source), 're') < instr(lower(source), 'ing')) THEN 're' ELSE 'ing' END AS term FROM f)
 SELECT document_id, place, ordinal, rank, location, {_snippet('source', 'term')} AS snippet, false AS snippet_truncated FROM t"""),
    "all_terms_passages": _with("re ing", True, """, h AS (SELECT b.document_id, b.ordinal, b.heading, b.location_value, coalesce(contains(lower(b.heading), 're'), false) AS h0, coalesce(contains(lower(b.heading), 'ing'), false) AS h1, contains(lower(b.content), 're') AS c0, contains(lower(b.content), 'ing') AS c1, b.content
 FROM pos JOIN blk b ON b.document_id = pos.id WHERE position <= 50),
 s AS (SELECT document_id, ordinal, heading, location_value, h0 OR c0 AS t0, h1 OR c1 AS t1, concat_ws(chr(10), CASE WHEN h0 OR h1 THEN heading END, CASE WHEN c0 OR c1 THEN content END) AS source FROM h WHERE h0 OR h1 OR c0 OR c1),
 d0 AS (SELECT a.document_id, 0 AS i, 're' AS term, a.ordinal, min(abs(a.ordinal - b.ordinal)) AS near FROM s a LEFT JOIN s b ON a.document_id = b.document_id AND b.t1 WHERE a.t0 GROUP BY ALL),
 d1 AS (SELECT a.document_id, 1 AS i, 'ing' AS term, a.ordinal, min(abs(a.ordinal - b.ordinal)) AS near FROM s a LEFT JOIN s b ON a.document_id = b.document_id AND b.t0 WHERE a.t1 GROUP BY ALL),
 one AS (SELECT * FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1) QUALIFY row_number() OVER (PARTITION BY document_id, i ORDER BY coalesce(near, 1 << 30), ordinal) = 1),
 sel AS (SELECT document_id, ordinal, list(i ORDER BY i) AS own, list(term ORDER BY i) AS terms FROM one GROUP BY ALL),
 isl AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY ordinal) AS passage FROM (SELECT *, CASE WHEN ordinal = lag(ordinal) OVER (PARTITION BY document_id ORDER BY ordinal) + 1 THEN 0 ELSE 1 END AS new FROM sel)),
 tm AS (SELECT document_id, passage, string_agg(term, ',' ORDER BY i) AS terms FROM isl JOIN one USING (document_id, ordinal) GROUP BY ALL)
 SELECT isl.document_id, isl.passage, min(isl.ordinal) AS ordinal, arg_min(s.heading, s.ordinal) AS heading, arg_min(s.location_value, s.ordinal) AS location_value, string_agg(s.source, chr(10) ORDER BY s.ordinal) AS source, any_value(tm.terms) AS terms
 FROM isl JOIN s USING (document_id, ordinal) JOIN tm ON tm.document_id = isl.document_id AND tm.passage = isl.passage GROUP BY isl.document_id, isl.passage"""),
    "stable_reference": f"WITH {INV} SELECT id, path, id || '-' || substr(sha256(path), 1, 16) AS reference FROM inv",
    "heading_min_ordinal": f"WITH {INV}, {BLK} SELECT document_id, heading, min(ordinal) AS ordinal FROM blk WHERE heading <> '' GROUP BY ALL",
    "gram_postings": f"WITH {INV}, {BLK} SELECT gram, count(DISTINCT document_id) AS n_documents FROM (SELECT document_id, unnest(list_transform(range(1, length(content) - 1), lambda i: substr(lower(content), i, 3))) AS gram FROM blk) GROUP BY gram",
    "gram_candidates": f"WITH {INV}, {BLK} SELECT document_id FROM blk GROUP BY document_id HAVING " + " AND ".join(f"bool_or(contains(lower(content), '{g}'))" for g in ("tht", "hti", "tio", "ion")),
    "gram_vs_scan": f"WITH {INV}, {BLK} SELECT document_id, min(ordinal) AS ordinal FROM blk WHERE contains(lower(content), 'thtion') GROUP BY document_id",
    "filename_grams": f"WITH {INV} SELECT gram, count(DISTINCT id) AS n_documents FROM (SELECT id, unnest(list_transform(range(1, length(filename)), lambda i: substr(lower(filename), i, 2))) AS gram FROM inv) GROUP BY gram",
    "html_blocks": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS h FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<a [^>]*href="([^"]*)"[^>]*>', ' \1 ', 'g'), '<(title|h[1-6])[^>]*>', chr(1) || chr(2), 'g') AS h FROM a),
 c AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?(title|h[1-6]|p|div|li|ul|nav|article|footer|br|html|head|body)( [^>]*)?/?>', chr(1), 'g'), '<[^>]*>', '', 'g') AS h FROM b),
 d AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS piece FROM (SELECT page_id, string_split(h, chr(1)) AS l FROM c)),
 e AS (SELECT page_id, i, starts_with(piece, chr(2)) AS head, trim(regexp_replace(replace(replace(replace(replace(replace(piece, chr(2), ''), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS content FROM d)
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ordinal, last_value(CASE WHEN head THEN content END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS heading, content FROM e WHERE content <> ''""",
    "html_titles": "SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages",
    "markdown_sections": "SELECT doc_id, 0 AS ordinal, 'doc ' || doc_id AS heading, rtrim('# doc ' || doc_id || chr(10) || text, E' \\n\\t') AS content, 1 AS start_line FROM documents",
    "status_counts": f"WITH {INV} SELECT s.status, count(inv.status) AS n FROM (SELECT unnest(['indexed', 'no_text', 'unsupported', 'too_large', 'encrypted', 'error']) AS status) s LEFT JOIN inv USING (status) GROUP BY 1",
    "extension_stats": f"WITH {INV} SELECT extension, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (status = 'indexed') AS n_indexed FROM inv GROUP BY 1",
    "documents_in_scope": f"WITH {INV} SELECT root, extension, count(*) AS n FROM inv WHERE extension IN ('.adoc', '.md') AND status = 'indexed' AND root = '/corpus/root1' AND path LIKE '/corpus/root1/src3/%' GROUP BY ALL",
    "reprocess_reasons": f"""{DISK}, c AS (SELECT disk.extension, CASE WHEN idx.path IS NULL THEN 'added' WHEN idx.size_bytes <> disk.size_bytes THEN 'source-changed' WHEN idx.status = 'error' THEN 'error-retry'
 WHEN disk.extension IN {TEXT} AND coalesce(parse_version, 0) < 1 THEN 'text-upgrade' WHEN idx.status = 'unsupported' AND disk.extension IN {READ} THEN 'unsupported-retry' ELSE 'unchanged' END AS reason FROM disk LEFT JOIN idx USING (path))
 SELECT reason, CASE WHEN reason = 'unchanged' THEN 'skip' WHEN extension NOT IN {READ} THEN 'metadata' ELSE 'parse' END AS action, count(*) AS n FROM c GROUP BY ALL""",
    "text_upgrade_pending": f"{DISK} SELECT extension, count(*) AS n FROM idx WHERE extension IN {TEXT} AND coalesce(parse_version, 0) < 1 GROUP BY 1",
    "snapshot_diff": f"{DISK} SELECT coalesce(disk.path, idx.path) AS path, CASE WHEN idx.path IS NULL THEN 'added' WHEN disk.path IS NULL THEN 'removed' WHEN disk.size_bytes = idx.size_bytes THEN 'same' ELSE 'changed' END AS change FROM disk FULL JOIN idx ON disk.path = idx.path",
    "reconcile_resumed": f"{DISK} SELECT coalesce(disk.path, idx.path) AS path, CASE WHEN idx.path IS NULL THEN 'added' WHEN disk.path IS NULL THEN 'removed' WHEN disk.size_bytes = idx.size_bytes THEN 'same' ELSE 'changed' END AS change FROM disk FULL JOIN idx ON disk.path = idx.path WHERE idx.path IS NULL OR disk.path IS NULL OR disk.size_bytes <> idx.size_bytes",
    "remove_missing_protected": f"{DISK} SELECT path, path LIKE '/corpus/root0/src2/%' OR path LIKE '/corpus/root0/src1/%' AS protected FROM idx WHERE path LIKE '/corpus/root0/%' AND path NOT IN (SELECT path FROM disk)",
    "ignore_rules_roots": f"""WITH {INV}, r AS (SELECT path, CASE WHEN root = '/corpus/root0' THEN {IGNORED} WHEN regexp_matches(rel, '(?i)(?:^|/)src3/') THEN 'src3/'
 WHEN regexp_matches(rel, '(?i)(?:^|/)[^/]*-2[^/]\\.[^/]*$') THEN '*-2?.*' WHEN regexp_matches(rel, '(?i)^src1/doc-1[^/]*$') THEN '/src1/doc-1*' END AS pattern FROM (SELECT *, substr(path, length(root) + 2) AS rel FROM inv))
 SELECT path, pattern FROM r WHERE pattern IS NOT NULL""",
    "ignore_rules": f"WITH {INV} SELECT path, {IGNORED} AS pattern FROM (SELECT *, substr(path, length(root) + 2) AS rel FROM inv) WHERE {IGNORED} IS NOT NULL",
    "skipped_by_rule": f"""WITH {INV}, r AS (SELECT id, CASE WHEN id % 29 = 0 THEN 'lib/node_modules/' || substr(path, length(root) + 2) WHEN id % 31 = 0 THEN '~$' || filename ELSE substr(path, length(root) + 2) END AS rel FROM inv),
 x AS (SELECT CASE WHEN id % 41 = 0 THEN 'index-artifact' WHEN id % 37 = 0 THEN 'link' WHEN contains(rel, 'node_modules/') THEN 'builtin:node-modules' WHEN starts_with(rel, '~$') THEN 'builtin:office-temp' ELSE 'user-rule:' || {IGNORED} END AS rule FROM r)
 SELECT rule, count(*) AS n FROM x WHERE rule IS NOT NULL GROUP BY 1""",
    "explain_path": f"""WITH {INV}, o AS (SELECT path, id, status, {OWNED} AS own FROM inv), r AS (SELECT *, substr(path, length(own) + 2) AS rel FROM o), g AS (SELECT *, CASE WHEN own IS NOT NULL THEN {IGNORED} END AS rule FROM r)
 SELECT path, CASE WHEN own IS NULL THEN 'outside-root' WHEN rule IS NOT NULL THEN 'excluded' WHEN id % 9 = 1 THEN 'unindexed' WHEN id % 17 = 2 THEN 'parse-failed' WHEN status <> 'indexed' THEN 'filename-only' ELSE 'indexed' END AS state, rule FROM g""",
    "root_cover": f"WITH {INV} SELECT {OWNED} AS root, count(*) AS n FROM inv GROUP BY 1",
    "root_merge": f"WITH {INV} SELECT id, {OWNED} AS old_root, CASE WHEN {OWNED} IS NOT NULL THEN '/corpus' END AS new_root FROM inv",
    "orphan_roots": f"WITH {INV} SELECT DISTINCT root FROM (SELECT regexp_extract(path, '^(/corpus/[^/]+/[^/]+)/', 1) AS root FROM inv UNION ALL SELECT root FROM inv UNION ALL SELECT '/corpus/old' || extension FROM inv) WHERE root NOT IN ('/corpus/root0', '/corpus/root0/src2', '/corpus/root1/src3')",
    "imported_results": f"WITH {INV} SELECT path, CASE WHEN lower(filename) = 'doc-1' THEN 4 ELSE 3 END AS rank, false AS imported FROM inv WHERE contains(lower(filename), 'doc-1') UNION ALL SELECT '/dropped/doc-' || page_id || '.html', 3, true FROM (SELECT page_id FROM pages ORDER BY page_id DESC LIMIT 20) WHERE page_id::VARCHAR LIKE '1%'",
    "session_summary": f"""WITH {EVENTS}, k AS (SELECT session, string_agg(event_type || '=' || n, ',' ORDER BY event_type || '=' || n) AS event_types FROM (SELECT session, event_type, count(*) AS n FROM ev WHERE valid GROUP BY ALL) GROUP BY 1)
 SELECT ev.session, count(*) FILTER (valid) AS events, count(*) FILTER (NOT valid) AS invalid_lines, arg_min(time, line) FILTER (valid) AS started_at, arg_max(time, line) FILTER (valid) AS last_event_at, any_value(k.event_types) AS event_types FROM ev LEFT JOIN k USING (session) GROUP BY 1""",
    "session_references": f"{REFS} SELECT * FROM out",
    "reference_totals": f"{REFS} SELECT session, count(*) AS n_references, count(*) FILTER (indexed) AS n_indexed, count(*) FILTER (contains(sources, 'prompt')) AS n_prompt, count(*) FILTER (contains(sources, 'user-provided')) AS n_user_provided, 0 AS n_search_tool, count(*) FILTER (contains(sources, 'other-tool')) AS n_other_tool FROM out GROUP BY 1",
    "recent_files": "SELECT '/corpus/user' || user_id AS path, max(ts) AS last_used_at, arg_max(event_type, (ts, event_id)) AS last_action, count(*) AS uses FROM events GROUP BY user_id ORDER BY last_used_at DESC, path LIMIT 100",
    "library_groups": """WITH i AS (SELECT user_id % 5 AS group_id, '/corpus/user' || user_id AS path, min(ts) AS added_at FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY added_at, path) AS n FROM i)
 SELECT g.group_id, 'group ' || g.group_id AS name, count(path) AS n_items, coalesce(string_agg(path, chr(10) ORDER BY n), '') AS paths FROM (SELECT unnest(range(6)) AS group_id) g LEFT JOIN (SELECT * FROM n WHERE n <= 30) x ON x.group_id = g.group_id GROUP BY 1, 2""",
    "saved_search_replay": _search("ten", sort="modified", where="extension = '.adoc'"),
    "timing_percentiles": "SELECT event_type, count(value) AS n, round(quantile_disc(value, 0.5), 2) AS p50, round(quantile_disc(value, 0.95), 2) AS p95, round(max(value), 2) AS most FROM events GROUP BY 1",
    "slowest_topk": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20",
    "last_samples": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 32",
    "trace_phase_rollup": """WITH e AS (SELECT user_id % 50 AS trace, CASE WHEN event_type IN ('click', 'purchase') THEN 'view/' || event_type ELSE event_type END AS phase, value FROM events),
 t AS (SELECT trace, phase, sum(value) AS total FROM e GROUP BY ALL), s AS (SELECT *, CASE WHEN phase = 'view' THEN greatest(0, total - coalesce((SELECT sum(u.total) FROM t u WHERE u.trace = t.trace AND u.phase LIKE 'view/%'), 0)) ELSE total END AS own FROM t)
 SELECT trace, phase, round(total, 2) AS inclusive, round(own, 2) AS self, row_number() OVER (PARTITION BY trace ORDER BY own DESC, phase) = 1 AS bottleneck FROM s""",
    "watcher_errors": "SELECT 'E' || (user_id % 7) AS code, count(*) AS n, max(ts) AS last_at FROM events WHERE event_type = 'error' GROUP BY 1",
    "event_bursts": "WITH g AS (SELECT *, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000 THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g) SELECT user_id, burst, count(*) AS n FROM b GROUP BY ALL",
    "queue_generations": f"WITH {WORK}, {QUEUE} SELECT root, rel_path, generation, reason FROM q",
    "queue_acknowledged": f"WITH {WORK}, {QUEUE}, a AS (SELECT root, rel_path, count(*) * 2 + 1 AS up_to FROM w WHERE event_id % 3 = 0 GROUP BY ALL) SELECT root, rel_path, generation FROM q LEFT JOIN a USING (root, rel_path) WHERE up_to IS NULL OR generation > up_to",
    "stream_queue": f"WITH {WORK}, {QUEUE}, a AS (SELECT root, rel_path, count(*) * 2 + 1 AS up_to FROM w WHERE event_id % 3 = 0 GROUP BY ALL) SELECT root, rel_path, generation FROM q LEFT JOIN a USING (root, rel_path) WHERE up_to IS NULL OR generation > up_to",
    "queue_depth": f"WITH {WORK}, {QUEUE} SELECT root, count(*) AS n, min(created_at) AS oldest, max(generation) AS generation FROM q GROUP BY 1",
    "queue_overflow": f"""WITH {WORK.replace('user_id % 4 AS root', 'least(user_id % 8, 4) AS root')}, {QUEUE}, s AS (SELECT root, count(*) AS n FROM q GROUP BY 1)
 SELECT root, 'path' AS kind, reason, count(*) AS n FROM q WHERE root IN (SELECT root FROM s WHERE n <= 20) GROUP BY ALL UNION ALL SELECT root, 'dirty-scope', 'overflow', 1 FROM s WHERE n > 20""",
    "fair_batch": f"""WITH {WORK}, {QUEUE}, z AS (SELECT root, rel_path, reason = 'expand' AS expand, substr(rel_path, 2)::INT % 6 = 0 AS deferred, created_at FROM q),
 r AS (SELECT *, row_number() OVER (PARTITION BY root, expand, deferred ORDER BY created_at, rel_path) AS up, row_number() OVER (PARTITION BY root, expand, deferred ORDER BY created_at DESC, rel_path DESC) AS down FROM z)
 SELECT root, rel_path, expand, deferred FROM r QUALIFY row_number() OVER (PARTITION BY root ORDER BY expand, deferred, CASE WHEN deferred OR down <= 4 THEN 0 ELSE 1 END, up) <= 12""",
    "event_debounce": DEBOUNCED,
    "stream_debounce": DEBOUNCED,
    "rescan_throttle": """WITH RECURSIVE e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS tm, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM events),
 w AS (SELECT key, k, tm AS opened, 3 AS room, tm + 60000 AS allowed, 0 AS refused, 1 AS accepted FROM e WHERE k = 1
  UNION ALL SELECT key, k, opened, CASE WHEN tm >= allowed AND room > 0 THEN room - 1 ELSE room END, CASE WHEN tm >= allowed AND room > 0 THEN tm + 60000 WHEN tm >= allowed THEN tm + [60000, 300000, 900000][least(refused, 2) + 1] ELSE allowed END,
   CASE WHEN tm >= allowed AND room = 0 THEN refused + 1 ELSE refused END, CASE WHEN tm >= allowed AND room > 0 THEN accepted + 1 ELSE accepted END
  FROM (SELECT e.key, e.k, e.tm, CASE WHEN tm >= opened + 3600000 THEN tm ELSE opened END AS opened, CASE WHEN tm >= opened + 3600000 THEN 4 ELSE room END AS room, allowed, refused, accepted FROM w JOIN e ON e.key = w.key AND e.k = w.k + 1))
 SELECT key, max(k) AS requests, max(accepted) AS accepted FROM w GROUP BY key""",
    "tool_evidence": f"WITH {TOOLS} SELECT * FROM t",
    "reference_buckets": f"WITH {TOOLS} SELECT session, count(DISTINCT path) AS n_visible, 0 AS n_low, 0 AS n_unknown FROM t GROUP BY 1",
    "chunk_assignment": f"""WITH RECURSIVE {INV}, {BLK}, u AS (SELECT document_id, ordinal, length(content) + length(regexp_replace(content, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS size FROM blk WHERE content <> ''),
 z AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS k FROM u),
 c AS (SELECT document_id, ordinal, size, k, 0 AS chunk, size + 1 AS held FROM z WHERE k = 1 UNION ALL
  SELECT z.document_id, z.ordinal, z.size, z.k, CASE WHEN held + z.size > 2000 THEN chunk + 1 ELSE chunk END, CASE WHEN held + z.size > 2000 THEN z.size + 1 ELSE held + z.size + 1 END FROM c JOIN z ON z.document_id = c.document_id AND z.k = c.k + 1)
 SELECT document_id, ordinal, size, chunk FROM c""",
    "payload_search": f"WITH {INV}, {BLK} SELECT document_id, ordinal FROM blk WHERE contains(lower(content), 'thtion')",
    "preview_ids": f"WITH {INV} SELECT id, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(path)))) AS preview FROM inv",
    "search_pruned": _search("the than"),
    "unicode_search": f"""WITH {INV}, u AS (SELECT id, path, modified_at_ms, extension, len(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r')) AS ordinal FROM inv WHERE id::VARCHAR LIKE '7%')
 SELECT row_number() OVER (ORDER BY modified_at_ms DESC, path) AS position, id, path, 1 AS rank, 'content' AS "by", ordinal, 'content' AS reason FROM u QUALIFY position <= 50""",
    "intake_batches": """WITH RECURSIVE e AS (SELECT row_number() OVER w AS k, epoch_us(ts) // 1000 AS tm, coalesce(strlen(props), 0) AS size, (sum(coalesce(strlen(props), 0)) OVER w)::BIGINT AS total FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT k, ask, min(hit) OVER (ORDER BY x DESC, ask ROWS UNBOUNDED PRECEDING) AS hit FROM (SELECT tm AS x, 0 AS ask, k, k AS hit FROM e UNION ALL SELECT tm + 604800000, 1, k, NULL FROM e)),
b AS (SELECT k, ask, min(hit) OVER (ORDER BY x DESC, ask DESC ROWS UNBOUNDED PRECEDING) AS hit FROM (SELECT total AS x, 0 AS ask, k, k AS hit FROM e UNION ALL SELECT total - size + 100000, 1, k, NULL FROM e)),
step AS (SELECT t.k, least(t.k + 4000, t.hit, CASE WHEN b.hit IS NOT NULL THEN greatest(t.k + 1, b.hit) END) AS next FROM t JOIN b USING (k) WHERE t.ask = 1 AND b.ask = 1),
s AS (SELECT 0 AS batch, 1::BIGINT AS k WHERE EXISTS (FROM e) UNION ALL SELECT batch + 1, next FROM s JOIN step USING (k) WHERE next <= (SELECT max(k) FROM e)),
r AS (SELECT batch, k AS lo, lead(k) OVER (ORDER BY k) AS hi FROM s)
SELECT batch, count(*) AS n, sum(size)::BIGINT AS size, min(tm) AS first_ms, max(tm) AS last_ms FROM e JOIN r ON e.k >= lo AND (hi IS NULL OR e.k < hi) GROUP BY batch""",
    "prepared_groups": """WITH RECURSIVE d AS (SELECT doc_id % 4 AS root, doc_id, coalesce(length(text), 0) AS chars, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS k FROM documents),
g AS (SELECT root, k, doc_id, chars AS held, 1 AS n, 0 AS number FROM d WHERE k = 1
UNION ALL SELECT d.root, d.k, d.doc_id, CASE WHEN n = 50 OR held + chars > 20000 THEN chars ELSE held + chars END, CASE WHEN n = 50 OR held + chars > 20000 THEN 1 ELSE n + 1 END, CASE WHEN n = 50 OR held + chars > 20000 THEN number + 1 ELSE number END
FROM g JOIN d ON d.root = g.root AND d.k = g.k + 1)
SELECT root, doc_id, number FROM g""",
    "intake_counts": "SELECT CASE WHEN event_type = 'error' THEN 'rescan' WHEN event_type IN ('purchase', 'signup') THEN 'excluded' ELSE 'path' END AS intake, count(*) AS n FROM events GROUP BY 1",
    "live_status": f"""WITH {WORK}, {QUEUE}, d AS (SELECT root, count(*) AS waiting, min(created_at) AS oldest FROM q GROUP BY 1),
 s AS (SELECT user_id % 4 AS root, count(value) AS n, round(quantile_disc(value, 0.5), 2) AS p50, round(quantile_disc(value, 0.95), 2) AS p95 FROM events GROUP BY 1)
 SELECT 'R' || row_number() OVER (ORDER BY root) AS name, waiting, (epoch_us(TIMESTAMP '2024-02-01') // 1000000 - epoch_us(oldest) // 1000000) AS oldest_seconds, n, p50, p95 FROM d FULL JOIN s USING (root)""",
    "folder_expansion": f"WITH {INV} SELECT root, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path FROM inv QUALIFY row_number() OVER (PARTITION BY root, folder ORDER BY path) BETWEEN 4 AND 6",
    "reconcile_round": f"""{DISK}, c AS (SELECT coalesce(disk.path, idx.path) AS path, CASE WHEN idx.path IS NULL THEN 'added' WHEN disk.path IS NULL THEN 'removed' WHEN disk.size_bytes = idx.size_bytes THEN 'same' ELSE 'changed' END AS change FROM disk FULL JOIN idx ON disk.path = idx.path)
 SELECT path, change FROM c WHERE change <> 'same' AND path > '/corpus/root0/src2' ORDER BY path LIMIT 100""",
    "verified_again": f"{DISK} SELECT disk.path IS NOT NULL AND disk.size_bytes = idx.size_bytes AS commit, count(*) AS n FROM idx LEFT JOIN disk ON disk.path = idx.path GROUP BY 1",
    "status_json": f"""WITH {INV}, c AS (SELECT s.status, count(inv.status) AS n FROM (SELECT unnest(['indexed', 'no_text', 'unsupported', 'too_large', 'encrypted', 'error']) AS status) s LEFT JOIN inv USING (status) GROUP BY 1)
 SELECT '{{"schemaVersion":1,"documents":' || sum(n) || ',"statuses":{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}}}' AS status FROM c""",
    "rescan_windows": "SELECT event_type, count(*) AS windows, sum(n)::BIGINT AS requests, sum(least(n, 4))::BIGINT AS at_most FROM (SELECT event_type, date_trunc('hour', ts) AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1",
    "pending_absorbed": f"WITH {INV}, p AS (SELECT path FROM inv UNION ALL SELECT unnest(['/corpus/root0/src2', '/corpus/root0/src4'])) SELECT path FROM p WHERE path NOT LIKE '/corpus/root0/src2/%' AND path NOT LIKE '/corpus/root0/src4/%'",
    "list_preview": f"{DISK} SELECT row_number() OVER (ORDER BY path) AS position, path, count(*) OVER () AS total, count(*) OVER () > 100 AS truncated FROM idx WHERE status = 'error' QUALIFY position <= 100",
}
