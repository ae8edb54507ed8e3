"""DuckDB SQL for the library's queries.  It shares no code with them but the names of their cases."""

from __future__ import annotations

LAYER, READ = "PDF_TEXT_LAYER", "OCR"


def _doc_pages(lines: int = 8) -> str:
    return f"""dl AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
dp AS (SELECT doc_id, p::INT AS page, array_to_string(ls[p * {lines} + 1 : p * {lines} + {lines}], chr(10)) AS text
       FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) - 1) // {lines} + 1)) AS p FROM dl))"""


CONV_PAGES = "cp AS (SELECT conv_id AS doc_id, turn::INT AS page, coalesce(text, '') AS text FROM conversations)"
CONV_CHARS = f"""{CONV_PAGES}, cl AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS at_line FROM cp),
cc AS (SELECT doc_id, page, at_line, length(line) AS len, unnest(string_split(line, '')) AS c, generate_subscripts(string_split(line, ''), 1) - 1 AS i FROM cl WHERE line <> '')"""


def _index(pages: str) -> str:
    size = "greatest(612.0, 6.0 * list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))))::DOUBLE AS page_w, (12.0 * (len(string_split(text, chr(10))) + 2))::DOUBLE AS page_h"
    return f"""ix AS (SELECT doc_id, page, '{LAYER}' AS source, CASE WHEN doc_id % 3 = 0 THEN '.' ELSE text END AS text, {size}, 1.0::DOUBLE AS conf, 0.0::DOUBLE AS dx FROM {pages}
 UNION ALL SELECT doc_id, page, '{READ}', translate(text, 'oO', '00'), {size}, 0.5::DOUBLE + (doc_id % 50) / 100, 1.5::DOUBLE FROM {pages} WHERE doc_id % 3 < 2)"""


DOC_INDEX = f"{_doc_pages()}, {_index('dp')}"
CONV_INDEX = f"{CONV_PAGES}, {_index('cp')}"
VISIBLE = r"length(regexp_replace(text, '[ \t\n]', '', 'g'))"


def _norm(cross_line: bool = True, ignore_ws: bool = False, case: bool = False) -> str:
    s = "text"
    if cross_line:
        s = rf"regexp_replace({s}, '[ \t]*(?:-[ \t]*)?\n[ \t]*', '', 'g')"
    else:
        s = rf"regexp_replace(regexp_replace({s}, '[ \t]*-[ \t]*\n[ \t]*', '', 'g'), '[ \t]*\n', chr(0), 'g')"
    s = rf"regexp_replace({s}, '[ \t]+', '{'' if ignore_ws else ' '}', 'g')"
    s = s if case else f"lower({s})"
    return f"CASE WHEN source = '{READ}' THEN translate({s}, 'oO', '00') ELSE {s} END"


def _matches(source: str, body: str, needle: str, keys: str, whole: bool = False) -> str:
    """mt: keys, ordinal, m_start, m_len; ``body`` and ``needle`` are expressions over ``source``."""
    cut = f"""mb AS (SELECT {keys}, {body} AS norm, {needle} AS needle FROM {source}),
mp AS (SELECT {keys}, norm, needle, unnest(string_split(norm, needle)) AS part, generate_subscripts(string_split(norm, needle), 1) AS k, len(string_split(norm, needle)) AS n FROM mb WHERE contains(norm, needle)),
ms AS (SELECT *, sum(length(part)) OVER (PARTITION BY {keys} ORDER BY k) + (k - 1) * length(needle) AS m_start FROM mp),
"""
    rule = r""" AND NOT regexp_matches(CASE WHEN m_start > 0 THEN substr(norm, m_start::INT, 1) ELSE '' END, '[\p{L}\p{Nd}_]')
 AND NOT regexp_matches(substr(norm, (m_start + length(needle) + 1)::INT, 1), '[\p{L}\p{Nd}_]')""" if whole else ""
    return cut + f"mt AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY m_start) - 1)::INT AS ordinal, m_start::BIGINT AS m_start, length(needle)::BIGINT AS m_len FROM ms WHERE k < n{rule})"


P = "doc_id, page, source"


def _needle(keyword: str) -> str:
    return f"CASE WHEN source = '{READ}' THEN '{keyword.replace('o', '0').replace('O', '0')}' ELSE '{keyword}' END"


def _hits(keyword: str, whole: bool = False) -> str:
    """ht: the hits of a keyword in conversations; hr: their rectangles by line."""
    return rf"""{CONV_INDEX}, {_matches('ix', _norm(), _needle(keyword), P, whole)},
mx AS (SELECT ix.* FROM ix SEMI JOIN mt USING (doc_id, page, source)),
tk AS (SELECT {P}, page_h, conf, dx, unnest(regexp_extract_all(text, '\n|[ \t]+|[^ \t\n]+')) AS token, generate_subscripts(regexp_extract_all(text, '\n|[ \t]+|[^ \t\n]+'), 1) AS seq FROM mx),
t2 AS (SELECT *, CASE WHEN token = chr(10) THEN 'n' WHEN regexp_matches(token, '^[ \t]') THEN 's' ELSE 'w' END AS kind,
   coalesce(sum(length(token)) OVER w, 0) AS start, coalesce(sum((token = chr(10))::INT) OVER w, 0) AS line FROM tk WINDOW w AS (PARTITION BY {P} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t3 AS (SELECT *, min(start) OVER (PARTITION BY {P}, line) AS line_start, lead(kind) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(kind, 3) OVER w AS k3, lag(kind) OVER w AS k0, lead(token) OVER w AS nx FROM t2 WINDOW w AS (PARTITION BY {P} ORDER BY seq)),
t4 AS (SELECT *, CASE kind WHEN 'w' THEN length(token) - (coalesce((k1 = 'n' OR (k1 = 's' AND k2 = 'n')) AND token LIKE '%-', false))::INT
   WHEN 's' THEN CASE WHEN coalesce(k1 = 'n', false) OR coalesce(k0 = 'n', false) OR coalesce(nx = '-' AND (k2 = 'n' OR (k2 = 's' AND k3 = 'n')), false) THEN 0 ELSE 1 END ELSE 0 END AS size FROM t3),
t5 AS (SELECT *, sum(size) OVER (PARTITION BY {P} ORDER BY seq) AS n_end FROM t4),
hl AS (SELECT {P}, ordinal, line, min(CASE WHEN kind = 'w' THEN 6.0 * (start - line_start) + dx END)::DOUBLE AS l, (max(page_h) - 12.0 * line - 12)::DOUBLE AS b,
   max(CASE WHEN kind = 'w' THEN 6.0 * (start - line_start) + dx + 6.0 * length(token) END)::DOUBLE AS r, (max(page_h) - 12.0 * line)::DOUBLE AS t, min(start) AS start, max(start + length(token)) AS stop, max(conf) AS conf
   FROM mt JOIN t5 USING (doc_id, page, source) WHERE n_end - size < m_start + m_len AND n_end > m_start GROUP BY {P}, ordinal, line),
hr AS (SELECT *, row_number() OVER (PARTITION BY {P}, ordinal ORDER BY line) - 1 AS n FROM hl WHERE l IS NOT NULL),
hs AS (SELECT {P}, ordinal, min(start) AS start, max(stop) AS stop, max(conf) AS conf FROM hl GROUP BY ALL HAVING count(l) > 0),
hb AS (SELECT {P}, ordinal, string_agg(printf('%.3f,%.3f,%.3f,%.3f', l, b, r, t), '|' ORDER BY line) AS boxes, min(l) AS l, min(b) AS b, max(r) AS r, max(t) AS t,
   arg_min(l, [-t, l]) AS first_l, arg_min(r, [-t, l]) AS first_r, max(t) AS first_t FROM hr GROUP BY ALL),
h0 AS (SELECT hs.*, text AS body, page_w, page_h, substr(text, (start + 1)::INT, (stop - start)::INT) AS matched, greatest(start - 24, 0) AS c0, least(stop + 24, length(text)) AS c1 FROM hs JOIN ix USING (doc_id, page, source)),
ht AS (SELECT h0.* EXCLUDE (body), substr(body, (c0 + 1)::INT, (c1 - c0)::INT) AS context, hb.* EXCLUDE (doc_id, page, source, ordinal),
   'psr_' || substr(sha256('doc=' || h0.doc_id || '|' || h0.page || '|' || h0.source || '|' || matched || '|' || boxes), 1, 24) AS result_id,
   row_number() OVER (PARTITION BY h0.doc_id ORDER BY h0.page, (h0.source = '{READ}')::INT, h0.ordinal) AS seq
   FROM h0 JOIN hb USING (doc_id, page, source, ordinal))"""


RANKED = "row_number() OVER (PARTITION BY doc_id ORDER BY page, 1 - first_t / page_h, first_l / page_w, source, result_id, ordinal)"


def _plan(where: str, order: str, cap: int, mid: str = "least(doc_id % 10, n - 1)") -> str:
    keep = f"WHERE rank <= {cap}" if cap else ""
    return f"""{CONV_PAGES}, pn AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) + 1 AS n FROM cp), pv AS (SELECT *, {mid} AS mid FROM pn),
pr AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS rank FROM pv WHERE {where}), pl AS (SELECT * FROM pr {keep})"""


OUTWARD = "abs(page - mid), page > mid"
STATES = f"""{_plan('true', OUTWARD, 5)}, {_index('cp')},
st AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 OR {VISIBLE} < 8 THEN 'OCR' ELSE 'TEXT' END AS route, text AS body FROM cp),
ss AS (SELECT st.doc_id, st.page, route, CASE WHEN route = 'TEXT' THEN 'COMPLETED' WHEN pl.rank IS NULL THEN 'SKIPPED' WHEN st.doc_id % 3 < 2 AND body <> '' THEN 'COMPLETED' ELSE 'FAILED' END AS state FROM st LEFT JOIN pl USING (doc_id, page))"""
COLUMNS = f"""{_doc_pages(12)},
bl AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS id FROM dp),
bx AS (SELECT doc_id, page, id, x AS l, x + w AS r, 12.0::DOUBLE * id AS t FROM (SELECT *, (CASE WHEN id % 9 = 8 THEN 0 WHEN id % 2 = 1 THEN 320 ELSE 0 END)::DOUBLE AS x, (CASE WHEN id % 9 = 8 THEN 600 ELSE 6 * least(length(line), 40) END)::DOUBLE AS w FROM bl)),
nr AS (SELECT *, (l + r) / 2 AS c FROM bx WHERE r - l < 307.2 AND r > l),
nk AS (SELECT *, row_number() OVER w AS i, lead(c) OVER w AS nc, count(*) OVER (PARTITION BY doc_id, page) AS n FROM nr WINDOW w AS (PARTITION BY doc_id, page ORDER BY c, l, r)),
bs AS (SELECT doc_id, page, (nc + c) / 2 AS split FROM nk WHERE n >= 4 AND i >= 2 AND n - i >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY nc - c DESC, i) = 1 AND nc - c >= 0.16 * 640),
sp AS (SELECT doc_id, page, max(split) AS split FROM nr JOIN bs USING (doc_id, page) GROUP BY ALL HAVING min(l) FILTER (c >= split) - max(r) FILTER (c < split) >= 0.35 * 0.16 * 640)"""
WORDS = rf"""{CONV_PAGES},
wi AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN '.' ELSE text END AS text FROM cp),
wt AS (SELECT doc_id, page, unnest(regexp_extract_all(text, '\n|[ \t]+|[^ \t\n]+')) AS token, (generate_subscripts(regexp_extract_all(text, '\n|[ \t]+|[^ \t\n]+'), 1) - 1)::INT AS seq FROM wi),
wo AS (SELECT *, coalesce(sum(length(token)) OVER w, 0) AS start, coalesce(sum((token = chr(10))::INT) OVER w, 0) AS line FROM wt WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wl AS (SELECT *, min(start) OVER (PARTITION BY doc_id, page, line) AS ls FROM wo),
wb AS (SELECT doc_id, page, seq, token, 6.0::DOUBLE * (start - ls) AS l, 6.0::DOUBLE * (start - ls + length(token)) AS r, 12.0::DOUBLE * line AS t, 12.0::DOUBLE * line + 10 AS b FROM wl WHERE NOT regexp_matches(token, '^[ \t\n]'))"""
LENGTHS = "xl AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)::DOUBLE) AS xs FROM documents)"
OPENING, CLOSING, TIGHT = "([{<（［｛《〈「『【〔〖〘〚“‘", ")]}>）］｝》〉」』】〕〗〙〛，。！？；：、,.!?;:%％", "-‐‑‒–—_/\\''’·•"


def _suppressed(before: str, after: str) -> str:
    return f"({before} = '' OR {after} = '' OR contains('{OPENING}', {before}) OR contains('{CLOSING}', {after}) OR contains('{TIGHT}', {before}) OR contains('{TIGHT}', {after}))"


def _latin(c: str) -> str:
    return rf"regexp_matches({c}, '[\p{{Latin}}\p{{Nd}}]')"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["page_scan_stats"] = f"WITH {DOC_INDEX} SELECT doc_id, source, max(page) + 1 AS n_pages, sum(length(text))::BIGINT AS raw_chars, sum({VISIBLE})::BIGINT AS visible_chars, sum({VISIBLE})::BIGINT AS valid_boxes FROM ix GROUP BY ALL"
    q["usable_text_layer"] = f"WITH {DOC_INDEX} SELECT doc_id, page, {VISIBLE} AS visible_chars FROM ix WHERE source = '{LAYER}' AND {VISIBLE} >= 8"
    variants = {"basic": {}, "no_crossline": {"cross_line": False}, "ignore_ws": {"ignore_ws": True}, "case_sensitive": {"case": True}}
    for name, options in variants.items():
        q[f"normalize_page_{name}"] = f"WITH {DOC_INDEX} SELECT {P}, {_norm(**options)} AS norm FROM ix"
    for name, keyword, options, whole in (
        ("literal", "the", {}, False), ("rare", "worthless", {}, False), ("case", "The", {"case": True}, False), ("wholeword", "on", {}, True), ("crossline", ".the", {}, False), ("ignore_ws", "inthe", {"ignore_ws": True}, False),
    ):
        q[f"search_{name}"] = f"WITH {_doc_pages()}, {_matches(f'''(SELECT *, '{LAYER}' AS source FROM dp)''', _norm(**options), f'''{chr(39)}{keyword}{chr(39)}''', 'doc_id, page', whole)} SELECT doc_id, page, ordinal, m_start FROM mt"
    # Pages in other forms: what the plain ones hold, but CR LF is two breaks and takes two hyphens.
    twice = _norm().replace("(?:-[ \\t]*)?", "(?:-[ \\t]*)?(?:-[ \\t]*)?")
    q["normalize_page_forms"] = f"WITH {CONV_INDEX} SELECT {P}, {twice} AS norm FROM ix"
    q["search_forms"] = f"WITH {CONV_INDEX}, {_matches('ix', twice, _needle('the'), P)} SELECT {P}, ordinal, m_start FROM mt"
    q["search_wide_tokens"] = f"WITH {_hits('the', True)} SELECT {P}, ordinal, start::BIGINT AS start, (stop - start)::BIGINT AS length, matched FROM ht"
    q["search_cases"] = "SELECT * FROM (VALUES (0::BIGINT, 0::INT, 0::BIGINT, 3::BIGINT), (1, 0, 0, 12), (2, 0, 0, 7), (3, 0, 0, 4), (4, 0, 0, 2), (5, 0, 0, 6), (6, 0, 0, 4), (8, 0, 2, 4), (10, 0, 0, 4), (11, 0, 0, 3), (12, 0, 0, 3), (12, 1, 4, 3)) v(doc_id, ordinal, m_start, m_len)"
    q["search_context"] = f"WITH {_hits('the')} SELECT {P}, ordinal, matched, start::BIGINT AS start, (stop - start)::BIGINT AS length, context, (start - c0)::BIGINT AS ctx_start, (stop - c0)::BIGINT AS ctx_end, conf FROM ht"
    q["search_rects"] = f"WITH {_hits('.the')} SELECT {P}, ordinal, n, l, b, r, t FROM hr"
    q["search_result_id"] = f"WITH {_hits('the')} SELECT {P}, ordinal, result_id FROM ht"
    ascii_lower = "translate(replace(replace(text, chr(10), ''), chr(13), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    q["search_native"] = f"WITH {_doc_pages()}, {_matches('dp', ascii_lower, chr(39) + 'the' + chr(39), 'doc_id, page')} SELECT doc_id, page, ordinal, m_start FROM mt"
    flat = r"regexp_replace(lower(text), '\s+', ' ', 'g')"
    q["multi_keyword"] = f"""WITH k AS (SELECT item_id, {flat} AS needle FROM benchmark WHERE trim(text) <> ''), d AS (SELECT doc_id, {flat} AS flat FROM documents)
SELECT item_id, doc_id, ((length(flat) - length(replace(flat, needle, ''))) // length(needle))::BIGINT AS n FROM d JOIN k ON contains(flat, needle)"""
    q["hits_per_source"] = f"WITH {DOC_INDEX}, {_matches('ix', _norm(), _needle('the'), P)} SELECT source, count(*) AS hits, count(DISTINCT (doc_id, page)) AS pages FROM mt GROUP BY source"
    q["source_union"] = f"WITH {CONV_INDEX} SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS indexes FROM ix GROUP BY doc_id"
    overlap = "greatest(0, least(a.r, z.r) - greatest(a.l, z.l)) * greatest(0, least(a.t, z.t) - greatest(a.b, z.b))"
    key = r"lower(regexp_replace({}.matched, '\s+', '', 'g'))"
    q["cross_source_dedup"] = f"""WITH {_hits('the')} SELECT doc_id, page, source, ordinal, seq::INT AS seq FROM ht z WHERE NOT EXISTS (SELECT 1 FROM ht a WHERE a.doc_id = z.doc_id AND a.page = z.page AND {key.format('a')} = {key.format('z')} AND a.seq < z.seq
 AND {overlap} >= 0.65 * ((a.r - a.l) * (a.t - a.b) + (z.r - z.l) * (z.t - z.b) - {overlap}))"""
    q["distinct_result_ids"] = f"WITH {_hits('the')} SELECT doc_id, min(seq)::INT AS seq, result_id FROM ht GROUP BY doc_id, result_id"
    q["reading_order"] = f"WITH {_hits('the')} SELECT {P}, ordinal, {RANKED} AS rank FROM ht"
    q["topk_results"] = f"WITH {_hits('the')}, hd AS (SELECT * FROM ht QUALIFY row_number() OVER (PARTITION BY doc_id, result_id ORDER BY seq) = 1), hk AS (SELECT *, {RANKED} AS rank FROM hd) SELECT doc_id, result_id, rank FROM hk WHERE rank <= 5"
    for name, plan in (("outward", _plan("true", OUTWARD, 5)), ("natural", _plan("page >= least(2, n - 1)", "page", 0)), ("targets", _plan("page IN (1, 4, 6)", OUTWARD, 2)), ("current", _plan("page = mid", OUTWARD, 5))):
        q[f"page_plan_{name}"] = f"WITH {plan} SELECT doc_id, page, rank FROM pl"
    q["stop_after_first"] = f"WITH {_plan('true', OUTWARD, 5)}, {_index('cp')}, {_matches(f'''(SELECT * FROM ix WHERE source = '{READ}')''', _norm(), _needle('the'), P)}, sf AS (SELECT mt.*, rank, min(rank) OVER (PARTITION BY doc_id) AS first FROM mt JOIN pl USING (doc_id, page)) SELECT doc_id, page, ordinal, m_start FROM sf WHERE rank = first"
    ratio = "greatest(0, least(1, {}))"
    q["viewer_highlights"] = f"""WITH {_hits('.the')}, hx AS (SELECT doc_id, page, source, matched, result_id, {ratio.format('hr.l / page_w')} AS l, {ratio.format('1 - hr.t / page_h')} AS t FROM hr JOIN (SELECT {P}, ordinal, matched, result_id, page_w, page_h FROM ht) USING (doc_id, page, source, ordinal)),
hn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, t, l, result_id, source) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM hx)
SELECT {P}, matched, round(l, 6) AS l, round(t, 6) AS t, n, CASE WHEN n = c THEN 1 ELSE n + 1 END AS next, CASE WHEN n = 1 THEN c ELSE n - 1 END AS previous FROM hn"""
    q["page_routing"] = f"WITH {DOC_INDEX} SELECT doc_id, page, CASE WHEN {VISIBLE} >= 8 THEN 'BOTH' ELSE 'OCR' END AS route FROM ix WHERE source = '{LAYER}'"
    q["unresolved_pages"] = f"WITH {STATES} SELECT doc_id, page, route, state FROM ss WHERE state <> 'COMPLETED'"
    q["search_summary"] = f"""WITH {STATES}, {_matches('ix', _norm(), _needle('the'), P)}, hc AS (SELECT doc_id, count(*) AS results FROM mt GROUP BY doc_id),
sc AS (SELECT doc_id, count(*) AS target, count(*) FILTER (state = 'COMPLETED') AS completed, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'SKIPPED') AS skipped FROM ss GROUP BY doc_id),
sr AS (SELECT sc.*, coalesce(results, 0) AS results FROM sc LEFT JOIN hc USING (doc_id))
SELECT *, skipped > 0 OR results > 20 AS limited, failed = 0 AND skipped = 0 AND results <= 20 AS complete FROM sr"""
    page_key = f"'doc=' || doc_id || '#page=' || page || '#source=' || source || '#versions=3.1' || CASE WHEN source = '{READ}' THEN '#ocrWidth=1280#ocrNamespace=1.32' ELSE '' END"
    q["cache_misses"] = f"WITH {CONV_INDEX} SELECT {P}, {page_key} AS key, sha256({page_key}) || '.pidx' AS file_name FROM ix WHERE page % 2 = 1"
    q["document_fingerprint"] = """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents)
SELECT doc_id, substr(sha256(encode('doc=' || doc_id) || unhex(lpad(to_hex(octet_length(body)), 16, '0')) || body[1:65536] || CASE WHEN octet_length(body) > 65536 THEN body[octet_length(body) - 65535:octet_length(body)] ELSE ''::BLOB END), 1, 32) AS fingerprint FROM b"""
    q["column_split"] = f"WITH {COLUMNS} SELECT doc_id, page, split FROM sp"
    q["block_reading_order"] = f"""WITH {COLUMNS}, ob AS (SELECT bx.*, split, split IS NOT NULL AND l < split AND r > split AND r - l >= 307.2 AS spanning FROM bx LEFT JOIN sp USING (doc_id, page)),
od AS (SELECT *, coalesce(sum(spanning::INT) OVER (PARTITION BY doc_id, page ORDER BY t, l, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM ob)
SELECT doc_id, page, id, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, spanning, CASE WHEN split IS NOT NULL AND NOT spanning AND (l + r) / 2 >= split THEN 1 ELSE 0 END, t, l, id) AS rank FROM od"""
    q["geometric_line_breaks"] = f"WITH {CONV_PAGES}, gl AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM cp) SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS line, length(t)::BIGINT AS n_chars FROM gl WHERE t <> ''"
    before, after = "right(pt, 1)", "left(token, 1)"
    q["block_separators"] = f"""WITH {WORDS}, wp AS (SELECT *, lag(token) OVER w AS pt, lag(l) OVER w AS pl, lag(r) OVER w AS pr, lag(t) OVER w AS ptop FROM wb WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq)),
wk AS (SELECT *, CASE WHEN pl IS NULL THEN 'FIRST' WHEN ptop <> t OR l - pr > 35 THEN 'LINE_BREAK' WHEN l - pr <= 0 OR {_suppressed(before, after)} THEN 'NONE'
 WHEN l - pr >= greatest(1.5, 6 * CASE WHEN {_latin(before)} AND {_latin(after)} THEN 0.42 ELSE 0.45 END, 1) THEN 'SPACE' ELSE 'NONE' END AS separator FROM wp)
SELECT doc_id, page, separator, count(*) AS n FROM wk GROUP BY ALL"""
    q["space_recovery"] = f"""WITH {CONV_PAGES}, sl AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS t, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line FROM cp),
sc AS (SELECT doc_id, page, line, unnest(string_split(t, '')) AS token, generate_subscripts(string_split(t, ''), 1) - 1 AS seq FROM sl),
sv AS (SELECT *, lag(token) OVER w AS pt, seq - lag(seq) OVER w AS d FROM sc WHERE token NOT IN ('', ' ') WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY seq)),
su AS (SELECT *, count(d) OVER (PARTITION BY doc_id, page, line) AS gaps, quantile_disc(d, 0.35) OVER (PARTITION BY doc_id, page, line) AS rough, list(d) OVER (PARTITION BY doc_id, page, line) AS ds FROM sv),
sg AS (SELECT *, CASE WHEN gaps >= 3 THEN list_sort(list_filter(ds, lambda x: x IS NOT NULL))[floor((gaps - 1) * 0.35 + 0.5)::INT + 1] * 0.01 - 0.009 ELSE 0 END AS base FROM su)
SELECT doc_id, page, line, count(*) AS spaces, sum(seq)::BIGINT AS places FROM sg WHERE d IS NOT NULL AND NOT {_suppressed('pt', 'token')}
 AND d * 0.01 - 0.009 >= greatest(0.004, 0.009 * CASE WHEN {_latin('pt')} AND {_latin('token')} THEN 0.42 ELSE 0.45 END, 2.6 * base) GROUP BY ALL"""
    q["coord_bitmap_to_pdf"] = f"WITH {WORDS} SELECT doc_id, page, seq, round(l / 1280 * 612, 6) AS l, round(792 - b / 1810 * 792, 6) AS b, round(r / 1280 * 612, 6) AS r, round(792 - t / 1810 * 792, 6) AS t FROM wb"
    r01 = "greatest(0.0, least(1.0, {}))"
    q["coord_page_ratio"] = f"WITH {WORDS}, wr AS (SELECT doc_id, page, seq, {r01.format('l / 612')} AS l, {r01.format('1 - t / 792')} AS b, {r01.format('r / 612')} AS r, {r01.format('1 - b / 792')} AS t FROM wb) SELECT doc_id, page, seq, round(l, 6)::DOUBLE AS l, round(b, 6)::DOUBLE AS b, round(r, 6)::DOUBLE AS r, round(t, 6)::DOUBLE AS t FROM wr WHERE r > l AND b > t"
    q["quad_map"] = f"""WITH {WORDS}, qp AS (SELECT *, l + (r - l) * 0.25 AS ux, t + 0.25 AS uy, l + 2 + (r - l) * 0.25 AS vx, b - 1 + 0.25 AS vy FROM wb)
SELECT doc_id, page, seq, round(ux + (vx - ux) * 0.75, 6)::DOUBLE AS x, round(uy + (vy - uy) * 0.75, 6)::DOUBLE AS y,
 round(abs(l * (t + 1) - t * r + r * b - (t + 1) * (r + 2) + (r + 2) * (b - 1) - b * (l + 2) + (l + 2) * t - (b - 1) * l) / (2 * sqrt((r - l) ^ 2 + 1) + 2 * sqrt(4 + (b - t - 1) ^ 2)), 6) AS grow FROM qp"""
    q["median_gap"] = f"WITH {LENGTHS} SELECT doc_id, coalesce(list_median(list_filter(xs, lambda x: x > 0)), 0.0)::DOUBLE AS median FROM xl"
    q["lower_quantile"] = f"WITH {LENGTHS} SELECT doc_id, list_sort(xs)[floor((len(xs) - 1) * 0.35 + 0.5)::INT + 1] AS q35 FROM xl"
    q["weighted_quantile"] = f"""WITH {LENGTHS}, xe AS (SELECT doc_id, unnest(xs)::BIGINT AS x, generate_subscripts(xs, 1) - 1 AS i FROM xl),
xr AS (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(x) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM xe)
SELECT doc_id, {', '.join(f'coalesce(min(i) FILTER (upto > floor(total * {p}::DOUBLE)), max(n) - 1)::BIGINT AS at_{a}' for p, a in ((0.005, 5), (0.5, 500), (0.995, 995)))} FROM xr GROUP BY doc_id"""
    q["protocol_decode"] = f"WITH {CONV_PAGES} SELECT doc_id, page, text, length(text)::BIGINT AS raw_chars, {VISIBLE}::BIGINT AS n_boxed FROM cp"
    norm = _norm().replace("source", f"'{LAYER}'")
    q["incremental_pages"] = f"WITH {CONV_PAGES}, ic AS (SELECT doc_id, page, ((length(n) - length(replace(n, 'the', ''))) // 3)::BIGINT AS n_hits FROM (SELECT *, {norm} AS n FROM cp)) SELECT *, (sum(n_hits) OVER (PARTITION BY doc_id ORDER BY page))::BIGINT AS total FROM ic"
    q["limit_while_scanning"] = f"WITH {_plan('true', OUTWARD, 5)}, {_index('cp')}, {_matches(f'''(SELECT * FROM ix WHERE source = '{READ}')''', _norm(), _needle('the'), P)} SELECT doc_id, page, ordinal, m_start FROM mt JOIN pl USING (doc_id, page) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, ordinal) <= 3"
    counted = f"WITH {CONV_PAGES}, tn AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS last FROM cp) SELECT doc_id, page FROM tn WHERE "
    q["target_pages_exact"] = counted + "page IN (0, 2, 99)"
    q["target_pages_range"] = counted + "page BETWEEN least(1, last) AND greatest(least(1, last), least(3, last))"
    q["target_pages_current"] = counted + "page = least(2, last)"
    layer = f"(SELECT * FROM ix WHERE source = '{LAYER}')"
    asked = f"WITH {DOC_INDEX}, {_matches(layer, _norm(), chr(39) + 'the' + chr(39), P)} SELECT doc_id, page FROM ix WHERE source = '{LAYER}' AND "
    q["ocr_request_pages"] = asked + f"({VISIBLE} < 8 OR (doc_id, page) NOT IN (SELECT (doc_id, page) FROM mt))"
    q["ocr_request_unusable"] = f"WITH {DOC_INDEX} SELECT doc_id, page FROM ix WHERE source = '{LAYER}' AND {VISIBLE} < 8"
    q["ocr_request_documents"] = asked + "doc_id NOT IN (SELECT doc_id FROM mt)"
    q["preferred_source"] = f"WITH {CONV_INDEX} SELECT doc_id, page, max(source) AS source FROM ix GROUP BY doc_id, page"
    q["error_codes"] = f"""WITH {CONV_PAGES}, el AS (SELECT doc_id, page, lower(text) AS m FROM cp)
SELECT doc_id, page, CASE WHEN regexp_matches(m, 'password|encrypt') THEN 7 WHEN regexp_matches(m, 'corrupt|damaged|malformed|损坏') THEN 8
 WHEN regexp_matches(m, 'ocr|model|模型') AND regexp_matches(m, 'init|load|初始化|加载') THEN 9 WHEN page % 2 = 0 THEN 10 ELSE 9 END AS code FROM el"""
    q["coord_bitmap_ratio"] = f"WITH {WORDS}, wr AS (SELECT doc_id, page, seq, {r01.format('l / 320')} AS l, {r01.format('b / 90')} AS b, {r01.format('r / 320')} AS r, {r01.format('t / 90')} AS t FROM wb) SELECT doc_id, page, seq, round(l, 6)::DOUBLE AS l, round(b, 6)::DOUBLE AS b, round(r, 6)::DOUBLE AS r, round(t, 6)::DOUBLE AS t FROM wr WHERE r > l AND b > t"
    q["coord_viewer_rect"] = f"WITH {WORDS}, wr AS (SELECT doc_id, page, seq, {r01.format('l / 640')} AS l, {r01.format('b / 480')} AS b, {r01.format('r / 640')} AS r, {r01.format('t / 480')} AS t FROM wb) SELECT doc_id, page, seq, round(l * 300, 6)::DOUBLE AS l, round(b * 400 + page * 400, 6)::DOUBLE AS b, round(r * 300, 6)::DOUBLE AS r, round(t * 400 + page * 400, 6)::DOUBLE AS t FROM wr WHERE r > l AND b > t"
    q["page_centre_offset"] = f"WITH {CONV_INDEX} SELECT doc_id, page, round((max(page_w) OVER (PARTITION BY doc_id) - page_w) * ((page + 300) / page_w) / 2, 6)::DOUBLE AS \"offset\" FROM ix WHERE source = '{LAYER}'"
    side = "greatest(32, least(1280, round(round({} * CASE WHEN greatest(w, h) > 1280 THEN 1280 / greatest(w, h) ELSE 1 END) / 32) * 32))::INT"
    q["detection_input"] = f"WITH {CONV_INDEX}, ds AS (SELECT doc_id, page, page_w * 3 AS w, page_h * 3 AS h FROM ix WHERE source = '{LAYER}') SELECT doc_id, page, {side.format('w')} AS w, {side.format('h')} AS h, (ceil(greatest(960, least(2048, greatest(w, h))) / 32) * 32)::INT AS side FROM ds"
    q["fallback_tokens"] = f"WITH {WORDS}, ft AS (SELECT *, unnest(range(length(token))) AS n FROM wb) SELECT doc_id, page, seq, n, substr(token, n::INT + 1, 1) AS token, round(l + n * (r + 1 - l) / length(token), 6)::DOUBLE AS l, round(l + (n + 1) * (r + 1 - l) / length(token), 6)::DOUBLE AS r FROM ft"
    q["neighbour_clamp"] = f"""WITH {WORDS}, nc AS (SELECT doc_id, page, seq, l - 4 AS l, r + 4 AS r, lag(l - 4) OVER w AS pl, lag(r + 4) OVER w AS pr, lead(l - 4) OVER w AS nl, lead(r + 4) OVER w AS nr FROM wb WINDOW w AS (PARTITION BY doc_id, page, t ORDER BY seq)),
nx AS (SELECT *, CASE WHEN pr > l THEN greatest(l, ((pl + pr) / 2 + (l + r) / 2) / 2) ELSE l END AS a, CASE WHEN nl < r THEN least(r, ((nl + nr) / 2 + (l + r) / 2) / 2) ELSE r END AS z FROM nc)
SELECT doc_id, page, seq, round(CASE WHEN z > a THEN a ELSE l END, 6)::DOUBLE AS l, round(CASE WHEN z > a THEN z ELSE r END, 6)::DOUBLE AS r FROM nx"""
    q["detect_boxes"] = f"""WITH {CONV_PAGES}, db AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM cp),
dg AS (SELECT *, 6 * length(line) - 1 AS w, 7.0::DOUBLE * (6 * length(line) - 1) / (6 * length(line) + 6) AS d FROM db WHERE line <> '')
SELECT doc_id, page, 2 * floor(8.5 - d)::BIGINT AS l, 2 * floor(24 * i + 8.5 - d)::BIGINT AS t, 2 * floor(8.5 + w + d)::BIGINT AS r, 2 * floor(24 * i + 15.5 + d)::BIGINT AS b FROM dg"""
    q["ctc_decode_lines"] = f"""WITH {CONV_CHARS}
SELECT doc_id, page, at_line, string_agg(unicode(c)::VARCHAR, ',' ORDER BY i) AS codes, round(avg(0.5 + (i % 32) / 64), 6) AS conf FROM cc WHERE c <> '' GROUP BY doc_id, page, at_line"""
    q["ctc_cells_lines"] = f"""WITH {CONV_CHARS}, cr AS (SELECT doc_id, page, at_line, len * 8 AS steps, i * 8 AS b, i * 8 + unicode(c) % 3 AS z FROM cc)
SELECT doc_id, page, at_line, b::BIGINT AS begin, coalesce((lag(z) OVER w + b + 1) / 2, 0)::DOUBLE AS left_step, coalesce((z + lead(b) OVER w + 1) / 2, steps)::DOUBLE AS right_step FROM cr WINDOW w AS (PARTITION BY doc_id, page, at_line ORDER BY b)"""
    q["token_ink_boxes_lines"] = f"""WITH {CONV_CHARS}, ck AS (SELECT *, unicode(c) % 5 <> 0 AS ink, bool_or(unicode(c) % 5 <> 0) OVER (PARTITION BY doc_id, page, at_line) AS inked FROM cc WHERE trim(c) <> '')
SELECT doc_id, page, at_line, row_number() OVER (PARTITION BY doc_id, page, at_line ORDER BY i) - 1 AS n, round((6 * i + CASE WHEN ink THEN 1 ELSE 0 END) / (6.0::DOUBLE * len), 6) AS l, CASE WHEN inked THEN round(1 / 12.0::DOUBLE, 6) ELSE 0.0::DOUBLE END AS t,
 round((6 * i + CASE WHEN ink THEN 5 ELSE 6 END) / (6.0::DOUBLE * len), 6) AS r, CASE WHEN inked THEN round(11 / 12.0::DOUBLE, 6) ELSE 1.0::DOUBLE END AS b FROM ck"""
    q["cache_victims"] = f"""WITH {CONV_PAGES}, cf AS (SELECT doc_id || '-' || page AS name, length(text)::BIGINT AS size, doc_id * 3600000 + page * 250 AS mtime FROM cp)
SELECT name, size, mtime FROM cf QUALIFY sum(size) OVER (ORDER BY mtime DESC, name DESC) > 40000"""
    q["retry_pages"] = f"WITH {CONV_PAGES} SELECT doc_id, page FROM cp WHERE page % 6 = 0"
    q["page_metrics"] = f"""WITH {CONV_PAGES} SELECT doc_id, page, ['MEMORY', 'DISK', 'NONE'][page % 3 + 1] AS cache_source, page % 3 < 2 AS cache_hit, greatest(0, length(text) - 500)::BIGINT AS match_ms, length(text)::BIGINT AS total_ms FROM cp"""
    q["debug_geometry"] = f"""WITH {WORDS}, dw AS (SELECT *, length(token) AS len FROM wb), dc AS (SELECT *, unnest(range(len)) AS k FROM dw),
dx AS (SELECT doc_id, page, seq, 0 AS n, 'DETECTION_BLOCK' AS kind, token AS label, l, t, r, b FROM dw
 UNION ALL SELECT doc_id, page, seq, k + 1, 'TOKEN_BOX', substr(token, k::INT + 1, 1), l + (r - l) * k / len, t + 2.5 + CASE WHEN seq % 2 = 1 THEN 2.0 * k / len ELSE 0 END,
  l + (r - l) * (k + 1) / len, t + 7.5 + CASE WHEN seq % 2 = 1 THEN 2.0 * (k + 1) / len ELSE 0 END FROM dc),
dr AS (SELECT doc_id, page, seq, n, kind, label, {r01.format('l / 320')} AS l, {r01.format('t / 90')} AS t, {r01.format('r / 320')} AS r, {r01.format('b / 90')} AS b FROM dx)
SELECT doc_id, page, seq, n::BIGINT AS n, kind, label, round(l, 6)::DOUBLE AS l, round(t, 6)::DOUBLE AS t, round(r, 6)::DOUBLE AS r, round(b, 6)::DOUBLE AS b FROM dr WHERE r > l AND b > t"""
    q["protocol_matches"] = f"""WITH {CONV_PAGES}, pm AS (SELECT doc_id, page, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM cp),
po AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id, page ORDER BY i) - length(line) - 1 AS start, count(*) FILTER (line <> '') OVER (PARTITION BY doc_id, page) AS n FROM pm)
SELECT doc_id, 9 AS n_pages, page, page % 3 AS status, length(text)::INT AS raw_chars, n::INT AS n_matches, i::INT AS ordinal, start::INT AS start, length(line)::INT AS length, 0.0::DOUBLE AS l, 12.0::DOUBLE * i AS b, 6.0::DOUBLE * length(line) AS r, 12.0::DOUBLE * i + 12 AS t FROM po WHERE line <> ''
 UNION ALL SELECT DISTINCT doc_id, 9, page, page % 3, length(text)::INT, 0, NULL::INT, NULL::INT, NULL::INT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM po WHERE n = 0"""
    q["protocol_legacy"] = f"WITH {WORDS} SELECT doc_id, page::DOUBLE AS page, seq::DOUBLE AS seq, l, t, r, b, 6.0::DOUBLE AS glyph FROM wb"
    known = f"(unicode(c) BETWEEN 33 AND 126 OR unicode(c) BETWEEN 161 AND 255)"
    blocks = f"""{CONV_PAGES}, rl AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM cp),
rc AS (SELECT doc_id, page, i, length(line) AS n, unnest(string_split(line, '')) AS c, generate_subscripts(string_split(line, ''), 1) - 1 AS k FROM rl WHERE line <> ''),
rv AS (SELECT *, lag(c) OVER w AS pc, k - lag(k) OVER w AS d FROM rc WHERE {known} WINDOW w AS (PARTITION BY doc_id, page, i ORDER BY k)),
ru AS (SELECT *, list_sort(list(d) FILTER (d IS NOT NULL) OVER (PARTITION BY doc_id, page, i)) AS ds FROM rv),
rg AS (SELECT *, CASE WHEN len(ds) >= 3 THEN (ds[floor((len(ds) - 1) * 0.35 + 0.5)::INT + 1] - 0.87) / n ELSE 0 END AS base FROM ru),
rs AS (SELECT *, coalesce(d IS NOT NULL AND NOT {_suppressed('pc', 'c')} AND (d - 0.87) / n >= greatest(0.004, 0.87 / n * CASE WHEN {_latin('pc')} AND {_latin('c')} THEN 0.42 ELSE 0.45 END, 2.6 * base), false) AS space FROM rg),
rt AS (SELECT doc_id, page, i, string_agg(CASE WHEN space THEN ' ' || c ELSE c END, '' ORDER BY k) AS t, count(*) + count(*) FILTER (space) AS toks, count(*) AS seen, max(k) AS last_k, max(n) AS n FROM rs GROUP BY ALL),
rp AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY i) AS text, sum(toks) + count(*) - 1 AS n_tokens, sum(seen) AS seen, avg(0.5 + i % 8 / 16.0) AS conf, arg_max(last_k * 6 / 2, i) AS last_l, 2500 - max(14.0 * i + 1) / 2 AS last_t, count(*) - 1 AS last_line FROM rt GROUP BY ALL)"""
    q["recognised_pages"] = f"""WITH {blocks} SELECT doc_id, page, coalesce(rp.text, '') AS text, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(seen, 0)::BIGINT AS visible_chars, coalesce(seen, 0)::BIGINT AS valid_boxes, round(coalesce(conf, -1), 6)::DOUBLE AS conf, round(last_l, 6)::DOUBLE AS last_l, round(last_t, 6)::DOUBLE AS last_t, last_line::BIGINT AS last_line FROM cp LEFT JOIN rp USING (doc_id, page)"""
    read = _norm().replace("source", f"'{READ}'")
    q["recognised_hits"] = f"WITH {blocks}, rn AS (SELECT doc_id, page, {read} AS n FROM rp) SELECT doc_id, page, ((length(n) - length(replace(n, 'the', ''))) // 3)::BIGINT AS hits FROM rn WHERE contains(n, 'the')"
    q["text_layer_pages"] = f"""WITH {CONV_PAGES}, tl AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM cp),
tp AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY i) AS text, sum(length(line)) AS n, count(*) AS k FROM tl WHERE line <> '' GROUP BY ALL)
SELECT doc_id, page, coalesce(tp.text, '') AS text, CASE WHEN page % 4 = 3 THEN 1 ELSE 0 END AS status, CASE WHEN page % 4 = 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS conf, coalesce(n + k - 1, 0)::BIGINT AS n_tokens, coalesce(k - 1, 0)::BIGINT AS last_line, coalesce(10.0 * n, 0)::DOUBLE AS heights FROM cp LEFT JOIN tp USING (doc_id, page)"""
    columns = lambda rows, key: f"""fr AS ({rows}),
fn AS (SELECT *, (x0 + x1) / 2 AS c FROM fr WHERE x1 - x0 < 0.48 AND x1 > x0),
fk AS (SELECT *, row_number() OVER w AS i, lead(c) OVER w AS nc, count(*) OVER (PARTITION BY doc_id, page) AS n FROM fn WINDOW w AS (PARTITION BY doc_id, page ORDER BY c, x0, x1)),
fb AS (SELECT doc_id, page, (nc + c) / 2 AS split FROM fk WHERE n >= 4 AND i >= 2 AND n - i >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY nc - c DESC, i) = 1 AND nc - c >= 0.16),
fs AS (SELECT doc_id, page, max(split) AS split FROM fn JOIN fb USING (doc_id, page) GROUP BY ALL HAVING min(x0) FILTER (c >= split) - max(x1) FILTER (c < split) >= 0.35 * 0.16),
fo AS (SELECT fr.*, CASE WHEN split IS NOT NULL AND (x0 + x1) / 2 >= split THEN 1 ELSE 0 END::BIGINT AS "column" FROM fr LEFT JOIN fs USING (doc_id, page)),
fz AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, "column", y0, x0, {key}) AS rank FROM fo)"""  # noqa: E731
    kept = f"""SELECT *, greatest(0.0, least(1.0, first_l / page_w)) AS x0, greatest(0.0, least(1.0, first_r / page_w)) AS x1, greatest(0.0, least(1.0, 1 - first_t / page_h)) AS y0 FROM hd z WHERE NOT EXISTS (SELECT 1 FROM hd a WHERE a.doc_id = z.doc_id AND a.page = z.page AND {key.format('a')} = {key.format('z')} AND a.seq < z.seq
 AND {overlap} >= 0.65 * ((a.r - a.l) * (a.t - a.b) + (z.r - z.l) * (z.t - z.b) - {overlap}))"""
    q["finalized_results"] = f"""WITH {_hits('the')}, hd AS (SELECT * FROM ht QUALIFY row_number() OVER (PARTITION BY doc_id, result_id ORDER BY seq) = 1), {columns(kept, 'source, result_id, ordinal')}
SELECT {P}, ordinal, "column", rank FROM fz WHERE rank <= 20"""
    lines = "SELECT doc_id, page, id, l / 640 AS x0, r / 640 AS x1, 1 - (2000 - t) / 2000 AS y0 FROM bx WHERE r > l"
    q["column_order"] = f"""WITH {COLUMNS}, {columns(lines, 'id')} SELECT doc_id, page, id AS ordinal, "column", rank FROM fz"""
    q["stored_pages"] = f"WITH {CONV_INDEX} SELECT {page_key} AS key, CASE WHEN page NOT IN (1, 2, 3, 4) THEN octet_length(encode(text)) END::BIGINT AS size FROM ix"
    ocr_key = "CASE WHEN doc_id % 2 = 0 THEN 'doc=' || doc_id ELSE '' END || '#page=' || page || '#ocrWidth=960#namespace=default'"
    q["ocr_keys"] = f"WITH {CONV_PAGES} SELECT doc_id, page, {ocr_key} AS key, sha256({ocr_key}) || '.ocr' AS file_name FROM cp"
    q["kept_copies"] = f"WITH {CONV_PAGES}, kc AS (SELECT doc_id AS folder, length(text) AS size FROM cp QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) <= 4) SELECT folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM kc GROUP BY folder"
    q["cut_strings"] = """WITH cs AS (SELECT doc_id, text, encode(text) AS b FROM documents), ce AS (SELECT *, list_max(list_filter(range(1, 102), lambda k: octet_length(encode(substr(text, 1, k::INT))) <= 100)) AS k FROM cs)
SELECT doc_id, CASE WHEN octet_length(b) <= 100 THEN text ELSE substr(text, 1, k::INT) END AS text FROM ce"""
    q["render_sizes"] = f"WITH {CONV_INDEX} SELECT doc_id, page, floor(page_h * (1280 / page_w) + 0.5)::INT AS height, least(ceil(32 * (page_w / page_h)), 336)::INT AS line_w FROM ix WHERE source = '{LAYER}'"
    layer_text = "CASE WHEN ss.doc_id % 3 = 0 THEN '.' ELSE body END"
    q["fallback_states"] = f"""WITH {STATES}, sb AS (SELECT ss.*, body FROM ss JOIN st USING (doc_id, page))
SELECT doc_id, page, route, CASE WHEN state <> 'COMPLETED' AND route = 'OCR' AND {layer_text.replace('ss.', '')} <> '' THEN 'COMPLETED' ELSE state END AS state,
 CASE WHEN route = 'TEXT' OR (state <> 'COMPLETED' AND {layer_text.replace('ss.', '')} <> '') THEN '{LAYER}' WHEN state = 'COMPLETED' THEN '{READ}' END AS source FROM sb"""
    q["page_error_feed"] = f"WITH {STATES} SELECT doc_id, page, 3 AS stage, 'recognition returned no text' AS message, true AS retryable FROM ss JOIN (SELECT doc_id, page, body FROM st) USING (doc_id, page) WHERE route = 'OCR' AND (state = 'FAILED' OR (state = 'COMPLETED' AND length(body) < 150))"
    q["extracted_pages"] = f"""WITH {CONV_INDEX} SELECT doc_id, page, CASE WHEN length(text) > 200 THEN 0 ELSE 1 END AS status, CASE WHEN length(text) > 200 THEN length(text) ELSE 0 END::BIGINT AS raw_chars, CASE WHEN length(text) > 200 THEN 1.0 ELSE 0.0 END::DOUBLE AS conf FROM ix WHERE source = '{LAYER}'"""
    q["backend_failure"] = f"""WITH {CONV_PAGES} SELECT doc_id, page, 'FAIL' AS route, 1 AS stage, 'the text backend is not available' AS message, true AS retryable, 'TEXT_ONLY' AS mode FROM cp
 UNION ALL SELECT doc_id, page, 'OCR', NULL::INT, NULL::VARCHAR, NULL::BOOLEAN, 'TEXT_THEN_OCR' FROM cp"""
    q["prepared_pages"] = f"""WITH {CONV_PAGES}, pp AS (SELECT *, CASE WHEN length(text) < 300 THEN 'MEMORY' WHEN contains(text, ',') THEN 'DISK' ELSE 'NONE' END AS cache_source FROM cp)
SELECT doc_id, page, cache_source, CASE WHEN cache_source = 'NONE' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_blocks FROM pp"""
    channel = ", ".join(f"sum((length(line) * 7 + y * 5 + {3 * k}) % 256)::BIGINT AS c{k}" for k in range(3))
    q["detector_tensors"] = f"WITH {CONV_PAGES}, tl AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line FROM cp), ty AS (SELECT *, unnest([0, 1, 2]) AS y FROM tl) SELECT doc_id, page, {channel} FROM ty GROUP BY doc_id, page"
    q["page_crops"] = f"""WITH {CONV_PAGES}, cl AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM cp),
cx AS (SELECT doc_id, page, i, 6 * length(line) AS w, unnest(range(8)) AS y FROM cl WHERE line <> ''), cy AS (SELECT *, unnest(range(w)) AS x FROM cx)
SELECT doc_id, page, i AS n, w::INT AS width, 8 AS height, sum((x + 2 * (12 * i + y)) % 251)::BIGINT AS total FROM cy GROUP BY ALL"""
    q["orientation_labels"] = f"""WITH {CONV_PAGES}, oa AS (SELECT doc_id, page, (length(text) % 11) / 10.0::DOUBLE - 0.3::DOUBLE AS a, (length(text) % 21) / 20.0::DOUBLE AS b FROM cp)
SELECT doc_id, page, CASE WHEN b > a AND b > 0 THEN 1 ELSE 0 END AS label, round(greatest(a, b, 0), 6)::DOUBLE AS score, b > a AND b > 0.9 AS turned FROM oa"""
    q["block_search"] = f"""WITH {blocks}, bt AS (SELECT doc_id, page, i, n, k, row_number() OVER w - 1 AS p, string_agg(c, '') OVER (PARTITION BY doc_id, page, i) AS line, c, lag(k) OVER w AS pk, lead(k, 3) OVER w AS nk, lead(k, 2) OVER w AS k2 FROM rv WINDOW w AS (PARTITION BY doc_id, page, i ORDER BY k)),
bl AS (SELECT doc_id, page, i, string_agg(c, '' ORDER BY k) AS line FROM rv GROUP BY ALL),
bm AS (SELECT doc_id, page, i, unnest(string_split(lower(line), 'the')) AS part, generate_subscripts(string_split(lower(line), 'the'), 1) AS g, len(string_split(lower(line), 'the')) AS parts FROM bl),
bs AS (SELECT doc_id, page, i, sum(length(part)) OVER (PARTITION BY doc_id, page, i ORDER BY g) + 3 * (g - 1) AS p, g < parts AS hit FROM bm),
bh AS (SELECT bs.doc_id, bs.page, bs.i, bs.p, n, k / n::DOUBLE AS l, (k2 + 0.87) / n AS r, coalesce(((pk + pk + 0.87) / n / 2 + (k + k + 0.87) / n / 2) / 2, 0) AS low, coalesce(((k2 + k2 + 0.87) / n / 2 + (nk + nk + 0.87) / n / 2) / 2, 1) AS high FROM bs JOIN bt ON bs.doc_id = bt.doc_id AND bs.page = bt.page AND bs.i = bt.i AND bs.p = bt.p WHERE hit),
bw AS (SELECT *, least(0.6 / (6 * n), 0.04 * (least(r, high) - greatest(l, low))) AS pad FROM bh)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY i, p) - 1 AS ordinal, p::BIGINT AS start, round(6 * n * greatest(low, greatest(l, low) - pad) / 2, 6)::DOUBLE AS l, round(2500 - (14.0 * i + 9) / 2, 6)::DOUBLE AS b, round(6 * n * least(high, least(r, high) + pad) / 2, 6)::DOUBLE AS r, round(2500 - (14.0 * i + 1) / 2, 6)::DOUBLE AS t FROM bw"""
    q["visible_counts"] = f"""SELECT doc_id, length(regexp_replace(translate(text, 'a,' , ''), '[ \\t\\n]', '', 'g'))::BIGINT AS seen, length(regexp_replace(replace(text, ',', ''), '[ \\t\\n]', '', 'g'))::BIGINT AS in_layer FROM documents"""
    q["search_as_written"] = q["search_case"]
    norm = _norm().replace("source", f"'{LAYER}'")
    q["progress_feed"] = f"""WITH {CONV_PAGES}, ic AS (SELECT doc_id, page, ((length(n) - length(replace(n, 'the', ''))) // 3)::BIGINT AS n_hits FROM (SELECT *, {norm} AS n FROM cp))
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS done, count(*) OVER (PARTITION BY doc_id) AS pages, n_hits, (sum(n_hits) OVER (PARTITION BY doc_id ORDER BY page))::BIGINT AS total FROM ic"""
    q["scanned_range"] = f"WITH {DOC_INDEX} SELECT doc_id, page, length(text)::BIGINT AS raw_chars, 0 AS status FROM ix WHERE source = '{LAYER}' AND page BETWEEN 2 AND 5"
    return q
