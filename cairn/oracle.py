"""DuckDB SQL for the queries of the accessibility engine, written apart from the DataFrame code."""

from __future__ import annotations

#: White space that stripping removes.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _stripping(sql: str) -> str:
    """SQL whose trim(x) take away all of SPACE."""
    at = sql.find("trim(")
    if at < 0:
        return sql
    depth, end = 1, at + 5
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    return f"{sql[: at + 5]}{_stripping(sql[at + 5 : end - 1])}, '{SPACE}'){_stripping(sql[end:])}"


LINES = r"""
lines AS (SELECT doc_id, line - 1 AS pos, trim(raw) AS text FROM
  (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents) WHERE trim(raw) <> ''),
ln AS (SELECT *, CASE WHEN length(text) <= 120 AND text = upper(text) AND text <> lower(text) AND len(regexp_split_to_array(text, '\s+')) <= 10 THEN 'heading' ELSE 'paragraph' END AS type FROM lines)
"""

EL = """
el0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS pos, l_suppkey AS k FROM lineitem),
el AS (SELECT l_orderkey AS doc_id, pos, k,
  (['heading', 'image', 'link', 'table', 'list_item', 'paragraph'])[CAST(l_quantity AS BIGINT) % 6 + 1] AS type,
  (['click here', ' Read More ', 'https://example.com/a', 'www.example.org', '', 'HERE', 'Annual report', 'Contact the team', 'Budget, by year', 'Find a form'])[k % 10 + 1] AS text,
  l_partkey % 6 + 1 AS heading_level, round(1 - 5 * l_discount, 6) AS confidence,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'A picture' END AS alt_text, l_tax > 0.06 AS decorative,
  CASE WHEN k % 4 = 0 THEN 0 ELSE 2 END AS n_headers, pos // 4 + 1 AS page_number, CAST(11 + l_partkey % 10 AS DOUBLE) AS font_size,
  CASE WHEN k % 2 = 0 THEN 'e' || (k % 7) END AS element_id,
  CASE k % 4 WHEN 1 THEN 'https://example.com:8080/a' || k WHEN 2 THEN 'http://data.example.org/x' WHEN 3 THEN 'mailto:a@b.c' END AS href,
  CASE WHEN k % 5 = 0 THEN 'Nearby ' || k ELSE '' END AS nearby_text,
  CAST(72 + 64 * (k % 5) AS DOUBLE) AS x0, CAST(72 + 24 * pos AS DOUBLE) AS y0, CAST(202 + 64 * (k % 5) AS DOUBLE) AS x1, CAST(132 + 24 * pos AS DOUBLE) AS y1 FROM el0)
"""

ISS = (
    EL
    + r""",
hd AS (SELECT *, lag(heading_level) OVER (PARTITION BY doc_id ORDER BY pos) AS level_before FROM el WHERE type = 'heading'),
iss0 AS (
  SELECT doc_id, pos, 0 AS stage, 'wcag.headings.order' AS rule_id, 'skipped_heading_level' AS issue_type, 'medium' AS severity, 0.9::DOUBLE AS confidence, 'Review whether this should be H' || (level_before + 1) || '.' AS suggested_fix FROM hd WHERE heading_level > level_before + 1
  UNION ALL SELECT doc_id, pos, 1, 'wcag.images.alt_text', 'missing_image_alt_text', 'high', confidence, NULL FROM el WHERE type = 'image' AND NOT decorative AND coalesce(trim(alt_text), '') = ''
  UNION ALL SELECT doc_id, pos, 1, 'wcag.links.meaningful_text', 'weak_link_text', 'medium', 0.9, NULL FROM el WHERE type = 'link' AND (lower(trim(text)) IN ('', 'click here', 'here', 'link', 'learn more', 'more', 'read more', 'view', 'download') OR regexp_matches(lower(trim(text)), '^(https?://|www\.)'))
  UNION ALL SELECT doc_id, pos, 1, 'wcag.tables.headers', 'missing_table_headers', 'high', confidence, NULL FROM el WHERE type = 'table' AND n_headers = 0
  UNION ALL SELECT doc_id, pos, 2, 'wcag.reading_order.confidence', 'low_reading_order_confidence', 'medium', confidence, NULL FROM el WHERE confidence < 0.6),
iss AS (SELECT i.*, 'needs_user_confirmation' AS automation_status, e.element_id, e.page_number, e.x0, e.y0, e.x1, e.y1,
  row_number() OVER (PARTITION BY i.doc_id ORDER BY CASE WHEN stage = 0 THEN 0 ELSE 1 END, pos, stage) - 1 AS issue_ord FROM iss0 i JOIN el e USING (doc_id, pos))
"""
)

MATCH = (
    ISS
    + """,
fm AS (SELECT i.doc_id, i.issue_ord, min(e.pos) AS match_pos FROM iss i JOIN el e ON e.doc_id = i.doc_id AND (e.element_id = i.element_id
   OR (e.page_number = i.page_number AND e.x0 = i.x0 AND e.y0 = i.y0 AND e.x1 = i.x1 AND e.y1 = i.y1)) GROUP BY ALL),
sg0 AS (SELECT i.*, m.match_pos, e.text AS e_text, e.href, trim(e.nearby_text) AS near FROM iss i LEFT JOIN fm m USING (doc_id, issue_ord) LEFT JOIN el e ON e.doc_id = i.doc_id AND e.pos = m.match_pos),
sg AS (SELECT *, CASE issue_type
   WHEN 'missing_image_alt_text' THEN coalesce('Image related to: ' || coalesce(nullif(left(near, 160), ''), nullif(left(trim(e_text), 160), '')), 'Describe the meaningful content or purpose of this image.')
   WHEN 'weak_link_text' THEN CASE WHEN coalesce(href, '') = '' THEN 'Replace with descriptive link text.' ELSE coalesce(nullif(left(near, 80), ''), 'Open ' || coalesce(nullif(regexp_extract(href, '^[a-z]+://([^/]*)', 1), ''), href)) END
   WHEN 'missing_table_headers' THEN 'Confirm the first row or column that should be treated as table headers.'
   WHEN 'low_reading_order_confidence' THEN 'Confirm the correct reading order and section structure before PDF rebuild.'
   ELSE suggested_fix END AS proposed_value FROM sg0)
"""
)

PDF = """
pdf AS (SELECT o_orderkey AS doc_id, o_orderkey % 11 = 0 AS enc, CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS a, CASE o_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS b,
  o_orderkey % 4 AS page_count, o_orderkey % 5 AS blocks, CASE WHEN o_orderkey % 18 = 0 THEN '1, 3' WHEN o_orderkey % 6 = 0 THEN '1' WHEN o_orderkey % 9 = 0 THEN '3' ELSE '' END AS pages,
  CASE WHEN o_orderkey % 8 = 0 THEN ' ' WHEN o_orderkey % 8 <> 1 THEN 'en' END AS language FROM orders),
tg AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, FALSE) AND coalesce(b, FALSE) END AS tagged FROM pdf)
"""

DEC = """
dec AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(floor(value) AS BIGINT) % 5 AS slot0, ((CAST(floor(value) AS BIGINT) % 5) + 5) % 5 AS slot,
  CASE event_type WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'edit' ELSE 'reject' END AS decision, CASE WHEN event_type = 'purchase' THEN props END AS final_value
  FROM events WHERE event_type IN ('click', 'purchase', 'error')),
jobs AS (SELECT DISTINCT user_id AS job_id FROM events),
slots AS (SELECT job_id, slot, 'value ' || slot AS proposed_value FROM jobs, (SELECT unnest(range(5)) AS slot) WHERE (job_id + slot) % 7 <> 0),
lat AS (SELECT job_id, slot, arg_max(decision, seq) AS decision, CASE WHEN arg_max(decision, seq) = 'reject' THEN 'rejected' ELSE 'accepted' END AS final_status FROM dec GROUP BY ALL)
"""

TABLE = """,
tb AS (SELECT *, CASE WHEN trim(text) = '' THEN CAST([] AS VARCHAR[][]) WHEN contains(text, ',') THEN [list_transform(string_split(trim(text), ','), lambda x: trim(x))] ELSE [[trim(text)]] END AS base FROM el WHERE type = 'table'),
tbl AS (SELECT doc_id, pos, CASE WHEN n_headers = 0 OR (len(base) > 0 AND list_transform(base[1], lambda x: lower(x)) = ['budget', 'by year']) THEN base ELSE list_concat([['Budget', 'BY YEAR']], base) END AS rws FROM tb)
"""

PLAN = (
    EL
    + TABLE.rstrip()
    + """,
dup AS (SELECT DISTINCT e.doc_id, e.pos FROM el e JOIN el l ON l.doc_id = e.doc_id AND l.type = 'link' AND e.type <> 'link' AND lower(trim(e.text)) <> '' AND lower(trim(l.text)) = lower(trim(e.text))
   AND e.x0 < l.x1 AND e.x1 > l.x0 AND e.y0 < l.y1 AND e.y1 > l.y0),
con AS (SELECT el.*, coalesce(list_transform(rws, lambda r: len(r)), []) AS row_sizes FROM el LEFT JOIN tbl USING (doc_id, pos) WHERE CASE type WHEN 'image' THEN TRUE WHEN 'table' THEN len(rws) > 0 ELSE trim(text) <> '' END AND NOT EXISTS (SELECT 1 FROM dup WHERE dup.doc_id = el.doc_id AND dup.pos = el.pos)),
kept AS (SELECT *, len(row_sizes) AS n_rows,
   CASE type WHEN 'heading' THEN 'H' || heading_level WHEN 'link' THEN 'Link' WHEN 'list_item' THEN 'LI' WHEN 'table' THEN 'Table' WHEN 'image' THEN 'Figure' ELSE 'P' END AS role,
   row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM con),
high AS (SELECT *, CASE type WHEN 'image' THEN 76 WHEN 'table' THEN 24 * n_rows + 12 WHEN 'heading' THEN CASE WHEN heading_level = 1 THEN 32 ELSE 28 END ELSE 24 END AS h FROM kept),
pg(doc_id, rn, y, page) AS (SELECT doc_id, rn, CAST(72 + h AS BIGINT), CAST(0 AS BIGINT) FROM high WHERE rn = 1
   UNION ALL SELECT k.doc_id, k.rn, CASE WHEN p.y > 760 THEN 72 ELSE p.y END + k.h, CASE WHEN p.y > 760 THEN p.page + 1 ELSE p.page END FROM pg p JOIN high k ON k.doc_id = p.doc_id AND k.rn = p.rn + 1),
plan AS (SELECT doc_id, pos, role, page AS page_index, n_rows, row_sizes, n_headers, alt_text, decorative, k, CAST(y - h AS DOUBLE) AS y FROM high JOIN pg USING (doc_id, rn))
"""
)

NODES = (
    PLAN
    + """,
isl AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, coalesce(role = 'LI' AND lag(role) OVER w = 'LI' AND lag(page_index) OVER w = page_index, FALSE) AS joins FROM plan WINDOW w AS (PARTITION BY doc_id ORDER BY pos))),
tr AS (SELECT *, unnest(range(n_rows)) AS r FROM plan WHERE role = 'Table'),
raw AS (
  SELECT doc_id, pos, -2 AS row, -1 AS cell, 'L' AS role, page_index, TRUE AS is_top, FALSE AS is_leaf, k, CAST(NULL AS VARCHAR) AS alt FROM isl WHERE role = 'LI' AND NOT joins
  UNION ALL SELECT doc_id, pos, -1, -1, 'LI', page_index, FALSE, FALSE, k, NULL FROM isl WHERE role = 'LI'
  UNION ALL SELECT doc_id, pos, 0, 0, 'Lbl', page_index, FALSE, FALSE, k, NULL FROM isl WHERE role = 'LI'
  UNION ALL SELECT doc_id, pos, 0, 1, 'LBody', page_index, FALSE, TRUE, k, NULL FROM isl WHERE role = 'LI'
  UNION ALL SELECT doc_id, pos, -1, -1, 'Table', page_index, TRUE, FALSE, k, NULL FROM plan WHERE role = 'Table'
  UNION ALL SELECT doc_id, pos, r, -1, 'TR', page_index, FALSE, FALSE, k, NULL FROM tr
  UNION ALL SELECT doc_id, pos, r, c, CASE WHEN r = 0 AND n_headers > 0 THEN 'TH' ELSE 'TD' END, page_index, FALSE, TRUE, k, NULL FROM (SELECT *, unnest(range(row_sizes[r + 1])) AS c FROM tr)
  UNION ALL SELECT doc_id, pos, -1, -1, role, page_index, TRUE, TRUE, k, CASE WHEN role = 'Figure' THEN CASE WHEN decorative THEN '' ELSE alt_text END END FROM plan WHERE role NOT IN ('LI', 'Table')),
nodes AS (SELECT *, CASE WHEN is_leaf THEN row_number() OVER (PARTITION BY doc_id, page_index, is_leaf ORDER BY pos, row, cell) - 1 END AS mcid FROM raw),
hurt AS (SELECT doc_id, pos, row, cell, role, page_index, is_top, is_leaf, k, CASE WHEN k % 7 <> 0 THEN alt END AS alt, CASE WHEN k % 17 = 0 AND is_leaf THEN 0 ELSE mcid END AS mcid FROM nodes WHERE NOT (role = 'LBody' AND k % 11 = 0) AND NOT (role = 'TH' AND k % 13 = 0) AND NOT (role IN ('LI', 'Lbl', 'LBody') AND k % 23 = 0) AND NOT (role NOT IN ('L', 'LI', 'Lbl', 'LBody') AND k % 19 = 0)),
ann AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY pos) AS ord, (SELECT 0) + pages + row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS struct_parent
   FROM plan JOIN (SELECT doc_id, max(page_index) + 1 AS pages FROM plan GROUP BY 1) USING (doc_id) WHERE role = 'Link' AND k % 5 <> 0),
zip AS (SELECT l.doc_id, l.pos, l.page_index, l.ord, ann.struct_parent FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY pos) AS ord FROM plan WHERE role = 'Link') l LEFT JOIN ann USING (doc_id, page_index, ord)),
parw AS (SELECT doc_id, page_index AS key, count(*) AS entries FROM nodes WHERE is_leaf GROUP BY 1, 2 UNION ALL SELECT doc_id, struct_parent, 1 FROM ann)
"""
)

#: Documents that fail a check, by check; all others pass, whether they have anything to check or not.
FAILS = (
    PDF.rstrip() + ","
    + NODES
    + """,
zl AS (SELECT h.doc_id, z.struct_parent FROM hurt h JOIN zip z USING (doc_id, pos) WHERE h.role = 'Link'),
pk AS (SELECT doc_id, key, CAST(sum(entries) AS BIGINT) AS entries FROM (SELECT doc_id, page_index AS key, count(*) AS entries FROM hurt WHERE is_leaf GROUP BY 1, 2 UNION ALL SELECT doc_id, struct_parent, 1 FROM zip WHERE struct_parent IS NOT NULL) WHERE key % 3 <> 1 GROUP BY 1, 2),
mk AS (SELECT doc_id, page_index AS key, count(*) AS marks FROM nodes WHERE is_leaf GROUP BY 1, 2),
f3 AS (SELECT doc_id FROM mk LEFT JOIN pk USING (doc_id, key) WHERE coalesce(entries, 0) < marks),
f4 AS (SELECT doc_id FROM hurt WHERE role = 'Figure' AND alt IS NULL),
f5 AS (SELECT doc_id FROM zl WHERE struct_parent IS NULL),
f6 AS (SELECT doc_id FROM zl WHERE struct_parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.doc_id = zl.doc_id AND pk.key = zl.struct_parent)),
f7 AS (SELECT doc_id FROM (SELECT doc_id, pos, row, bool_or(role = 'TR') AS tr, count(*) FILTER (role = 'TH') AS th, count(*) FILTER (role = 'TD') AS td, bool_or(role = 'Table') AS tab FROM hurt WHERE role IN ('Table', 'TR', 'TH', 'TD') GROUP BY 1, 2, 3)
   GROUP BY doc_id, pos HAVING bool_or(tab) AND (NOT bool_or(tr) OR bool_or(tr AND th + td = 0) OR sum(th) = 0 OR sum(td) = 0)),
f8 AS (SELECT doc_id FROM isl WHERE role = 'LI' GROUP BY doc_id, island HAVING bool_and(k % 23 = 0) OR bool_or(k % 23 <> 0 AND k % 11 = 0)),
fa AS (SELECT doc_id FROM (SELECT doc_id, list(role ORDER BY pos, row, cell) AS want FROM nodes WHERE is_top GROUP BY 1) LEFT JOIN (SELECT doc_id, list(role ORDER BY pos, row, cell) AS got FROM hurt WHERE is_top GROUP BY 1) USING (doc_id) WHERE want <> coalesce(got, [])),
fb AS (SELECT doc_id FROM (SELECT doc_id, list(role || '@' || page_index ORDER BY pos, row, cell) AS want FROM nodes WHERE is_leaf GROUP BY 1) LEFT JOIN (SELECT doc_id, list(role || '@' || page_index ORDER BY pos, row, cell) AS got FROM hurt WHERE is_leaf GROUP BY 1) USING (doc_id) WHERE want <> coalesce(got, [])),
fc AS (SELECT doc_id FROM (SELECT doc_id, mcid, lag(mcid) OVER (PARTITION BY doc_id, page_index ORDER BY pos, row, cell) AS b FROM hurt WHERE is_leaf) WHERE mcid <= b),
fd AS (SELECT doc_id FROM mk WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.doc_id = mk.doc_id AND pk.key = mk.key)),
f10 AS (SELECT doc_id FROM (SELECT doc_id, role, count(*) AS want FROM plan GROUP BY 1, 2) LEFT JOIN (SELECT doc_id, role, count(*) AS got FROM hurt WHERE is_top OR role IN ('LI', 'Lbl', 'LBody') GROUP BY 1, 2) USING (doc_id, role) WHERE coalesce(got, 0) < want
   UNION ALL SELECT doc_id FROM (SELECT doc_id, count(DISTINCT island) AS want FROM isl GROUP BY 1) LEFT JOIN (SELECT doc_id, count(*) AS got FROM hurt WHERE is_top GROUP BY 1) USING (doc_id) WHERE coalesce(got, 0) < want),
f9 AS (SELECT doc_id FROM fa UNION ALL SELECT doc_id FROM fb UNION ALL SELECT doc_id FROM fc UNION ALL SELECT doc_id FROM fd)
"""
)
CHECK_IDS = ["root_present", "mark_info_marked", "mcid_parent_tree", "figures_have_alt", "links_reference_annotations", "link_annotations_mapped", "tables_have_roles", "lists_have_roles", "reading_order_matches_plan", "matches_plan"]
PASSES = ["coalesce(a, FALSE)", "coalesce(b, FALSE)", *(f"doc_id NOT IN (SELECT doc_id FROM f{k})" for k in range(3, 11))]


#: A page's left edges in clusters, from ed (doc_id, page_number, x0, rn): pages with columns in fin.
COLUMNS = """,
cl(doc_id, page_number, rn, cur, mids) AS (SELECT doc_id, page_number, rn, [x0], CAST([] AS DOUBLE[]) FROM ed WHERE rn = 1
  UNION ALL SELECT e.doc_id, e.page_number, e.rn, CASE WHEN abs(e.x0 - list_median(c.cur)) > 48 THEN [e.x0] ELSE list_append(c.cur, e.x0) END, CASE WHEN abs(e.x0 - list_median(c.cur)) > 48 AND len(c.cur) >= 2 THEN list_append(c.mids, list_median(c.cur)) ELSE c.mids END
  FROM cl c JOIN ed e ON e.doc_id = c.doc_id AND e.page_number = c.page_number AND e.rn = c.rn + 1),
fin AS (SELECT doc_id, page_number, rn AS lines, coalesce(rn >= 6 AND len(m) >= 2 AND list_max(m) - list_min(m) > 120, FALSE) AS multi_column FROM (SELECT *, CASE WHEN len(cur) >= 2 THEN list_append(mids, list_median(cur)) ELSE mids END AS m FROM cl QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY rn DESC) = 1))
"""
#: Lines of rebuilt documents, of a plan and alternative texts al (doc_id, pos, alt).
REBUILT = r""",
pl AS (SELECT p.*, e.type, e.text, e.href, e.heading_level, al.alt, t.rws FROM plan p JOIN el e USING (doc_id, pos) LEFT JOIN al USING (doc_id, pos) LEFT JOIN tbl t USING (doc_id, pos)),
cel AS (SELECT *, unnest(r) AS c, generate_subscripts(r, 1) - 1 AS ci FROM (SELECT doc_id, page_index, y, list_max(row_sizes) AS wide, unnest(rws) AS r, generate_subscripts(rws, 1) - 1 AS ri FROM pl WHERE role = 'Table')),
gl0 AS (
  SELECT doc_id, page_index, CASE WHEN role = 'LI' THEN CASE WHEN k % 3 = 0 THEN '* ' ELSE '- ' END || trim(text) ELSE trim(text) END AS text, 72::DOUBLE AS x, y, CASE WHEN role = 'H1' THEN 18 WHEN role LIKE 'H_' THEN 14 ELSE 11 END::DOUBLE AS size FROM pl WHERE role NOT IN ('Table', 'Figure')
  UNION ALL SELECT doc_id, page_index, CASE WHEN decorative THEN 'Decorative image' WHEN coalesce(alt, '') = '' THEN 'Figure: alt text requires review' ELSE 'Figure: ' || alt END, 82, y + 20, 10 FROM pl WHERE role = 'Figure'
  UNION ALL SELECT doc_id, page_index, CASE WHEN length(c) <= 28 THEN c ELSE left(c, 25) || '...' END, 72::DOUBLE + ci * (451::DOUBLE / wide) + 4, y + 24 * ri + 15, 9 FROM cel WHERE c <> ''),
gl AS (SELECT doc_id, page_index + 1 AS page_number, text, size AS font_size, x AS x0, y - size AS y0, x + size * 0.5::DOUBLE * length(text) AS x1, y + size * 0.25::DOUBLE AS y1 FROM gl0 WHERE text <> ''),
lk2 AS (SELECT doc_id, page_index + 1 AS page_number, pos, href, 72::DOUBLE AS x0, y AS y0, 523::DOUBLE AS x1, y + 16 AS y1 FROM pl WHERE role = 'Link' AND coalesce(href, '') <> ''),
ra0 AS (SELECT doc_id, page_number, 0 AS part, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, text) AS nth, text, CAST(NULL AS VARCHAR) AS href, x0, y0, x1, y1, font_size, median(font_size) OVER (PARTITION BY doc_id, page_number) AS m FROM gl
  UNION ALL SELECT doc_id, page_number, 1, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos), '', href, x0, y0, x1, y1, NULL, NULL FROM lk2),
ra1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, part, nth) - 1 AS pos, part = 0 AND length(text) <= 120 AND (font_size >= m + 2 OR (text = upper(text) AND text <> lower(text) AND len(regexp_split_to_array(trim(text), '\s+')) <= 10)) AS head FROM ra0),
met AS (SELECT l.doc_id, l.pos, string_agg(t.text, ' ' ORDER BY t.pos) AS texts FROM ra1 l JOIN ra1 t ON t.doc_id = l.doc_id AND t.page_number = l.page_number AND l.part = 1 AND t.part = 0 AND t.x0 <= l.x1 AND t.x1 >= l.x0 AND t.y0 <= l.y1 AND t.y1 >= l.y0 GROUP BY 1, 2),
ra AS (SELECT r.doc_id, r.pos, CASE WHEN part = 1 THEN 'link' WHEN head THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN part = 1 THEN coalesce(nullif(trim(texts), ''), href) ELSE text END AS text,
   CASE WHEN head THEN CASE WHEN font_size >= m + 8 THEN 1 WHEN font_size >= m + 4 THEN 2 ELSE 3 END ELSE 0 END::BIGINT AS heading_level, 0.85::DOUBLE AS confidence, page_number || CASE WHEN part = 1 THEN ':link:' ELSE ':' END || nth AS element_id FROM ra1 r LEFT JOIN met USING (doc_id, pos)),
ed AS (SELECT doc_id, page_number, x0, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY x0) AS rn FROM gl)
"""
#: What became of the accepted alternative texts.
ALTS = """,
acc AS (SELECT doc_id, issue_ord AS seq, element_id, page_number, CASE WHEN pos % 6 <> 0 THEN x0 END AS x0, y0, x1, y1, 'Alt ' || issue_ord AS value FROM iss WHERE issue_type = 'missing_image_alt_text' AND issue_ord % 4 < 2),
hit AS (SELECT e.doc_id, e.pos, arg_max(a.value, a.seq) AS v FROM el e JOIN acc a ON a.doc_id = e.doc_id AND e.type = 'image' AND (a.element_id = e.element_id OR (a.page_number = e.page_number AND (a.x0 IS NULL OR (a.x0 = e.x0 AND a.y0 = e.y0 AND a.x1 = e.x1 AND a.y1 = e.y1)))) GROUP BY 1, 2),
al AS (SELECT doc_id, pos, CASE WHEN decorative THEN '' ELSE coalesce(v, nullif(trim(alt_text), '')) END AS alt FROM el LEFT JOIN hit USING (doc_id, pos) WHERE type = 'image')
"""
OWN_ALTS = """,
al AS (SELECT doc_id, pos, CASE WHEN decorative THEN '' ELSE nullif(trim(alt_text), '') END AS alt FROM el WHERE type = 'image')
"""


LINKS = r"""
tags AS (SELECT page_id AS doc_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1) AS t FROM pages),
lk AS (SELECT doc_id, i - 1 AS pos, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS href, trim(regexp_replace(tag, '(?s)<[^>]*>', '', 'g')) AS text FROM (SELECT doc_id, unnest(t) AS tag, generate_subscripts(t, 1) AS i FROM tags))
"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


def _rule(kind: str) -> str:
    return _with(ISS, f"SELECT doc_id, pos, severity, confidence FROM iss WHERE issue_type = '{kind}'")


def _pdf(rule: str, severity: str, confidence: float, automation: str, when: str, pages: str = "''") -> str:
    return _with(PDF, f"SELECT doc_id, '{rule}' AS rule_id, '{severity}' AS severity, {confidence}::DOUBLE AS confidence, '{automation}' AS automation_status, {pages} AS pages FROM tg WHERE {when}")


def _passed(fails: str) -> str:
    return _with(FAILS, f"SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM {fails}) AS passed FROM pdf")


CONFIRM = "needs_user_confirmation"
BLANK = "coalesce(trim(language), '') = ''"

SQL: dict[str, str] = {
    "r6_missing_title": _with(LINES, f"SELECT doc_id, coalesce(t, '') AS suggested_fix, CASE WHEN t IS NULL THEN 0.6 ELSE 0.85 END::DOUBLE AS confidence, CASE WHEN t IS NULL THEN '{CONFIRM}' ELSE 'auto_fixable' END AS automation_status FROM documents LEFT JOIN (SELECT doc_id, left(arg_min(text, pos), 80) AS t FROM ln GROUP BY 1) USING (doc_id)"),
    "r6a_first_text": _with(LINES, "SELECT doc_id, left(arg_min(text, pos), 80) AS first_text FROM ln GROUP BY 1"),
    "r8_missing_heading_structure": _with(LINES, "SELECT doc_id, count(*) AS paragraphs FROM ln GROUP BY 1 HAVING count(*) FILTER (type = 'heading') = 0 AND count(*) >= 4"),
    "s5_line_split": _with(LINES, "SELECT doc_id, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM ln GROUP BY 1"),
    "x2_heading_upper": _with(LINES, "SELECT doc_id, pos, text FROM ln WHERE type = 'heading'"),
    "o14_table_parse": _with(LINES, r"SELECT doc_id, pos AS line, len(c) AS n_cells, c[1] AS first_cell, c[-1] AS last_cell FROM (SELECT doc_id, pos, list_filter(list_transform(CASE WHEN contains(text, chr(9)) THEN string_split(text, chr(9)) WHEN contains(text, '|') THEN string_split(regexp_replace(text, '^\|+|\|+$', '', 'g'), '|') WHEN contains(text, ',') THEN string_split(text, ',') ELSE regexp_split_to_array(text, '\s{2,}') END, lambda x: trim(x)), lambda x: x <> '') AS c FROM ln) WHERE len(c) > 0"),
    "o16_cell_fit": _with(LINES, "SELECT doc_id, pos, CASE WHEN length(text) <= 28 THEN text ELSE left(text, 25) || '...' END AS cell FROM ln"),
    "ad2_links": _with(LINKS, "SELECT doc_id, pos, href, text FROM lk"),
    "g6_link_authority": _with(LINKS, "SELECT doc_id, pos, 'Open ' || coalesce(nullif(regexp_extract(href, '^[a-z]+://([^/]*)', 1), ''), href) AS proposed_value FROM lk"),
    "r9_skipped_level": _with(ISS, "SELECT doc_id, pos, suggested_fix FROM iss WHERE stage = 0"),
    "r10_missing_alt": _rule("missing_image_alt_text"),
    "r11_weak_link": _rule("weak_link_text"),
    "r12_missing_headers": _rule("missing_table_headers"),
    "r13_low_confidence": _rule("low_reading_order_confidence"),
    "p1_by_status": _with(ISS, "SELECT doc_id, automation_status, count(*) AS n FROM iss GROUP BY ALL"),
    "p2_by_severity": _with(ISS, "SELECT doc_id, severity, count(*) AS n FROM iss GROUP BY ALL"),
    "p3_by_type": _with(ISS, "SELECT issue_type, severity, count(*) AS n FROM iss GROUP BY ALL"),
    "p123_all_counts": _with(ISS, "SELECT doc_id, 'automation_status' AS kind, automation_status AS name, count(*) AS n FROM iss GROUP BY ALL UNION ALL SELECT doc_id, 'severity', severity, count(*) FROM iss GROUP BY ALL UNION ALL SELECT doc_id, 'issue_type', issue_type, count(*) FROM iss GROUP BY ALL"),
    "p4_counts": _with(ISS, "SELECT doc_id, count(issue_ord) AS issues FROM (SELECT DISTINCT doc_id FROM el) LEFT JOIN iss USING (doc_id) GROUP BY 1"),
    "r1_encrypted": _pdf("pdf.encryption", "critical", 1.0, "cannot_automate", "enc"),
    "r2_untagged": _pdf("pdf.tags.present", "critical", 0.95, "auto_fixable", "NOT enc AND tagged = FALSE"),
    "r3_unknown_tagging": _pdf("pdf.tags.present", "high", 0.5, CONFIRM, "NOT enc AND tagged IS NULL"),
    "r4_no_text": _pdf("pdf.extractable_text", "critical", 0.9, CONFIRM, "NOT enc AND page_count > 0 AND blocks = 0"),
    "r5_multicolumn": _pdf("pdf.reading_order.multicolumn", "high", 0.75, CONFIRM, "NOT enc AND pages <> ''", "pages"),
    "r7_missing_language": _pdf("wcag.document.language", "high", 0.7, CONFIRM, BLANK),
    "r14_is_tagged": _with(PDF, "SELECT doc_id, CASE WHEN tagged IS NULL THEN 'unknown' WHEN tagged THEN 'true' ELSE 'false' END AS is_tagged FROM tg"),
    "r15_rule_catalogue": _with(ISS, "SELECT rule_id, CASE rule_id WHEN 'wcag.images.alt_text' THEN '1.1.1' WHEN 'wcag.links.meaningful_text' THEN '2.4.4' WHEN 'wcag.reading_order.confidence' THEN '1.3.2' ELSE '1.3.1' END AS criterion, 'A' AS level, count(*) AS n FROM iss GROUP BY ALL"),
    "g3_action": _with(ISS, "SELECT issue_type, CASE issue_type WHEN 'missing_image_alt_text' THEN 'generate_alt_text' WHEN 'weak_link_text' THEN 'improve_link_text' WHEN 'skipped_heading_level' THEN 'adjust_heading_level' WHEN 'missing_table_headers' THEN 'confirm_table_headers' ELSE 'confirm_reading_order' END AS action, count(*) AS n FROM iss GROUP BY ALL"),
    "g4_source": _with(ISS, "SELECT CASE WHEN issue_type IN ('missing_image_alt_text', 'weak_link_text') THEN 'ai_assisted' ELSE 'rule' END AS source, count(*) AS n FROM iss GROUP BY ALL"),
    "g5_first_match": _with(MATCH, "SELECT doc_id, issue_ord, match_pos FROM fm"),
    "g6_proposed_value": _with(MATCH, "SELECT doc_id, issue_ord, coalesce(proposed_value, '') AS proposed_value FROM sg"),
    "g10_confidence": _with(MATCH, "SELECT doc_id, issue_ord, TRUE AS requires_user_confirmation, CASE WHEN coalesce(proposed_value, '') = '' THEN least(confidence, 0.4) ELSE confidence END AS confidence FROM sg"),
    "v1_latest_decision": _with(DEC, "SELECT job_id, slot, decision, final_status FROM lat"),
    "v1_audit_log": _with(DEC, "SELECT job_id, seq AS event_seq, 'user_decision_recorded' AS type, slot, decision FROM dec"),
    "v2_bad_decisions": _with(DEC, "SELECT job_id, seq, slot FROM dec WHERE (job_id + slot) % 7 = 0"),
    "o2_latest_value": _with(DEC, "SELECT job_id, slot, arg_max(coalesce(nullif(trim(final_value), ''), proposed_value), seq) AS value FROM dec JOIN slots USING (job_id, slot) WHERE decision IN ('accept', 'edit') GROUP BY ALL"),
    "j7_job_status": _with(DEC, "SELECT job_id, count(slot) AS issues, CASE WHEN count(slot) > 0 AND count(*) FILTER (slot IS NOT NULL AND decision IS NULL) = 0 THEN 'reviewed' ELSE 'awaiting_review' END AS status FROM jobs LEFT JOIN slots USING (job_id) LEFT JOIN lat USING (job_id, slot) GROUP BY 1"),
    "h7_open_suggestions": _with(DEC, "SELECT job_id, slot, proposed_value FROM slots LEFT JOIN lat USING (job_id, slot) WHERE decision IS NULL"),
    "x1_median_size": _with(EL, r"SELECT doc_id, pos, m AS body_size, length(text) <= 120 AND (font_size >= m + 2 OR (text = upper(text) AND text <> lower(text) AND len(regexp_split_to_array(trim(text), '\s+')) <= 10)) AS is_heading, CASE WHEN font_size >= m + 8 THEN 1 WHEN font_size >= m + 4 THEN 2 ELSE 3 END::BIGINT AS level FROM el JOIN (SELECT doc_id, page_number, median(font_size) AS m FROM el GROUP BY ALL) USING (doc_id, page_number)"),
    "x7_columns": _with(PLAN.rstrip() + OWN_ALTS.rstrip() + REBUILT.rstrip() + COLUMNS, "SELECT doc_id, page_number, lines, multi_column FROM fin"),
    "x10_overlap_join": _with(EL, "SELECT l.doc_id, l.pos AS link_pos, coalesce(string_agg(t.text, ' ' ORDER BY t.pos), '') AS texts, count(t.pos) AS lines FROM el l LEFT JOIN el t ON t.doc_id = l.doc_id AND t.page_number = l.page_number AND t.type <> 'link' AND t.x0 <= l.x1 AND t.x1 >= l.x0 AND t.y0 <= l.y1 AND t.y1 >= l.y0 WHERE l.type = 'link' GROUP BY 1, 2"),
    "x11_two_nearest": _with(EL, "SELECT doc_id, image_pos, trim(left(coalesce(string_agg(text, ' ' ORDER BY rn), ''), 160)) AS nearby_text FROM (SELECT i.doc_id, i.pos AS image_pos, t.text, row_number() OVER (PARTITION BY i.doc_id, i.pos ORDER BY abs(t.x0 + t.x1 - i.x0 - i.x1) / 2 + abs(t.y0 + t.y1 - i.y0 - i.y1) / 2, t.pos) AS rn FROM el i LEFT JOIN el t ON t.doc_id = i.doc_id AND t.page_number = i.page_number AND t.type <> 'image' WHERE i.type = 'image') WHERE rn <= 2 GROUP BY 1, 2"),
    "o6_content_filter": _with(PLAN, "SELECT doc_id, pos, type FROM con"),
    "o7_duplicate_text": _with(PLAN, "SELECT doc_id, pos FROM dup"),
    "o8_roles": _with(EL, "SELECT doc_id, pos, CASE type WHEN 'heading' THEN 'H' || heading_level WHEN 'link' THEN 'Link' WHEN 'list_item' THEN 'LI' WHEN 'table' THEN 'Table' WHEN 'image' THEN 'Figure' ELSE 'P' END AS role FROM el"),
    "o9_role_counts": _with(PLAN, "SELECT doc_id, role, count(*) AS n FROM plan GROUP BY ALL"),
    "o10_pagination": _with(PLAN, "SELECT doc_id, pos, page_index FROM plan"),
    "o18_output_name": r"SELECT p_partkey, regexp_replace(p_name || ' (v1)', '[^\p{L}\p{N}_-]', '_', 'g') || '_accessible.pdf' AS name, '\(' || replace(p_name, '\', '\\') || '\)' AS escaped FROM part",
    "t2_list_islands": _with(NODES, "SELECT doc_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(pos) AS pos FROM isl GROUP BY 1, 2"),
    "t4_table_cells": _with(NODES, "SELECT doc_id, pos, row, cell, role, page_index, is_top, is_leaf, coalesce(mcid, -1) AS mcid FROM nodes WHERE role IN ('Table', 'TR', 'TH', 'TD')"),
    "t5_mcid": _with(NODES, "SELECT doc_id, pos, row, cell, role, page_index, is_top, is_leaf, coalesce(mcid, -1) AS mcid FROM nodes"),
    "t7_link_zip": _with(NODES, "SELECT doc_id, pos, page_index, ord, struct_parent FROM zip"),
    "t8_parent_tree": _with(NODES, "SELECT doc_id, key, entries FROM parw"),
    "c3_parent_tree": _passed("f3"),
    "c4_figure_alt": _passed("f4"),
    "c5_link_refs": _passed("f5"),
    "c6_annotation_map": _passed("f6"),
    "c7_table_roles": _passed("f7"),
    "c8_list_roles": _passed("f8"),
    "c9a_top_order": _passed("fa"),
    "c9b_leaf_order": _passed("fb"),
    "c9c_increasing": _passed("fc"),
    "c9d_keys": _passed("fd"),
    "c10_plan_counts": _passed("f10"),
    "c11_histogram": _with(NODES, "SELECT role, count(*) AS n FROM hurt GROUP BY 1"),
    "p6_report": _with(ISS, "SELECT doc_id, count(issue_ord) AS issues, arg_min(issue_type, issue_ord) AS first_issue FROM (SELECT DISTINCT doc_id FROM el) LEFT JOIN iss USING (doc_id) GROUP BY 1"),
}

VALUES = "val AS (SELECT job_id, slot, arg_max(coalesce(nullif(trim(final_value), ''), proposed_value), seq) AS value FROM dec JOIN slots USING (job_id, slot) WHERE decision IN ('accept', 'edit') GROUP BY ALL), ft AS (SELECT doc_id, left(arg_min(text, pos), 80) AS t FROM ln GROUP BY 1)"
OVERLAP = SQL["x10_overlap_join"].removeprefix(_with(EL, "")).replace("t.type <> 'link'", "t.type NOT IN ('image', 'link')")
ACTION = "CASE issue_type WHEN 'missing_image_alt_text' THEN 'generate_alt_text' WHEN 'weak_link_text' THEN 'improve_link_text' WHEN 'skipped_heading_level' THEN 'adjust_heading_level' WHEN 'missing_table_headers' THEN 'confirm_table_headers' ELSE 'confirm_reading_order' END"


def _value(kind: str, action: str, value: str, when: str, confidence: float, asks: str = "TRUE") -> str:
    return f"SELECT doc_id, '{kind}' AS issue_type, '{action}' AS action, {value} AS proposed_value, {asks} AS requires_user_confirmation, {confidence}::DOUBLE AS confidence FROM tg WHERE {when}"


SQL |= {
    "s2_docx_scan": _with(LINES, "SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN 'heading' ELSE 'paragraph' END AS type, text, CASE WHEN pos % 5 = 0 THEN 2 END AS heading_level, CAST(pos + 1 AS VARCHAR) AS element_id FROM lines"),
    "s5_span_lines": _with(EL, "SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, pos) - 1 AS pos, text, font_size FROM (SELECT doc_id, page_number, pos, x0, y0, concat_ws(' ', nullif(trim(text), ''), nullif(trim(alt_text), '')) AS text, CASE WHEN coalesce(trim(alt_text), '') <> '' THEN font_size + 2 ELSE font_size END AS font_size FROM el) WHERE text <> ''"),
    "s12_parent_tree_size": _with(NODES, "SELECT doc_id, CAST(sum(entries) AS BIGINT) + 2 AS entries FROM parw GROUP BY 1"),
    "s13_marked_count": _with(PLAN, "SELECT doc_id, count(*) AS marked FROM plan GROUP BY 1"),
    "x4_table_text": "SELECT p_partkey, p_size % 2 = 0 AS is_table FROM part",
    "x5_table_headers": "SELECT p_partkey, p_brand || '|' || p_type AS headers FROM part",
    "x6_block_confidence": _with(EL, "SELECT doc_id, pos, CASE WHEN k % 9 = 0 THEN 0.8 ELSE 0.85 END::DOUBLE AS confidence FROM el"),
    "x8_image_rows": _with(EL, "SELECT i.doc_id, i.pos, i.page_number || ':image:' || (i.ord + 1) AS element_id, 0.65::DOUBLE AS confidence, b.x0, b.y0 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos) - 1 AS ord FROM el WHERE type = 'image') i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos, copy) - 1 AS ord FROM (SELECT *, unnest(range(CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END)) AS copy FROM el WHERE type = 'image')) b ON b.doc_id = i.doc_id AND b.page_number = i.page_number AND b.ord = i.ord"),
    "x9_link_rows": _with(EL, f"SELECT e.doc_id, e.pos, coalesce(nullif(trim(texts), ''), href, '') AS text, CASE WHEN href IS NOT NULL THEN 0.85 ELSE 0.45 END::DOUBLE AS confidence FROM el e JOIN ({OVERLAP}) o ON o.doc_id = e.doc_id AND o.link_pos = e.pos"),
    "x14_heading_counts": _with(LINES, "SELECT doc_id, count(*) FILTER (type = 'heading') AS headings, 0 AS tables FROM ln GROUP BY 1"),
    "o3_document_values": _with(f"{DEC.strip()}, {LINES.strip()}, {VALUES}", "SELECT job_id AS doc_id, coalesce(nullif(trim(v0.value), ''), CASE WHEN job_id % 4 > 1 THEN 'Title ' || job_id END, t, 'Accessible Document') AS title, coalesce(nullif(trim(v1.value), ''), CASE WHEN job_id % 3 > 0 THEN 'en' END, 'en-AU') AS language FROM jobs LEFT JOIN (SELECT * FROM val WHERE slot = 0) v0 USING (job_id) LEFT JOIN (SELECT * FROM val WHERE slot = 1) v1 USING (job_id) LEFT JOIN ft ON ft.doc_id = job_id"),
    "o4_alt_text": _with(ISS.rstrip() + """,
        acc AS (SELECT doc_id, issue_ord AS seq, element_id, page_number, CASE WHEN pos % 6 <> 0 THEN x0 END AS x0, y0, x1, y1, 'Alt ' || issue_ord AS value FROM iss WHERE issue_type = 'missing_image_alt_text' AND issue_ord % 4 < 2),
        hit AS (SELECT e.doc_id, e.pos, arg_max(a.value, a.seq) AS v FROM el e JOIN acc a ON a.doc_id = e.doc_id AND e.type = 'image' AND (a.element_id = e.element_id OR (a.page_number = e.page_number AND (a.x0 IS NULL OR (a.x0 = e.x0 AND a.y0 = e.y0 AND a.x1 = e.x1 AND a.y1 = e.y1)))) GROUP BY 1, 2)""",
        "SELECT doc_id, pos, CASE WHEN decorative THEN '' ELSE coalesce(v, nullif(trim(alt_text), '')) END AS alt FROM el LEFT JOIN hit USING (doc_id, pos) WHERE type = 'image'"),
    "o9_failed_plan": _with(PLAN, "SELECT DISTINCT doc_id, 'failed' AS status, 'no space left' AS details FROM plan"),
    "o15_table_rows": _with(EL + TABLE, "SELECT doc_id, pos, len(rws) AS n_rows, coalesce(list_max(list_transform(rws, lambda r: len(r))), 0) AS n_columns, coalesce(array_to_string(rws[1], '|'), '') AS first_row FROM tbl"),
    "o17_list_labels": _with(EL, "SELECT doc_id, pos, CASE WHEN type <> 'list_item' THEN '' WHEN k % 3 = 0 THEN '*' ELSE '-' END AS label FROM el"),
    "c1_root_present": _with(PDF, "SELECT doc_id, coalesce(a, FALSE) AS passed FROM pdf"),
    "c2_mark_info": _with(PDF, "SELECT doc_id, coalesce(b, FALSE) AS passed FROM pdf"),
    "c9_reading_order": _passed("f9"),
    "c_validation_checks": _with(FAILS, " UNION ALL ".join(f"SELECT doc_id, 'structure.{c}' AS check_id, CASE WHEN {p} THEN 'passed' ELSE 'failed' END AS status, {p} AS passed FROM pdf" for c, p in zip(CHECK_IDS, PASSES, strict=True))),
    "c_validation_summary": _with(FAILS, f"""SELECT doc_id, CASE WHEN n = 10 THEN 'passed' ELSE 'failed' END AS status, 10::BIGINT AS check_count, n AS passed_count, 10 - n AS failed_count,
        coalesce(marks, 0) AS marks, coalesce(entries, 0) AS entries, coalesce(nodes, 0) AS nodes, coalesce(tops, 0) AS tops, coalesce(figures, 0) AS figures, coalesce(links, 0) AS links, coalesce(tables, 0) AS tables, coalesce(lists, 0) AS lists
        FROM (SELECT doc_id, {" + ".join(f"CAST({p} AS BIGINT)" for p in PASSES)} AS n FROM pdf) LEFT JOIN (SELECT doc_id, CAST(sum(marks) AS BIGINT) AS marks FROM mk GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(entries) AS BIGINT) AS entries FROM pk GROUP BY 1) USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS nodes, count(*) FILTER (is_top) AS tops, count(*) FILTER (role = 'Figure') AS figures, count(*) FILTER (role = 'Link') AS links, count(*) FILTER (role = 'Table') AS tables, count(*) FILTER (role = 'L') AS lists FROM hurt GROUP BY 1) USING (doc_id)"""),
    "v2_problems": _with(DEC, "SELECT job_id, seq, problem FROM (SELECT job_id, seq, CASE WHEN (job_id + slot) % 7 = 0 THEN 'unknown suggestion' WHEN seq % 9 = 0 THEN 'mismatch' WHEN slot = 3 THEN 'unknown issue' END AS problem FROM dec) WHERE problem IS NOT NULL"),
    "v4_messages": _with(DEC, "SELECT job_id, seq, CASE decision WHEN 'accept' THEN 'The suggestion was taken as it is.' WHEN 'edit' THEN 'The suggestion was taken with changes.' ELSE 'The suggestion was turned down.' END AS message FROM dec"),
    "g6_document_values": _with(PDF, " UNION ALL ".join([
        _value("encrypted_pdf", "manual_review", "''", "enc", 0.4),
        _value("untagged_pdf", "rebuild_pdf_tags", "'Rebuild PDF logical structure tree from the internal document model.'", "NOT enc AND tagged = FALSE", 0.95, "FALSE"),
        _value("unknown_pdf_tagging", "manual_review", "''", "NOT enc AND tagged IS NULL", 0.4),
        _value("no_extractable_pdf_text", "request_ocr", "'Run OCR before remediation.'", "NOT enc AND page_count > 0 AND blocks = 0", 0.9),
        _value("multi_column_reading_order_review", "confirm_reading_order", "'Confirm the correct reading order and section structure before PDF rebuild.'", "NOT enc AND pages <> ''", 0.75),
        _value("missing_document_language", "set_document_language", "CASE WHEN doc_id % 5 = 0 THEN 'fr' ELSE 'en-AU' END", BLANK, 0.7),
    ])),
    "g9_explanation": _with(MATCH, f"SELECT doc_id, issue_ord, 'Found: ' || issue_type || '.' || CASE WHEN coalesce(trim(proposed_value), '') <> '' THEN ' Suggested step: ' || {ACTION} || '.' ELSE ' Nothing can be suggested; please look at it yourself.' END AS explanation FROM sg"),
    "p5_audit_rows": _with(ISS, f"SELECT doc_id, issue_ord AS event_seq, 'suggestion_created' AS type, issue_ord, {ACTION} AS action FROM iss"),
    "p7_job_report": _with(ISS, "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'reviewed' ELSE 'awaiting_review' END AS status, o_orderkey % 3 AS artifacts, count(issue_ord) AS issues, count(*) FILTER (severity = 'high') AS high FROM orders LEFT JOIN iss ON iss.doc_id = o_orderkey GROUP BY 1"),
    "p10_report_name": "SELECT p_partkey, p_name || '_accessibility_report.json' AS name FROM part",
    "j5_status_after": _with(DEC, "SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'output_generated' ELSE 'awaiting_review' END AS before, CASE WHEN count(slot) > 0 AND count(*) FILTER (slot IS NOT NULL AND decision IS NULL) = 0 THEN 'reviewed' ELSE 'awaiting_review' END AS after FROM jobs LEFT JOIN slots USING (job_id) LEFT JOIN lat USING (job_id, slot) GROUP BY 1"),
    "j9_round_trip": _with(EL, "SELECT doc_id, pos, type, text, heading_level, alt_text, decorative FROM el"),
    "h7_categories": _with(ISS, "SELECT doc_id, count(DISTINCT issue_type) AS categories FROM iss GROUP BY 1"),
}
#: The plan's part behind the elements, which issues come with too.
PLANNED = PLAN.removeprefix(EL)
ROUND = PDF.rstrip() + "," + ISS.rstrip() + PLANNED.rstrip() + ALTS.rstrip() + REBUILT.rstrip() + COLUMNS.rstrip() + """,
insp AS (SELECT doc_id, coalesce(pgs, 1) AS page_count, CAST(coalesce(found, 0) AS BIGINT) AS text_block_count, coalesce(many, '') AS pages FROM pdf p LEFT JOIN (SELECT doc_id, max(page_index) + 1 AS pgs FROM plan GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, sum(lines) AS found, string_agg(page_number, ', ' ORDER BY page_number) FILTER (multi_column) AS many FROM fin GROUP BY 1) USING (doc_id)),
flat AS (SELECT doc_id FROM el GROUP BY 1 HAVING count(*) FILTER (type = 'heading') = 0 AND count(*) FILTER (type = 'paragraph') >= 4),
src AS (SELECT doc_id, issue_type, CASE WHEN issue_type = 'missing_image_alt_text' THEN CASE WHEN issue_ord % 4 < 2 THEN 'accepted' WHEN issue_ord % 4 = 2 THEN 'rejected' ELSE 'open' END WHEN issue_ord % 5 = 0 THEN 'rejected' ELSE 'accepted' END AS final_status FROM iss
  UNION ALL SELECT doc_id, 'encrypted_pdf', 'accepted' FROM tg WHERE enc UNION ALL SELECT doc_id, 'untagged_pdf', 'accepted' FROM tg WHERE NOT enc AND tagged = FALSE UNION ALL SELECT doc_id, 'unknown_pdf_tagging', 'accepted' FROM tg WHERE NOT enc AND tagged IS NULL
  UNION ALL SELECT doc_id, 'no_extractable_pdf_text', 'accepted' FROM tg WHERE NOT enc AND page_count > 0 AND blocks = 0 UNION ALL SELECT doc_id, 'multi_column_reading_order_review', 'accepted' FROM tg WHERE NOT enc AND pages <> ''
  UNION ALL SELECT doc_id, 'missing_document_title', 'accepted' FROM pdf WHERE doc_id % 2 <> 0 UNION ALL SELECT doc_id, 'missing_document_language', 'accepted' FROM tg WHERE coalesce(trim(language), '') = '' UNION ALL SELECT doc_id, 'missing_heading_structure', 'accepted' FROM flat),
again AS (SELECT doc_id, 'skipped_heading_level' AS issue_type FROM (SELECT doc_id, heading_level, lag(heading_level) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ra WHERE type = 'heading') WHERE heading_level > before + 1
  UNION ALL SELECT doc_id, 'weak_link_text' FROM ra WHERE type = 'link' AND (lower(trim(text)) IN ('', 'click here', 'here', 'link', 'learn more', 'more', 'read more', 'view', 'download') OR regexp_matches(lower(trim(text)), '^(https?://|www\\.)'))
  UNION ALL SELECT doc_id, 'missing_heading_structure' FROM ra GROUP BY 1 HAVING count(*) FILTER (type = 'heading') = 0 AND count(*) FILTER (type = 'paragraph') >= 4
  UNION ALL SELECT doc_id, 'missing_document_language' FROM pdf WHERE language = ' ' UNION ALL SELECT doc_id, 'no_extractable_pdf_text' FROM insp WHERE text_block_count = 0 UNION ALL SELECT doc_id, 'multi_column_reading_order_review' FROM insp WHERE pages <> '')
"""
#: Pages as streams of marked content, by element and line.
STREAMS = PLAN.rstrip() + OWN_ALTS.rstrip() + REBUILT.rstrip() + r""",
ln2 AS (SELECT doc_id, page_index, y, CASE WHEN role = 'LI' THEN CASE WHEN k % 3 = 0 THEN '* ' ELSE '- ' END || trim(text) WHEN role = 'Figure' THEN CASE WHEN decorative THEN 'Decorative image' WHEN coalesce(alt, '') = '' THEN 'Figure: alt text requires review' ELSE 'Figure: ' || alt END ELSE trim(text) END AS text, 0 AS ri, 0 AS ci FROM pl WHERE role <> 'Table'
   UNION ALL SELECT doc_id, page_index, y, CASE WHEN length(c) <= 28 THEN c ELSE left(c, 25) || '...' END, ri, ci FROM cel WHERE c <> ''),
eln AS (SELECT doc_id, page_index, y, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y) - 1 AS mcid, count(*) AS blocks, string_agg('q BT (' || replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)') || ') Tj ET Q', ' ' ORDER BY ri, ci) AS s FROM ln2 GROUP BY 1, 2, 3)
"""

#: Elements below elements with the way to each, whose order is the preorder.
TREES = EL.rstrip() + """,
up AS (SELECT e.doc_id, e.pos, e.type, e.text, e.k * 100 + e.pos AS ord, (SELECT max(p.pos) FROM el p WHERE p.doc_id = e.doc_id AND p.pos < e.pos AND p.type = 'heading' AND p.heading_level < CASE WHEN e.type = 'heading' THEN e.heading_level ELSE 7 END) AS parent FROM el e),
down AS (SELECT doc_id, pos, type, text, 0::BIGINT AS depth, [ord] AS way FROM up WHERE parent IS NULL UNION ALL SELECT u.doc_id, u.pos, u.type, u.text, d.depth + 1, list_append(d.way, u.ord) FROM up u JOIN down d ON d.doc_id = u.doc_id AND d.pos = u.parent)
"""
STORED = "res AS (SELECT s.job_id, s.slot, l.final_status FROM slots s LEFT JOIN lat l USING (job_id, slot)), ev AS (SELECT d.job_id, d.seq, d.slot, d.decision FROM dec d JOIN slots USING (job_id, slot)), js AS (SELECT job_id, count(*) AS issues, count(*) FILTER (final_status IS NULL) AS open, (SELECT count(*) FROM ev WHERE ev.job_id = res.job_id) AS events, CASE WHEN job_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS artifacts FROM res GROUP BY 1)"
STATUS = "CASE WHEN events > 0 THEN CASE WHEN open = 0 THEN 'reviewed' ELSE 'awaiting_review' END WHEN artifacts > 0 THEN 'output_generated' ELSE 'awaiting_review' END"

SCANNED = (
    NODES.rstrip() + OWN_ALTS.rstrip() + REBUILT.rstrip() + """,
ord AS (SELECT o_orderkey AS doc_id, o_orderkey % 11 = 0 AS enc, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS readable FROM orders),
sn AS (SELECT doc_id, count(*) AS elements FROM nodes GROUP BY 1), pn AS (SELECT doc_id, CAST(sum(entries) AS BIGINT) + 2 AS entries FROM parw GROUP BY 1),
gn AS (SELECT doc_id, count(DISTINCT page_index) AS pages, count(*) AS marks, count(*) FILTER (role = 'Figure') AS images, count(*) FILTER (role = 'Link') AS links FROM plan GROUP BY 1), tn AS (SELECT doc_id, count(*) AS texts FROM gl GROUP BY 1),
sc AS (SELECT o.*, CASE WHEN readable THEN CASE WHEN elements IS NOT NULL THEN 'true' ELSE 'false' END ELSE 'unknown' END AS tree, CASE WHEN readable THEN CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END ELSE 'unknown' END AS marked,
  CASE WHEN readable THEN coalesce(elements, 0) ELSE 0 END AS elements, CASE WHEN readable THEN coalesce(entries, 0) ELSE 0 END AS entries, coalesce(pages, 0) AS pages, CASE WHEN enc THEN 0 ELSE coalesce(marks, 0) END AS marks, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE coalesce(images, 0) END AS images, coalesce(links, 0) AS links, coalesce(texts, 0) AS texts
  FROM ord o LEFT JOIN sn USING (doc_id) LEFT JOIN pn USING (doc_id) LEFT JOIN gn USING (doc_id) LEFT JOIN tn USING (doc_id))
"""
)
#: All issues of whole analyses.
_kinds = [("encrypted_pdf", "pdf.encryption", "critical", 1.0, "cannot_automate", "enc"), ("untagged_pdf", "pdf.tags.present", "critical", 0.95, "auto_fixable", "NOT enc AND tagged = FALSE"), ("unknown_pdf_tagging", "pdf.tags.present", "high", 0.5, CONFIRM, "NOT enc AND tagged IS NULL"), ("no_extractable_pdf_text", "pdf.extractable_text", "critical", 0.9, CONFIRM, "NOT enc AND page_count > 0 AND blocks = 0"), ("multi_column_reading_order_review", "pdf.reading_order.multicolumn", "high", 0.75, CONFIRM, "NOT enc AND pages <> ''")]
ALL = PDF.rstrip() + "," + ISS.rstrip() + f""",
worded AS (SELECT doc_id FROM el WHERE trim(text) <> '' GROUP BY 1),
flat AS (SELECT doc_id FROM el GROUP BY 1 HAVING count(*) FILTER (type = 'heading') = 0 AND count(*) FILTER (type = 'paragraph') >= 4),
alli AS ({" UNION ALL ".join(f"SELECT doc_id, 0 AS part, 0 AS nr, '{r}' AS rule_id, '{t}' AS issue_type, '{s}' AS severity, {c}::DOUBLE AS confidence, '{a}' AS automation_status, 0 AS page FROM tg WHERE {w}" for t, r, s, c, a, w in _kinds)}
  UNION ALL SELECT doc_id, 1, 0, 'wcag.document.title', 'missing_document_title', 'high', CASE WHEN doc_id IN (SELECT doc_id FROM worded) THEN 0.85 ELSE 0.6 END, CASE WHEN doc_id IN (SELECT doc_id FROM worded) THEN 'auto_fixable' ELSE '{CONFIRM}' END, 0 FROM tg WHERE doc_id % 2 <> 0
  UNION ALL SELECT doc_id, 1, 1, 'wcag.document.language', 'missing_document_language', 'high', 0.7, '{CONFIRM}', 0 FROM tg WHERE {BLANK}
  UNION ALL SELECT doc_id, 1, 2, 'wcag.headings.present', 'missing_heading_structure', 'medium', 0.75, '{CONFIRM}', 0 FROM flat JOIN tg USING (doc_id)
  UNION ALL SELECT doc_id, 2, issue_ord, rule_id, issue_type, severity, confidence, automation_status, page_number FROM iss),
ai AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, nr, issue_type) - 1 AS issue_ord, CASE issue_type WHEN 'missing_document_title' THEN 'set_document_title' WHEN 'missing_document_language' THEN 'set_document_language' WHEN 'untagged_pdf' THEN 'rebuild_pdf_tags' WHEN 'no_extractable_pdf_text' THEN 'request_ocr' WHEN 'unknown_pdf_tagging' THEN 'manual_review' WHEN 'encrypted_pdf' THEN 'manual_review' ELSE {ACTION} END AS action FROM alli)
"""

SQL |= {
    "s6_inspections": _with(SCANNED, "SELECT doc_id, enc AS is_encrypted, tree, marked, CASE WHEN readable THEN 'en' ELSE '' END AS language, CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE '' END AS title, elements AS structure_element_count, entries AS parent_tree_entry_count, marks AS marked_content_count, pages AS page_count, texts AS text_block_count, images AS image_count, links AS link_count, CASE WHEN readable THEN 0 ELSE 1 END + CASE WHEN doc_id % 17 = 0 THEN pages ELSE 0 END AS warnings FROM sc"),
    "s6_inspection_issues": _with(SCANNED, "SELECT doc_id, 'encrypted_pdf' AS issue_type, 'critical' AS severity FROM sc WHERE enc UNION ALL SELECT doc_id, 'untagged_pdf', 'critical' FROM sc WHERE readable AND (tree = 'false' OR marked = 'false') UNION ALL SELECT doc_id, 'unknown_pdf_tagging', 'high' FROM sc WHERE NOT readable AND NOT enc UNION ALL SELECT doc_id, 'no_extractable_pdf_text', 'critical' FROM sc WHERE NOT enc AND pages > 0 AND texts = 0 UNION ALL SELECT doc_id, 'missing_document_language', 'high' FROM sc WHERE NOT readable"),
    "s8_warnings": _with(SCANNED, "SELECT doc_id, CASE WHEN enc THEN 'The file is encrypted, so little of it can be inspected.' ELSE 'The catalog cannot be read.' END AS warning FROM sc WHERE NOT readable UNION ALL SELECT DISTINCT doc_id, 'The images of page ' || (page_index + 1) || ' cannot be read.' FROM plan WHERE doc_id % 17 = 0"),
    "r16_own_rules": _with(ISS, f"""SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN stage = 0 THEN 0 ELSE 1 END, pos, stage) - 1 AS issue_ord, rule_id, issue_type, severity, confidence, automation_status, coalesce(suggested_fix, '') AS suggested_fix FROM (
        SELECT doc_id, pos, stage, rule_id, issue_type, severity, confidence, '{CONFIRM}' AS automation_status, suggested_fix FROM iss0
        UNION ALL SELECT doc_id, pos, 3, 'house.links.mail', 'mail_link', 'low', 0.8, 'auto_fixable', 'Say whose address ' || href || ' is.' FROM el WHERE type = 'link' AND href LIKE 'mailto:%'
        UNION ALL SELECT doc_id, pos, 4, 'house.headings.short', 'long_heading', 'medium', confidence, '{CONFIRM}', NULL FROM el WHERE type = 'heading' AND length(text) > 10
        UNION ALL SELECT doc_id, pos, 5, 'house.lists.marks', 'bare_list', 'low', confidence, '{CONFIRM}', NULL FROM el WHERE type = 'list_item' AND k % 3 <> 0)"""),
    "o2_value_by_action": _with(DEC, "SELECT job_id, CASE WHEN slot % 2 = 0 THEN 'set_document_title' ELSE 'set_document_language' END AS action, arg_max(coalesce(nullif(trim(final_value), ''), proposed_value), seq) AS value FROM dec JOIN slots USING (job_id, slot) WHERE decision IN ('accept', 'edit') GROUP BY 1, 2"),
    "h7_shown_reports": """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'click' AS file, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_type = 'click' OR event_id % 3 = 1 THEN replace(props, ' ', '') END AS body FROM events WHERE event_type IN ('click', 'purchase'))
        SELECT user_id AS job_id, coalesce(arg_min(body, n) FILTER (body IS NOT NULL), '') AS shown, CASE WHEN arg_min(file, n) THEN 'Accessible PDF' ELSE 'Remediation Report' END AS first_label FROM e GROUP BY 1""",
    "x12_boxes": _with(EL, "SELECT doc_id, pos, CASE WHEN k % 5 < 2 THEN x0 ELSE -1 END::DOUBLE AS x0, CASE WHEN k % 5 < 2 THEN y1 ELSE -1 END::DOUBLE AS y1 FROM el"),
    "t8_parent_tree_nodes": _with(NODES, "SELECT doc_id, page_index AS key, string_agg(mcid || ':' || pos || ':' || role, ' ' ORDER BY mcid) AS nodes FROM nodes WHERE is_leaf GROUP BY 1, 2 UNION ALL SELECT doc_id, struct_parent, '-1:' || pos || ':Link' FROM zip WHERE struct_parent IS NOT NULL"),
    "p6_whole_reports": _with(ALL, """SELECT p.doc_id, 'order ' || p.doc_id || '.pdf' AS file, 'WCAG 2.2 AA' AS target, 'pdf' AS format, page_count AS pages, count(issue_ord) AS issues, count(issue_ord) AS suggestions, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
        count(*) FILTER (automation_status = 'auto_fixable') AS auto, count(*) FILTER (issue_type = 'weak_link_text') AS weak_links, CASE WHEN p.doc_id % 2 = 0 THEN 'reviewed' ELSE 'awaiting_review' END AS status, CASE WHEN p.doc_id % 3 = 2 THEN '2' ELSE '' END AS second_artifact FROM pdf p LEFT JOIN ai USING (doc_id) GROUP BY p.doc_id, page_count"""),
    "p6_report_issues": _with(ALL, "SELECT doc_id, issue_ord AS ord, issue_ord, rule_id, issue_type, severity, confidence, automation_status, 'open' AS final_status, page AS source_page_number FROM ai"),
    "p6_report_suggestions": _with(ALL, "SELECT doc_id, issue_ord AS ord, issue_ord, action, CASE WHEN issue_type IN ('missing_image_alt_text', 'weak_link_text', 'missing_heading_structure') THEN 'ai_assisted' ELSE 'rule' END AS source, automation_status <> 'auto_fixable' AS requires_user_confirmation FROM ai"),
    "p6_report_events": _with(ALL, "SELECT doc_id, issue_ord AS ord, 'suggestion_created' AS type, issue_ord, action AS metadata_action FROM ai"),
    "p10_report_files": _with(ALL, "SELECT 'order_' || p.doc_id || '_accessibility_report.json' AS name, p.doc_id AS job_id, count(issue_ord) AS issues FROM pdf p LEFT JOIN ai USING (doc_id) GROUP BY 1, 2"),
    "x13_preorder": _with(TREES, "SELECT doc_id, pos AS id, type, depth, row_number() OVER w - 1 AS place, lead(type) OVER w AS next_type FROM down WINDOW w AS (PARTITION BY doc_id ORDER BY way)"),
    "j9_nested_round_trip": _with(TREES, "SELECT doc_id, pos AS id, type, text, depth, depth + 1 AS ordinals FROM down"),
    "s10_resolved_objects": """WITH e AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS num, count(*) OVER (PARTITION BY user_id) AS n, event_type, props FROM events),
        f AS (SELECT *, num % 17 = 0 AS self, num % 17 <> 0 AND event_type NOT IN ('view', 'signup') AS is_end FROM e),
        g AS (SELECT *, min(num) FILTER (self OR is_end) OVER (PARTITION BY doc_id ORDER BY num ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM f)
        SELECT g.doc_id, g.num, CASE WHEN t.is_end THEN t.props ELSE '' END AS value, CASE WHEN g.stop IS NULL THEN g.n - g.num + 1 WHEN t.self THEN -1 ELSE g.stop - g.num END AS hops, CASE WHEN g.stop IS NULL THEN 'dangling' WHEN t.self THEN 'cycle' ELSE 'found' END AS state FROM g LEFT JOIN f t ON t.doc_id = g.doc_id AND t.num = g.stop""",
    "c14_page_identity": _with(NODES, "SELECT doc_id, pos, row, cell, CASE WHEN k % 9 = 0 THEN -1 ELSE page_index END AS page_index FROM nodes WHERE is_leaf"),
    "j1_stored_jobs": _with(f"{DEC.strip()}, {STORED}", f"SELECT job_id, {STATUS} AS status, issues, open, events, artifacts, CASE WHEN events > 0 THEN 3 WHEN artifacts > 0 THEN 2 ELSE 1 END::BIGINT AS version FROM js"),
    "j2_job_history": _with(f"{DEC.strip()}, {STORED}", f"SELECT version, status, count(*) AS jobs FROM (SELECT 1::BIGINT AS version, 'awaiting_review' AS status FROM js UNION ALL SELECT 2, CASE WHEN artifacts > 0 THEN 'output_generated' ELSE 'awaiting_review' END FROM js UNION ALL SELECT 3, {STATUS} FROM js) GROUP BY ALL"),
    "j3_job_lookup": _with(f"{DEC.strip()}, {STORED}", "SELECT job_id, row_number() OVER (ORDER BY seq) AS event_seq, slot, decision FROM ev WHERE job_id = (SELECT max(user_id) FROM events)"),
    "o1_documents": _with(ROUND, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Order ' || doc_id WHEN doc_id % 2 = 0 THEN 'T' ELSE coalesce(t, 'Accessible Document') END AS title, CASE WHEN coalesce(language, '') = '' THEN 'en-AU' ELSE language END AS language FROM pdf LEFT JOIN (SELECT doc_id, left(trim(arg_min(text, pos)), 80) AS t FROM el WHERE trim(text) <> '' GROUP BY 1) USING (doc_id)"),
    "o1_lines": _with(ROUND, "SELECT doc_id, page_number, text, font_size, x0, y0, x1, y1 FROM gl"),
    "o1_read_again": _with(ROUND, "SELECT doc_id, pos, type, text, heading_level, confidence, element_id FROM ra"),
    "o1_inspections": _with(ROUND, "SELECT doc_id, page_count, text_block_count, pages FROM insp"),
    "o9_plan": _with(ROUND, """SELECT doc_id, pos, role, left(text, 80) AS text_preview, page_index, CASE WHEN role = 'Table' THEN (SELECT count(*) FROM cel WHERE cel.doc_id = pl.doc_id AND cel.page_index = pl.page_index AND cel.y = pl.y AND c <> '') ELSE 1 END AS block_count, coalesce(alt, 'none') AS alt, decorative,
        CASE WHEN role = 'Table' THEN CAST(to_json(rws) AS VARCHAR) ELSE '[]' END AS cells, n_headers, CASE WHEN role <> 'LI' THEN '' WHEN k % 3 = 0 THEN '*' ELSE '-' END AS list_label FROM pl"""),
    "p8_before_after": _with(ROUND, """SELECT doc_id, bucket, issue_type, n FROM (
        SELECT doc_id, 'rejected' AS bucket, issue_type, count(*) AS n FROM src WHERE final_status = 'rejected' GROUP BY ALL
        UNION ALL SELECT doc_id, 'fixed', issue_type, count(*) FROM src s WHERE final_status <> 'rejected' AND NOT EXISTS (SELECT 1 FROM again a WHERE a.doc_id = s.doc_id AND a.issue_type = s.issue_type) GROUP BY ALL
        UNION ALL SELECT doc_id, unnest(['remaining', 'manual']), issue_type, n FROM (SELECT doc_id, issue_type, count(*) AS n FROM again GROUP BY ALL))"""),
    "t9_marked_streams": _with(STREAMS, "SELECT doc_id, page_index, 'head ' || string_agg('/P <</MCID ' || mcid || '>> BDC' || chr(10) || s || chr(10) || 'EMC', ' ' ORDER BY mcid) || ' tail' AS stream FROM eln GROUP BY 1, 2"),
    "t10_plan_values": _with(STREAMS, "SELECT doc_id, pos, greatest(0, least(pages - 1, CASE WHEN k % 7 > 1 THEN page_index - m ELSE 0 END)) AS page_index, greatest(1, CASE WHEN k % 7 > 1 THEN blocks - m ELSE 1 END) AS blocks, greatest(0, CASE WHEN k % 7 > 1 THEN n_headers - m ELSE 0 END) AS headers FROM (SELECT pl.*, eln.blocks, CASE WHEN k % 7 = 2 THEN 3 ELSE 0 END AS m, max(pl.page_index) OVER (PARTITION BY pl.doc_id) + 1 AS pages FROM pl JOIN eln ON eln.doc_id = pl.doc_id AND eln.page_index = pl.page_index AND eln.y = pl.y)"),
    "c12_tree_elements": _with(NODES, "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, row, cell) - 1 AS ord, CASE WHEN role IN ('LI', 'TR') THEN 1 WHEN role IN ('Lbl', 'LBody', 'TH', 'TD') THEN 2 ELSE 0 END::BIGINT AS depth, role FROM nodes"),
    "c13_number_tree": _with(NODES, "SELECT doc_id, key, CAST(sum(entries) AS BIGINT) AS entries FROM parw GROUP BY 1, 2"),
    "c14_page_marks": _with(PLAN, "SELECT doc_id, page_index, count(*) AS marks FROM plan GROUP BY 1, 2"),
    "c16_validator": _with(FAILS, f"SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 4 WHEN 0 THEN 'unavailable' WHEN 3 THEN 'error' ELSE 'completed' END AS status, CASE WHEN doc_id % 4 = 3 THEN 'false' WHEN doc_id % 4 = 0 OR doc_id % 8 = 5 THEN 'unknown' WHEN {' AND '.join(PASSES)} THEN 'true' ELSE 'false' END AS passed, doc_id % 8 = 3 AS told FROM pdf"),
    "h3_payloads": _with(DEC, "SELECT job_id, seq, CASE WHEN seq % 11 = 0 THEN 'no record' WHEN seq % 5 = 0 THEN 'lacks issue_id' WHEN seq % 7 = 0 THEN 'unknown decision' ELSE '' END AS problem FROM dec"),
    "h3_suffix": "SELECT p_partkey, (['.pdf', '.docx', ''])[p_size % 3 + 1] AS suffix FROM part",
    "h6_reports": _with(ISS, """SELECT doc_id, n0 + n1 AS issues, n0_high + n1_high AS high, CASE WHEN doc_id % 2 <> 0 THEN 'missing_document_title' WHEN doc_id % 3 <> 0 THEN 'missing_document_language' WHEN flat THEN 'missing_heading_structure' ELSE coalesce(first_issue, '') END AS first_issue FROM (
        SELECT o_orderkey AS doc_id, coalesce(flat, FALSE) AS flat, first_issue, coalesce(n, 0) AS n1, coalesce(high, 0) AS n1_high,
          CASE WHEN o_orderkey % 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(flat, FALSE) THEN 1 ELSE 0 END AS n0,
          CASE WHEN o_orderkey % 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS n0_high
        FROM orders LEFT JOIN (SELECT doc_id, count(*) FILTER (type = 'heading') = 0 AND count(*) FILTER (type = 'paragraph') >= 4 AS flat FROM el GROUP BY 1) f ON f.doc_id = o_orderkey
        LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (severity = 'high') AS high, arg_min(issue_type, issue_ord) AS first_issue FROM iss GROUP BY 1) i ON i.doc_id = o_orderkey)"""),
    "h8_scripted_review": _with(MATCH, "SELECT doc_id, issue_ord, CASE WHEN issue_type IN ('missing_image_alt_text', 'weak_link_text') THEN 'edit' ELSE 'accept' END AS decision, CASE issue_type WHEN 'missing_image_alt_text' THEN 'A picture that the text beside it describes.' WHEN 'weak_link_text' THEN 'Open the page named beside this link' ELSE coalesce(proposed_value, '') END AS final_value FROM sg"),
}
SQL = {name: _stripping(sql) for name, sql in SQL.items()}
